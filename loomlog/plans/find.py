"""Search over a store, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomlog.operators import search as s
from loomlog.plans.store import LogStore


def newest(
    store: LogStore,
    tenant: str,
    q: str = "",
    level: str = "",
    service: str = "",
    limit: int = s.PAGE,
    mode: str = "phrase_prefix",
) -> DataFrame:
    """One page of hits. Days do not overlap in time, so the last day is tried alone, then the
    last two, four, …, until a page is full: a common term never costs a scan of all days."""

    def hits(since=None) -> DataFrame:
        return s.search(store.read(tenant, since=since), tenant, q, level, service, mode)

    limit = min(max(limit, 0), s.MAX_PAGE)
    days = sorted({day for _, day, _ in store.day_folders(tenant)}, reverse=True)
    span = 1
    while limit and span < len(days):
        recent = hits(days[span - 1])
        if recent.limit(limit).count() == limit:
            return s.page(recent, limit)
        span *= 2
    return s.page(hits(), limit)
