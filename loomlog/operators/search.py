"""Search over the log table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import contains_text, phrase_prefix
from loomlog.schema import DEFAULT_LEVEL, LEVELS

MAX_PAGE = 1000
PAGE = 100
TAIL = 200

MODES = {"phrase_prefix": phrase_prefix, "substring": contains_text}


def of_tenant(tenant: str) -> Column:
    """Equality on the partition column. A name prefix would let t0 read t0-eu."""
    return F.col("tenant") == tenant


def terms(level: str = "", service: str = "") -> Column:
    """Exact, case-sensitive filters; an empty string is no filter."""
    wanted = {"level": level, "service": service}
    return reduce(
        Column.__and__, [F.col(c) == value for c, value in wanted.items() if value], F.lit(True)
    )


def matches(q: str = "", level: str = "", service: str = "", mode: str = "phrase_prefix") -> Column:
    """All given clauses together; none given matches everything."""
    text = MODES[mode](F.col("message"), q) if q else F.lit(True)
    return terms(level, service) & text


def search(
    logs: DataFrame, tenant: str, q: str = "", level: str = "", service: str = "", mode: str = "phrase_prefix"
) -> DataFrame:
    return logs.where(of_tenant(tenant) & matches(q, level, service, mode))


def page(hits: DataFrame, limit: int = PAGE) -> DataFrame:
    """Newest first; the id breaks ties so that a page is the same every time."""
    return hits.orderBy(F.desc("timestamp"), "doc_id").limit(min(max(limit, 0), MAX_PAGE))


def latest_arrivals(hits: DataFrame, arrival: str, limit: int = PAGE) -> DataFrame:
    """Last stored first, whatever the event time says."""
    return hits.orderBy(F.desc(arrival)).limit(min(max(limit, 0), MAX_PAGE))


def live_tail(logs: DataFrame, per_tenant: int = TAIL) -> DataFrame:
    """The newest rows of every tenant. Each task first keeps its own newest, so a tenant's
    shuffle input is at most ``per_tenant`` rows per task."""
    newest = Window.partitionBy("tenant").orderBy(F.desc("timestamp"), "doc_id")
    return logs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= per_tenant).drop("_n")


def new_rows(current: DataFrame, previous: DataFrame | None, key: Column) -> DataFrame:
    """Rows whose key the previous poll did not show. On the first poll nothing is new."""
    if previous is None:
        return current.limit(0)
    seen = previous.select("tenant", key.alias("_key")).distinct()
    return current.withColumn("_key", key).join(seen, ["tenant", "_key"], "left_anti").drop("_key")


def display(hits: DataFrame) -> DataFrame:
    """What a table view shows: trimmed time, a known level, a dash for no service."""
    return hits.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        F.when(F.col("level").isin(LEVELS), F.col("level")).otherwise(F.lit(DEFAULT_LEVEL)).alias("level"),
        F.coalesce(F.nullif("service", F.lit("")), F.lit("—")).alias("service"),
        "message",
    )
