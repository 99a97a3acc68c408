"""What is old enough to go. ``as_of`` is given, never read from the clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoff(as_of: datetime, days: int) -> datetime:
    """The instant ``days`` before ``as_of``; a naive time is taken as UTC."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return as_of - timedelta(days=days)


def event_kept(as_of: datetime, days: int) -> Column:
    """Event by event: kept from the cutoff on."""
    return F.col("timestamp") >= F.lit(cutoff(as_of, days))


def first_day_kept(as_of: datetime, days: int) -> date:
    """A day goes as a whole once its midnight is before the cutoff."""
    limit = cutoff(as_of, days).astimezone(timezone.utc)
    return limit.date() if limit.time() == limit.min.time() else limit.date() + timedelta(days=1)


def day_kept(as_of: datetime, days: int) -> Column:
    """Day by day; on the partition column only, so a store reads no row to decide."""
    return F.col("day") >= F.lit(first_day_kept(as_of, days))


def split(logs: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired), complements of each other: what cannot be decided, as without a time, is kept."""
    kept = F.coalesce(kept, F.lit(True))
    return logs.where(kept), logs.where(~kept)
