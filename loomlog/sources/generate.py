"""Synthetic events and lines.

Every choice is read off a digest of (seed, id), so a row comes out the same whichever task
makes it and however often, which rand() does not promise once partitions change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of the load test and of the demo service.
SERVICES = ["checkout", "auth", "payments", "search", "notifications"]
EVENT_LEVELS = ["INFO"] * 8 + ["WARNING", "ERROR"]
WORDS = ["request", "completed", "user", "login", "failed", "timeout", "retry", "cache", "miss", "db", "query", "slow", "ok"]
LINE_LEVELS = ["INFO"] * 7 + ["WARNING", "ERROR"]
LINE_MESSAGES = [
    "request completed",
    "cache miss",
    "db query slow",
    "user login ok",
    "payment failed",
    "retry after timeout",
    "connection reset",
    "healthcheck ok",
]
MIN_WORDS, MAX_WORDS = 4, 9


def _draw(digest: Column, slot: int, n: int, digits: int = 4) -> Column:
    """A number in [0, n) from the slot-th group of four hex digits."""
    return F.conv(F.substring(digest, slot * 4 + 1, digits), 16, 10).cast("long") % n


def _pick(digest: Column, slot: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(digest, slot, len(values)) + 1).cast("int"))


def _digest(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def gen_events(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """(id, service, level, message, attrs), one event per id."""
    digest = F.col("_digest")
    length = _draw(digest, 2, MAX_WORDS - MIN_WORDS + 1) + MIN_WORDS
    words = F.array(*[_pick(digest, 3 + i, WORDS) for i in range(MAX_WORDS)])
    req_id = _draw(digest, 12, 10**9, digits=12)
    return ids.select(id_col, _digest(id_col, seed).alias("_digest")).select(
        id_col,
        _pick(digest, 0, SERVICES).alias("service"),
        _pick(digest, 1, EVENT_LEVELS).alias("level"),
        F.concat_ws(" ", F.slice(words, F.lit(1), length.cast("int"))).alias("message"),
        F.concat(F.lit('{"req_id":'), req_id.cast("string"), F.lit("}")).alias("attrs"),
    )


def gen_lines(ids: DataFrame, id_col: str, at: Column, seed: int = 42) -> DataFrame:
    """(id, value): ``ISO-time LEVEL message`` text lines."""
    digest = F.col("_digest")
    return ids.select(id_col, at.alias("_at"), _digest(id_col, seed).alias("_digest")).select(
        id_col,
        F.concat_ws(
            " ",
            F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss"),
            _pick(digest, 0, LINE_LEVELS),
            _pick(digest, 1, LINE_MESSAGES),
        ).alias("value"),
    )
