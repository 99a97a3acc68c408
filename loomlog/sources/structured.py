"""Structured payloads: JSON text holding one event or a list of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.events import open_events
from loomlog.functions.text import normalize_level
from loomlog.schema import DEFAULT_SERVICE, DEFAULT_TENANT, LOG_COLUMNS, MAX_BODY_BYTES


def check_payloads(
    df: DataFrame,
    payload: str = "payload",
    ingest_time: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per event: the log columns, or ``raw`` text and ``reason`` for a rejected one.

    A bad element costs only itself, not its whole payload.
    """
    now = F.current_timestamp() if ingest_time is None else ingest_time
    parsed = df.select(
        *keep, F.col(payload).alias("_payload"), now.alias("_now"), F.try_parse_json(payload).alias("_v")
    )
    elements = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    items = parsed.select(*keep, "_payload", "_now", F.explode(elements).alias("_item"))
    opened = open_events(items, "_item", [*keep, "_payload", "_now", "_item"], empty_message_ok=True)
    accepted = F.col("reason").isNull()
    event = {
        "timestamp": F.coalesce("timestamp", "_now"),
        "level": normalize_level(F.coalesce("level", F.lit(""))),
        "service": F.coalesce("service", F.lit(DEFAULT_SERVICE)),
        "message": F.col("message"),
        "attrs": F.coalesce("attrs", F.lit("{}")),
        "tenant": F.coalesce("tenant", F.lit(DEFAULT_TENANT)),
    }
    return opened.select(
        *keep,
        F.when(~accepted, F.coalesce(F.to_json("_item"), "_payload")).alias("raw"),
        "reason",
        # a rejected row has no event: blank columns instead of half-parsed values
        *[F.when(accepted, value).alias(c) for c, value in event.items()],
    )


def structured(
    df: DataFrame,
    payload: str = "payload",
    ingest_time: Column | None = None,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected rows with a reason)."""
    checked = check_payloads(df, payload, ingest_time, keep)
    accepted = checked.where("reason is null").select(*keep, *LOG_COLUMNS)
    rejected = checked.where("reason is not null").select(*keep, "raw", "reason")
    return accepted, rejected


def fits(c: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    return F.octet_length(c) <= max_bytes


def oversize_split(df: DataFrame, body: str, max_bytes: int = MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(bodies within the limit, the others with a reason). A null body has no bytes and is within."""
    within = F.coalesce(fits(F.col(body), max_bytes), F.lit(True))
    return df.where(within), df.where(~within).withColumn("reason", F.lit("too_large"))


def fill_defaults(df: DataFrame, ingest_time: Column) -> DataFrame:
    """Log columns with the schema defaults where a value is missing."""
    return df.withColumns(
        {
            "timestamp": F.coalesce("timestamp", ingest_time),
            "level": normalize_level(F.coalesce("level", F.lit(""))),
            "service": F.coalesce("service", F.lit(DEFAULT_SERVICE)),
            "attrs": F.coalesce("attrs", F.lit("{}")),
            "tenant": F.coalesce("tenant", F.lit(DEFAULT_TENANT)),
        }
    )
