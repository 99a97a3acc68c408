"""JSON to event columns and back. Types are checked, never coerced: 5 is not a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.times import from_epoch, parse_ts
from loomlog.schema import LOG_COLUMNS

_TEXTS = ["level", "service", "message", "tenant"]
_OPENED = "struct<" + ",".join(f"{name}:variant" for name in LOG_COLUMNS) + ">"


def open_events(df: DataFrame, v: str, keep: list[str], empty_message_ok: bool) -> DataFrame:
    """(keep…, reason, the log columns as found in the VARIANT column ``v``).

    ``reason`` names the first thing that breaks the event schema and is NULL for a valid
    event; a column is NULL where the event lacks it. Done in steps, each a projection of its
    own, so that no value is taken out of the VARIANT twice.
    """
    # one pass over the object; NULL if it is none. A field is NULL if absent, VOID if null
    opened = df.select(*keep, F.col(v).isNull().alias("_none"), F.try_variant_get(v, "$", _OPENED).alias("_x"))
    taken = opened.select(
        *keep,
        "_none",
        F.col("_x").isNull().alias("_other"),
        *[F.schema_of_variant(f"_x.{c}").alias(f"_kind_{c}") for c in [*_TEXTS, "timestamp"]],
        *[F.try_variant_get(f"_x.{c}", "$", "string").alias(c) for c in _TEXTS],
        F.to_json("_x.attrs").alias("attrs"),
        F.try_variant_get("_x.timestamp", "$", "string").alias("_time_text"),
        F.try_variant_get("_x.timestamp", "$", "decimal(38,9)").alias("_time_number"),
    )
    number = F.col("_time_number")
    when = F.when(F.col("_kind_timestamp") == "BOOLEAN", None).otherwise(
        F.when(number.isNotNull(), from_epoch(number)).otherwise(parse_ts(F.col("_time_text")))
    )
    timed = taken.withColumn("timestamp", when)
    return timed.select(*keep, _reason(empty_message_ok).alias("reason"), *LOG_COLUMNS)


def _reason(empty_message_ok: bool) -> Column:
    message = F.coalesce(F.col("_kind_message") == "STRING", F.lit(False))
    if not empty_message_ok:
        message = message & (F.col("message") != "")
    reason = F.when(F.col("_none"), "not_json").when(F.col("_other"), "not_an_object").when(~message, "message")
    for c in ("level", "service", "tenant"):
        reason = reason.when(F.col(f"_kind_{c}") != "STRING", c)
    return reason.when(~F.startswith("attrs", F.lit("{")), "attrs").when(
        F.col("_kind_timestamp").isNotNull() & F.col("timestamp").isNull(), "timestamp"
    )


# JSON writers print milliseconds unless told otherwise.
JSON_WRITE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def wire_columns() -> list[Column]:
    """The log columns with attrs opened into a nested object, ready for a JSON writer."""
    return [
        F.col("timestamp"),
        F.col("level"),
        F.col("service"),
        F.col("message"),
        F.try_parse_json("attrs").alias("attrs"),
        F.col("tenant"),
    ]


def encode_event() -> Column:
    return F.to_json(F.struct(*wire_columns()), JSON_WRITE)


def attr(c: Column, key: str, kind: str = "string") -> Column:
    """One attribute, NULL if absent or of another type."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{key}", kind)
