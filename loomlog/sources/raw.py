"""Raw text: bodies to lines, lines to events. A line is never refused for its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.events import open_events
from loomlog.functions.text import blank, level_word, lines, normalize_level, strip
from loomlog.schema import DEFAULT_SERVICE, DEFAULT_TENANT


def split_bodies(df: DataFrame, body: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, pos, value): the non-blank lines of each body, with their place in it."""
    valid = df.select(*keep, F.make_valid_utf8(F.col(body)).alias("_body"))
    return (
        valid.select(*keep, F.posexplode(lines(F.col("_body"))).alias("pos", "value"))
        .where(~blank(F.col("value")))
    )


def parse_lines(
    df: DataFrame,
    line: str = "value",
    service: str | Column = DEFAULT_SERVICE,
    ingest_time: Column | None = None,
    tenant: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log columns of every non-blank line.

    A JSON object with a message is taken as an event; anything else becomes a text event
    that keeps the whole stripped line, its level found by keyword. ``tenant`` overrides
    whatever tenant the line claims.
    """
    now = F.current_timestamp() if ingest_time is None else ingest_time
    fallback = F.lit(service) if isinstance(service, str) else service
    text = strip(F.col(line))
    staged = df.where(text != "").select(
        *keep,
        text.alias("_text"),
        now.alias("_now"),
        fallback.alias("_service"),
        (F.lit(DEFAULT_TENANT) if tenant is None else tenant).alias("_tenant"),
        # plain lines skip the JSON parser altogether
        F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text)).alias("_v"),
    )
    opened = open_events(staged, "_v", [*keep, "_text", "_now", "_service", "_tenant"], empty_message_ok=False)
    is_json = F.col("reason").isNull()
    word = F.when(is_json, F.coalesce("level", F.lit(""))).otherwise(level_word(F.col("_text")))
    claimed = F.coalesce("tenant", "_tenant") if tenant is None else F.col("_tenant")
    return opened.select(
        *keep,
        F.when(is_json, F.coalesce("timestamp", "_now")).otherwise(F.col("_now")).alias("timestamp"),
        normalize_level(word).alias("level"),
        F.when(is_json, F.coalesce("service", "_service")).otherwise(F.col("_service")).alias("service"),
        F.when(is_json, F.col("message")).otherwise(F.col("_text")).alias("message"),
        F.when(is_json, F.coalesce("attrs", F.lit("{}"))).otherwise(F.lit("{}")).alias("attrs"),
        F.when(is_json, claimed).otherwise(F.col("_tenant")).alias("tenant"),
    )
