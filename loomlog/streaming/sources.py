"""Stream sources: a broker topic, a directory of wire events, a directory of log text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.schema import LOG_SCHEMA
from loomlog.sources import growing
from loomlog.sources.raw import parse_lines


def decode_events(wire: DataFrame, value: str = "value", keep_raw: bool = False) -> DataFrame:
    """Wire text to log columns. attrs keeps its JSON text.

    With ``keep_raw``, what does not decode stays as a row of nulls, and ``raw`` holds the text of
    every row, for the indexing stream to dead-letter; otherwise ``undecodable`` tells what is left out.
    """
    text = F.col(value).cast("string")
    event = F.from_json(text, LOG_SCHEMA)
    if keep_raw:
        return wire.select(event.alias("_e"), text.alias("raw")).select("_e.*", "raw")
    return wire.select(event.alias("_e")).select("_e.*").where("message is not null")


def undecodable(wire: DataFrame, value: str = "value") -> DataFrame:
    """(raw, reason) of the wire rows that decode_events leaves out."""
    return (
        decode_events(wire, value, keep_raw=True)
        .where("message is null")
        .select("raw", F.lit("undecodable").alias("reason"))
    )


def topic(
    spark: SparkSession,
    servers: str,
    name: str = "logs",
    max_per_batch: int = 500_000,
    keep_raw: bool = False,
    **options: str,
) -> DataFrame:
    """Events of a broker topic from its first offset; needs Spark's Kafka package.

    ``max_per_batch`` bounds a micro-batch. That is the backpressure: what does not fit waits
    in the topic and nothing is refused.
    """
    wire = (
        spark.readStream.format("kafka")
        .options(
            **{
                "kafka.bootstrap.servers": servers,
                "subscribe": name,
                "startingOffsets": "earliest",
                "maxOffsetsPerTrigger": str(max_per_batch),
                **options,
            }
        )
        .load()
    )
    return decode_events(wire, keep_raw=keep_raw)


def event_files(spark: SparkSession, path: str, max_files: int = 100, keep_raw: bool = False) -> DataFrame:
    """Events from a directory of wire text, as publish() writes it."""
    return decode_events(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), keep_raw=keep_raw)


def tail(
    spark: SparkSession,
    path: str,
    service: str = "shipper",
    started: datetime | None = None,
    max_files: int = 100,
    tenant: Column | None = None,
) -> DataFrame:
    """Events from log files as they appear in a directory. With ``started``, only files
    modified since. A file must be complete when it appears (written elsewhere, then moved); for
    files that grow there is ``follow``."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    if started is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(started))
    return parse_lines(lines, service=service, tenant=tenant)


def follow(
    spark: SparkSession,
    path: str,
    service: str = "shipper",
    from_end: bool = False,
    pattern: str = "*",
    tenant: Column | None = None,
    split_bytes: int = growing.SPLIT_BYTES,
) -> DataFrame:
    """Events from log files below ``path`` that are still being written: every line once, when it
    has its line end, after a restart too. With ``from_end`` only lines that end after the start of the
    stream; files that come later count from their beginning, as does a file that has become shorter. A
    file that was replaced by a longer one under its name is taken as grown. All workers must reach ``path``."""
    growing.register(spark)
    options = {"path": path, "pattern": pattern, "from_end": str(from_end).lower(), "split_bytes": str(split_bytes)}
    return parse_lines(spark.readStream.format(growing.FORMAT).options(**options).load(), service=service, tenant=tenant)
