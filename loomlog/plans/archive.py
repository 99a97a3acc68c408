"""Retention of a store by day, with an archive of gzipped JSON lines per tenant-day."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.events import JSON_WRITE, wire_columns
from loomlog.functions.ids import day_of
from loomlog.functions.text import blank
from loomlog.operators.retention import first_day_kept
from loomlog.plans.store import LogStore, WriteResult, dedupe, store_rows
from loomlog.schema import LOG_COLUMNS, LOG_SCHEMA
from loomlog.session import path_exists, pin_utc

_FILE_SCHEMA = T.StructType(
    [f for f in LOG_SCHEMA.fields if f.name != "tenant"]
    + [T.StructField("tenant", T.StringType()), T.StructField("day", T.DateType())]
)


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        pin_utc(spark)
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, tenant: str | None = None, day: date | None = None) -> DataFrame:
        """Archived events (log columns and day)."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], _FILE_SCHEMA)
        rows = self.spark.read.schema(_FILE_SCHEMA).json(self.path, mode="FAILFAST")
        if tenant is not None:
            rows = rows.where(F.col("tenant") == tenant)
        if day is not None:
            rows = rows.where(F.col("day") == F.lit(day))
        return rows

    def add(self, logs: DataFrame) -> None:
        """Archive events. A day that is archived already gains only what it lacks, so late
        events join the earlier ones instead of replacing them."""
        rows = dedupe(store_rows(logs))
        if path_exists(self.spark, self.path):
            first, last = rows.agg(F.min("day"), F.max("day")).first()
            known = store_rows(self.read().where(F.col("day").between(F.lit(first), F.lit(last)))).select("doc_id")
            rows = rows.join(known, "doc_id", "left_anti")
        (
            rows.select(*wire_columns(), "day")
            # gzip files cannot be split by readers, so large days are split here
            .hint("rebalance", "tenant", "day")
            .write.mode("append")
            .partitionBy("tenant", "day")
            .options(compression="gzip", **JSON_WRITE)
            .json(self.path)
        )

    def missing(self, logs: DataFrame, until: date | None = None) -> DataFrame:
        """Those of the given events (none of a day after ``until``) that the archive lacks."""
        held = self.read() if until is None else self.read().where(F.col("day") <= F.lit(until))
        held = store_rows(held).select("doc_id")
        return store_rows(logs).join(held, "doc_id", "left_anti")


def expire_days(store: LogStore, as_of: datetime, days: int, archive: Archive | None = None) -> int:
    """Drop the tenant-days that are too old and return how many went.

    The files of one listing are archived, checked to be in the archive, and deleted; an event that is
    appended to an old day meanwhile lies in another file and stays for the next run. A run that stops
    in between is simply run again.
    """
    first_kept = first_day_kept(as_of, days)
    files = store.files(before=first_kept)
    if not files:
        return 0
    if archive is not None:
        expired = store.read_files(files)
        archive.add(expired)
        if not archive.missing(expired, first_kept).isEmpty():
            raise RuntimeError("the archive lacks expired events; nothing was deleted")
    return store.drop_files(files)


def restore(
    archive: Archive, into: LogStore, tenant: str | None = None, day: date | None = None
) -> WriteResult:
    """Bring an archived tenant-day back, or all of a tenant or day left open. Restoring
    twice adds nothing.

    ``into`` is best a table of its own: in the live one the next retention run would expire
    the day again.
    """
    return into.write(archive.read(tenant, day).select(*LOG_COLUMNS))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log columns from gzipped or plain JSON lines outside the partitioned layout."""
    lines = spark.read.text(path).where(~blank(F.col("value")))
    event = F.from_json("value", LOG_SCHEMA, {"mode": "FAILFAST"})
    return lines.select(event.alias("_e")).select("_e.*").withColumn("day", day_of(F.col("timestamp")))
