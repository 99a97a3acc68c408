"""Retention as a job of its own: a stream of ticks, each of which expires what is too old by then."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.plans.archive import Archive, expire_days
from loomlog.plans.merges import compact
from loomlog.plans.store import LogStore
from loomlog.session import path_exists, pin_utc

RUNS = "batch_id long, as_of timestamp, dropped_days long, merged_files long"


def clock(spark: SparkSession) -> DataFrame:
    """Ticks of the clock; how often a run comes is the trigger's choice."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().select("timestamp")


def retention_stream(
    ticks: DataFrame,
    store: LogStore,
    days: int,
    runs: str,
    checkpoint: str,
    archive: Archive | None = None,
    merge: bool = False,
    every: str = "1 hour",
    once: bool = False,
) -> StreamingQuery:
    """Expire tenant-days as of the last tick of each micro-batch, and with ``merge`` also merge small files.

    Each run is noted below ``runs``. The checkpoint remembers the ticks, so a restart leaves none
    out; a run that was noted is not made again, and one that stopped half way is.
    """
    pin_utc(ticks.sparkSession)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        as_of = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        noted = f"{runs}/batch={batch_id}"
        if as_of is None or path_exists(spark, f"{noted}/_SUCCESS"):
            return
        dropped = expire_days(store, _instant(as_of), days, archive)
        merged = compact(store) if merge else 0
        row = spark.range(1).select(
            F.lit(batch_id).cast("long").alias("batch_id"), F.timestamp_micros(F.lit(as_of)).alias("as_of"),
            F.lit(dropped).cast("long").alias("dropped_days"), F.lit(merged).cast("long").alias("merged_files"),
        )
        row.coalesce(1).write.mode("overwrite").json(noted)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _instant(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def read_runs(spark: SparkSession, runs: str) -> DataFrame:
    return spark.read.schema(RUNS).json(f"{runs}/batch=*")
