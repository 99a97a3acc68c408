"""Counts kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.metrics import tumbling_rate
from loomlog.operators.stats import cell_counts, stats_from_cells
from loomlog.streaming.parts import Parts

_CELLS = ["tenant", "level", "service"]


def _latest(parts: DataFrame) -> DataFrame:
    """Of each cell the count of the latest batch that changed it."""
    last = F.max(F.struct("batch", "n")).alias("_last")
    return parts.groupBy(*_CELLS).agg(last).select(*_CELLS, "_last.n", "_last.batch")


def _cells(spark: SparkSession, path: str, every: int = 100) -> Parts:
    return Parts(spark, path, "tenant string, level string, service string, n long, batch long", _latest, every)


def live_cells(
    events: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "2 seconds", roll_up: int = 100
) -> StreamingQuery:
    """Keep (tenant, level, service, n). The state is one counter per cell; each micro-batch is summed per
    task first and writes only the cells that it changed. Parts are rolled up, so
    that at most about two times ``roll_up`` of them and two roll-ups are there."""

    def store(df: DataFrame, i: int) -> None:
        _cells(df.sparkSession, path, roll_up).write(df.select(*_CELLS, "n", F.lit(i).cast("long").alias("batch")), i)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        cell_counts(events)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_live_stats(spark: SparkSession, path: str) -> DataFrame:
    """The stats of all batches written so far."""
    return stats_from_cells(_cells(spark, path).read().select(*_CELLS, "n"))


def _rates(spark: SparkSession, path: str, keys: tuple[str, ...], every: int = 100) -> Parts:
    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys, "window").agg(F.sum("n").alias("n"))

    schema = "".join(f"`{k}` string, " for k in keys) + "window struct<start:timestamp,end:timestamp>, n long"
    return Parts(spark, path, schema, summed, every)


def rate_table(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: str,
    keys: tuple[str, ...] = ("tenant",),
    once: bool = False,
    every: str = "10 seconds",
    roll_up: int = 100,
) -> StreamingQuery:
    """Events per interval, complete in whatever order they come. Keys are strings.

    Every micro-batch adds its own counts, in a folder that a replay of it writes over. There is no
    state and no watermark, so no event is ever too late; ``read_rate`` sums the parts. Parts are
    rolled up, so that at most about two times ``roll_up`` of them and two roll-ups are there.
    """

    def store(df: DataFrame, i: int) -> None:
        _rates(df.sparkSession, path, keys, roll_up).write(tumbling_rate(df, "timestamp", width, list(keys)), i)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_rate(spark: SparkSession, path: str, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """The counts of a rate table so far: keys, window, n."""
    return _rates(spark, path, keys).read()


def rate_stream(events: DataFrame, width: str, delay: str, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Events per interval, final once the watermark has passed the interval; later events are left out
    (``progress`` counts them). Where all must count, take ``rate_table``."""
    return tumbling_rate(events.withWatermark("timestamp", delay), "timestamp", width, list(keys))
