"""Sinks that may be handed the same micro-batch twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.events import encode_event
from loomlog.operators.alerts import ALERT_COLUMNS, alert_id, notification
from loomlog.schema import ALERT_SCHEMA
from loomlog.session import folders, path_exists, remove_folder

_ALERT_TABLE = T.StructType([*ALERT_SCHEMA.fields, T.StructField("alert_id", T.StringType())])


def publish(logs: DataFrame, target: str, fmt: str = "text", **options: str) -> None:
    """Write events as wire text: to a directory, or with fmt="kafka" to topic ``target``."""
    wire = logs.select(encode_event().alias("value"))
    if fmt == "kafka":
        wire.write.format("kafka").options(topic=target, **options).save()
    else:
        wire.write.mode("append").format(fmt).options(**options).save(target)


def dead_letter(rejected: DataFrame, path: str, batch_id: int, part: str = "rejected") -> None:
    """(raw, reason) of one batch as JSON lines, in a folder of its own that a replay of the
    batch writes over."""
    (
        rejected.select("raw", "reason", F.lit(batch_id).cast("long").alias("batch_id"))
        .write.mode("overwrite")
        .json(f"{path}/batch={batch_id}-{part}")
    )


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("raw string, reason string, batch_id bigint").json(f"{path}/batch=*")


def append_alerts(alerts: DataFrame, path: str) -> DataFrame:
    """Append the alerts the table lacks, by id, and return all alerts with their id. The table
    is partitioned by day; only the days of the given alerts are read."""
    spark = alerts.sparkSession
    day = F.to_date("timestamp").alias("day")
    rows = alerts.select(*ALERT_COLUMNS, alert_id().alias("alert_id"), day).dropDuplicates(["alert_id"])
    if path_exists(spark, path):
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return read_alerts(spark, path)
        held = _stored_alerts(spark, path).where(F.col("day").between(F.lit(first), F.lit(last))).select("alert_id")
        rows = rows.join(held, "alert_id", "left_anti").select(*rows.columns)
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)
    return read_alerts(spark, path)


def _stored_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*_ALERT_TABLE.fields, T.StructField("day", T.DateType())])).parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return _stored_alerts(spark, path).drop("day")


class Outbox:
    """Notifications that wait to be sent, in a folder per micro-batch.

    A folder goes once ``send`` has taken its texts, so a failed send is tried again and what waits
    is all that is ever read. If a job ends between the sending and the removal, or a micro-batch
    that was delivered is run again, its texts are sent a second time: each at least once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, alerts: DataFrame, batch_id: int) -> None:
        """One text per alert; a replay of the batch writes over its folder."""
        alerts.select(notification().alias("text")).write.mode("overwrite").text(f"{self.path}/batch={batch_id}")

    def waiting(self) -> list[int]:
        return sorted(int(f.split("=")[1]) for f in folders(self.spark, self.path, "batch=*/_SUCCESS"))

    def read(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema("text string").text(f"{self.path}/batch={batch_id}")

    def deliver(self, send: Callable[[DataFrame], None]) -> int:
        """Hand what waits to ``send``, oldest first, and return how many batches were taken. A failing ``send``
        does not stop the stream; its batch and those after it wait, so the order is kept."""
        taken = 0
        for batch_id in self.waiting():
            try:
                send(self.read(batch_id))
            except Exception as exc:
                print(f"notifications of batch {batch_id} wait: {exc}")
                break
            remove_folder(self.spark, f"{self.path}/batch={batch_id}")
            taken += 1
        return taken
