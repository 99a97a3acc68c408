"""The alert stream: rules over events as they come, with no group per (rule, tenant) in any task.

Event mode counts hits per instant in Spark's own state, which spreads over all tasks, until the watermark has
passed the instant; so a micro-batch brings the final counts of the next stretch of time. They
meet the hits that windows still reach back to and the last fires, both small tables beside the
alerts, and go through the same operators as a batch: sliced running counts, then spacing. Events
later than the watermark are left out here (never in the store), so ``delay`` must cover the
disorder of the source; progress.LateRows counts what it did not cover. Arrival mode takes the time
of the micro-batch for all its events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.alerts import alert_rows, match_rules, rule_table
from loomlog.operators.slices import SLICE_US, counts_within
from loomlog.operators.spaced import spaced
from loomlog.session import pin_utc
from loomlog.streaming.parts import Versions
from loomlog.streaming.sinks import Outbox, append_alerts

_KEYS = ["rule", "tenant"]
_HITS = "rule string, tenant string, us long, hits long"
_FIRED = "rule string, tenant string, us long"
#: Ten minutes: a batch may reach over years with few events a minute, and a group's slices are put in order by one task.
_SLICE_US = 10 * SLICE_US


class AlertState:
    """What the next micro-batch needs of those before it: hits that a window may still reach, and
    last fires whose cooldown may still run. Each batch writes a version of its own, so a
    batch that is run again starts from the same state; old keys are left out of the next version."""

    def __init__(self, spark: SparkSession, path: str):
        self.hits = Versions(spark, f"{path}/hits", _HITS)
        self.fired = Versions(spark, f"{path}/fired", _FIRED)

    def step(self, new: DataFrame, first: int, last: int, rules: DataFrame, batch_id: int) -> DataFrame:
        """(rule, tenant, us) that fire among ``new`` (rule, tenant, us, hits), which reach from ``first`` to
        ``last`` and are later than all before."""
        limits = rule_table(rules).select("rule", "threshold", "window_us", "cooldown_us")
        line = self.hits.before(batch_id).unionByName(new.select(*_KEYS, "us", "hits")).join(limits, "rule")
        # a window reaches back over the boundary at most by its own length
        self.hits.write(line.where(F.col("us") >= last - F.col("window_us")).select(*_KEYS, "us", "hits"), batch_id)
        counted = counts_within(line, _KEYS, "us", "hits", "window_us", _SLICE_US).where(F.col("us") >= first)
        ready = counted.join(limits, "rule").where("n >= threshold")
        earlier = self.fired.before(batch_id).join(limits, "rule")
        columns = [*_KEYS, "us", "cooldown_us"]
        taken = spaced(ready.select(*columns).unionByName(earlier.select(*columns)), _KEYS, "us", "cooldown_us").persist()
        last_fires = taken.groupBy(*_KEYS).agg(F.max("us").alias("us")).join(limits, "rule")
        self.fired.write(last_fires.where(F.col("us") + F.col("cooldown_us") > last).select(*_KEYS, "us"), batch_id)
        return taken.where(F.col("us") >= first)


def hit_stream(events: DataFrame, rules: DataFrame, time_mode: str = "event", delay: str = "10 seconds") -> DataFrame:
    """(rule, tenant, us, hits) of every instant with a match, once it is final. Give time_mode "event" or "arrival".

    The state has a cell per (rule, tenant, instant) that the watermark has not passed; cells are dealt by
    all three, so a hot tenant is spread.
    """
    by_event = {"event": True, "arrival": False}[time_mode]
    slim = events.select("timestamp", "tenant", "level", "service")
    if not by_event:
        us = F.unix_micros(F.current_timestamp()).alias("us")
        return match_rules(slim, rules).select(*_KEYS, us, F.lit(1).cast("long").alias("hits"))
    matched = match_rules(slim.withWatermark("timestamp", delay), rules)
    counted = matched.groupBy(*_KEYS, "timestamp").agg(F.count("*").alias("hits"))
    return counted.select(*_KEYS, F.unix_micros("timestamp").alias("us"), "hits")


def alert_stream(
    events: DataFrame,
    rules: DataFrame,
    path: str,
    checkpoint: str,
    notifications: str | None = None,
    time_mode: str = "event",
    delay: str = "10 seconds",
    once: bool = False,
    every: str = "1 second",
    send: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Alerts into a table, each once, and a notification for each: written below
    ``notifications``, or handed to ``send``. With ``send``, ``notifications`` (by default beside the checkpoint) is an
    outbox: a batch whose send fails stays in it and is tried again with the batches after it.

    The state lies below ``checkpoint`` and belongs to it.
    """
    spark = events.sparkSession
    pin_utc(spark)
    rules = rule_table(rules)

    def store(hits: DataFrame, batch_id: int) -> None:
        own = hits.sparkSession  # the batch's own session
        if time_mode == "arrival":
            hits = hits.groupBy(*_KEYS, "us").agg(F.sum("hits").alias("hits"))
        hits = hits.persist()  # looked at for the boundary, the counts and the state
        box = outbox(own, checkpoint, notifications) if notifications or send else None
        try:
            first, last = hits.agg(F.min("us"), F.max("us")).first()
            if last is not None:
                fired = AlertState(own, f"{checkpoint}-state").step(hits, first, last, rules, batch_id)
                alerts = alert_rows(fired, rules).persist()
                if box:
                    box.put(alerts, batch_id)  # first, so that no stored alert lacks its notification
                append_alerts(alerts, path)
                alerts.unpersist()
            if send:
                box.deliver(send)
        finally:
            hits.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        hit_stream(events, rules, time_mode, delay)
        .writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def alert_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """The hits and the last fires that an alert stream remembers now."""
    state = AlertState(spark, f"{checkpoint}-state")
    return state.hits.last(), state.fired.last()


def outbox(spark: SparkSession, checkpoint: str, path: str | None = None) -> Outbox:
    """The notifications of an alert stream that wait to be sent."""
    return Outbox(spark, path or f"{checkpoint}-outbox")
