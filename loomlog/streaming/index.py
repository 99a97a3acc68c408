"""The indexing stream: events into the store, what cannot be stored into the dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from loomlog.functions.events import encode_event
from loomlog.plans.store import LogStore
from loomlog.streaming.sinks import dead_letter, read_dead_letters
from loomlog.streaming.sources import decode_events

ATTEMPTS = 3


def index_batch(
    store: LogStore,
    batch: DataFrame,
    batch_id: int,
    dead_letters: str | None = None,
    attempts: int = ATTEMPTS,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Store one micro-batch and return how many events were new.

    Events without a timestamp or message cannot be stored and are dead-lettered alone, with
    their text as it came if the source kept it (column ``raw``). If
    the write keeps failing, the whole batch is dead-lettered, or, without a place for dead
    letters, the error stops the stream and the batch comes again.
    """
    storable = F.col("timestamp").isNotNull() & F.col("message").isNotNull()
    raw = F.coalesce(F.col("raw"), encode_event()) if "raw" in batch.columns else encode_event()
    batch = batch.persist()  # looked at up to three times
    try:
        bad = batch.where(~storable)
        if dead_letters and not bad.isEmpty():
            reason = F.when(F.col("timestamp").isNull() & F.col("message").isNull(), "undecodable").otherwise("incomplete")
            dead_letter(bad.select(raw.alias("raw"), reason.alias("reason")), dead_letters, batch_id, "incomplete")
        for attempt in range(1, attempts + 1):
            try:
                return store.write(batch.where(storable)).new
            except Exception:
                if attempt < attempts:
                    sleep(2.0 ** (attempt - 1))
                elif dead_letters is None:
                    raise
        rest = batch.where(storable).select(encode_event().alias("raw"), F.lit("write_failed").alias("reason"))
        dead_letter(rest, dead_letters, batch_id, "write_failed")
        return 0
    finally:
        batch.unpersist()


def replay_dead_letters(store: LogStore, dead_letters: str) -> int:
    """Store the dead letters that failed only because the store did; how many events were new.

    Content ids make a second replay harmless, so the letters can stay where they are.
    """
    letters = read_dead_letters(store.spark, dead_letters).where("reason = 'write_failed'")
    return store.write(decode_events(letters, "raw")).new


def index_stream(
    events: DataFrame,
    store: LogStore,
    checkpoint: str,
    dead_letters: str | None = None,
    once: bool = False,
    every: str = "1 second",
) -> StreamingQuery:
    """Offsets are committed after a batch is stored; together with content ids each event
    ends up in the store once, also when a batch is replayed."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        events.writeStream.foreachBatch(lambda df, i: index_batch(store, df, i, dead_letters))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops copies that arrive within ``delay`` of each other; needs a doc_id column.

    The watermark is on the time of arrival, which never goes back: whatever the age of an event
    and the order of the files, its first copy is passed on.
    """
    return (
        events.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(["doc_id"])
        .drop("_arrived")
    )
