"""Greedy spacing: take the first time of a group, then always the first one at least a gap
later. Cooldowns and first-hit-anchored rate windows are both this.

The choice is sequential, but only within a group. Groups that fit an array are folded where
they are. A larger group is never gathered: it is cut into chunks of whole gaps. What was taken before a
chunk can only matter in its first gap, so a chunk is known by where it is left for each time there. A
walk over these few times tells where every chunk is entered, and each chunk is walked on its own.

Where even these times are too many for an array, they become ranks, each rank points to the rank that would
follow it, and the pointers are doubled (1, 2, 4, … steps) by joins on evenly spread keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.operators.slices import SLICE_US, counts_at, running, slice_of
from loomlog.session import broadcast_if_small, checkpointed

FOLD_MAX = 1_000_000  # times of one group in an array: 8 MB
TAKEN_MAX = 20_000  # times taken of one group, as the fold copies its result at each take
CHUNK_MAX = 500_000  # times of one chunk, from which on it ends; at most twice as many are in one task


def spaced(
    points: DataFrame,
    keys: list[str],
    at: str,
    gap: str,
    fold_max: int = FOLD_MAX,
    width: int = SLICE_US,
    chunk_max: int = CHUNK_MAX,
) -> DataFrame:
    """The (keys, at) that are taken. ``gap`` is one value per group; (keys, at) is unique."""
    points = checkpointed(points.select(*keys, at, F.greatest(F.col(gap), F.lit(1)).alias("_gap")))
    taken = F.least(F.count("*"), F.floor((F.max(at) - F.min(at)) / F.max("_gap")) + 1)
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"), taken.alias("taken"))
    large = sizes.where((F.col("n") > fold_max) | (F.col("taken") > TAKEN_MAX)).select(*keys)
    if large.isEmpty():
        return _fold(points, keys, at)
    large = broadcast_if_small(checkpointed(large))
    gathered = _fold(points.join(large, keys, "left_anti"), keys, at)
    return gathered.unionByName(_chunked(points.join(large, keys, "left_semi"), keys, at, fold_max, width, chunk_max))


def _fold(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    def take(state, t):
        free = state["last"].isNull() | (t - state["last"] >= F.col("_gap"))
        return F.struct(
            F.when(free, t).otherwise(state["last"]).alias("last"),
            F.when(free, F.concat(state["taken"], F.array(t))).otherwise(state["taken"]).alias("taken"),
        )

    start = F.struct(
        F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("taken")
    )
    return (
        points.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(at)).alias("_times"), F.max("_gap").alias("_gap"))
        .select(*keys, F.explode(F.aggregate("_times", start, take, lambda s: s["taken"])).alias(at))
    )


def _chunked(points: DataFrame, keys: list[str], at: str, fold_max: int, width: int, chunk_max: int) -> DataFrame:
    points = points.withColumn("_cell", F.col(at) - F.pmod(F.col(at), F.col("_gap")))
    dealt = checkpointed(points.join(_chunks(points, keys, width, chunk_max), [*keys, "_cell"]).drop("_cell"))
    # at most one time of a single gap is taken, so its times stand for themselves
    wide, until = dealt.where("_start is not null"), (F.col(at) + F.col("_gap")).alias("_until")
    alone = dealt.where("_start is null").select(*keys, "_start", at, until)
    entries = checkpointed(alone.unionByName(wide.groupBy(*keys, "_start").applyInArrow(_entries(at), alone.schema)))

    large = broadcast_if_small(entries.groupBy(*keys).count().where(F.col("count") > fold_max).select(*keys))
    only = T.StructType(entries.select(*keys, at).schema.fields)
    entered = entries.join(large, keys, "left_anti").withColumn("_entry", F.lit(None).cast("long"))
    entered = entered.groupBy(*keys).applyInArrow(_walk(at, only.names), only)
    if not large.isEmpty():
        entered = entered.unionByName(_doubling(entries.join(large, keys, "left_semi"), keys, at, width))
    entered = checkpointed(entries.join(entered, [*keys, at], "left_semi").select(*keys, "_start", at))

    ways = entered.where("_start is not null").withColumnRenamed(at, "_entry")
    walked = wide.withColumn("_until", until).join(broadcast_if_small(ways), [*keys, "_start"])
    walked = walked.groupBy(*keys, "_start").applyInArrow(_walk(at, only.names), only)
    return entered.where("_start is null").select(*keys, at).unionByName(walked)


def _chunks(points: DataFrame, keys: list[str], width: int, chunk_max: int) -> DataFrame:
    """(keys, _cell, _start): the chunk that each gap with times belongs to, by its first gap; null for a gap that is a
    chunk alone, which one with very many times always is."""
    cells = checkpointed(points.groupBy(*keys, "_cell").agg(F.count("*").alias("n")))  # read twice below
    cells = running(cells.withColumn("_slice", slice_of(F.col("_cell"), width)), keys, "_slice", ["_cell"], F.col("n"), "_upto")
    number = F.floor((F.col("_upto") - F.col("n")) / F.lit(chunk_max))
    cells = cells.withColumns({"_number": number, "_full": F.col("n") > chunk_max})
    chunk = Window.partitionBy(*keys, "_number", "_full")
    start = F.when(F.count("*").over(chunk) > 1, F.min("_cell").over(chunk))
    return broadcast_if_small(checkpointed(cells.select(*keys, "_cell", start.alias("_start"))))


def _entries(at: str) -> Callable[[pa.Table], pa.Table]:
    """Of one chunk: the times that may be the first taken in it (those of its first gap and the one after), each with the
    time from which on the next chunks are free."""

    def find(chunk: pa.Table) -> pa.Table:
        times, gap, start = np.sort(chunk[at].to_numpy()), chunk["_gap"][0].as_py(), chunk["_start"][0].as_py()
        to = np.searchsorted(times, times + gap)
        last = np.where(to < len(times), to, np.arange(len(times)))
        while not np.array_equal(further := last[last], last):
            last = further
        n = min(np.searchsorted(times, start + gap) + 1, len(times))
        found = chunk.drop_columns(["_gap"]).slice(0, n)
        found = found.set_column(found.column_names.index(at), at, pa.array(times[:n]))
        return found.append_column("_until", pa.array(times[last[:n]] + gap))

    return find


def _walk(at: str, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Of one group: the first time from ``_entry`` on (null: of all), then always the first one at which the one before is over."""

    def take(group: pa.Table) -> pa.Table:
        order = np.argsort(group[at].to_numpy())
        times, until = group[at].to_numpy()[order], group["_until"].to_numpy()[order]
        entry = group["_entry"][0].as_py()
        to = np.searchsorted(times, until).tolist()
        taken, i = [], 0 if entry is None else int(np.searchsorted(times, entry))
        while i < len(times):
            taken.append(i)
            i = to[i]
        found = group.select(names).slice(0, len(taken))
        return found.set_column(names.index(at), at, pa.array(times[taken]))

    return take


def _doubling(points: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    ranked = checkpointed(
        counts_at(points.withColumn("_one", F.lit(1)), keys, at, "_one", F.col("_until"), width).select(
            *keys, at, F.col("upto").alias("rank"), (F.col("below") + 1).alias("next")
        )
    )
    exists = ranked.select(*keys, F.col("rank").alias("next"))
    jump = checkpointed(
        ranked.select(*keys, "rank", "next").join(exists, [*keys, "next"], "left_semi")
    )
    # jumps[i] leads 2**i takes ahead. Only ranks that such a jump reaches, and the first
    # rank, are kept for the next round, so the rounds shrink instead of repeating the whole.
    jumps = []
    while not jump.where("rank = 1").isEmpty():
        jumps.append(jump)
        onward = jump.select(*keys, F.col("rank").alias("next"), F.col("next").alias("_after"))
        twice = checkpointed(
            jump.join(onward, [*keys, "next"]).select(*keys, "rank", F.col("_after").alias("next"))
        )
        reached = twice.select(*keys, F.col("next").alias("rank")).distinct()
        jump = checkpointed(
            twice.join(reached, [*keys, "rank"], "left_semi").unionByName(twice.where("rank = 1"))
        )
    taken = ranked.where("rank = 1").select(*keys, "rank")
    for jump in reversed(jumps):
        ahead = taken.join(jump, [*keys, "rank"]).select(*keys, F.col("next").alias("rank"))
        taken = checkpointed(taken.unionByName(ahead))
    return ranked.join(taken, [*keys, "rank"]).select(*keys, at)
