"""Running folds over long ordered groups.

A window partitioned by tenant puts a tenant into one task, and one tenant may hold a third
of all rows. Here a group is cut into slices of its order column. Each slice is folded on
its own, slices are folded among themselves (one row per slice), and the two are put
together. The largest unit of work is one slice, never one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices of a minute hold at most 60 million distinct microseconds, however hot the key.
SLICE_US = 60_000_000


def slice_of(c: Column, width: float = SLICE_US) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def running(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    value: Column,
    out: str,
    fold: Callable[[Column], Column] = F.sum,
    inclusive: bool = True,
) -> DataFrame:
    """Adds ``out``: the fold of ``value`` over the group's rows up to each row, in order.

    ``fold`` is F.sum or F.max (of a struct: the latest row). ``order`` must be total within
    a slice. ``inclusive=False`` leaves the row itself out; NULL where nothing precedes.
    """
    df = df.withColumn("_value", value)
    # the slice number first: rows are then mostly put in order by one long, not by key text
    cell = [slice_col, *keys]
    at = Window.partitionBy(*cell).orderBy(*order)
    upto = at.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = df.withColumn("_inside", fold(F.col("_value")).over(upto))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*cell)
        .agg(fold(F.col("_value")).alias("_total"))
        .select(*cell, fold(F.col("_total")).over(earlier).alias("_before"))
    )
    a, b = F.col("_before"), F.col("_inside")
    both = a + b if fold is F.sum else F.greatest(a, b)
    joined = inside.join(before, cell)
    return joined.withColumn(out, F.coalesce(both, a, b)).drop("_value", "_inside", "_before")


def counts_within(points: DataFrame, keys: list[str], at: str, weight: str, reach: str, width: int = SLICE_US) -> DataFrame:
    """For each point: ``n``, the weight in [at - reach, at]. (keys, at) must be unique, and
    ``reach`` is one value per group.

    A weight enters at its time and leaves after the last time that still reaches back to it, so the
    running sum is the count itself: each row moves once, where the bounds of ``counts_at``
    must find back to their points. What would leave after all time never does.
    """
    steps = F.array(
        F.struct(F.col(at).alias("pos"), F.lit(0).alias("kind"), F.col(weight).cast("long").alias("w")),
        # kind 1 sorts after a point at the same time, so that one still counts it
        F.struct(F.try_add(at, reach).alias("pos"), F.lit(1).alias("kind"), (-F.col(weight).cast("long")).alias("w")),
    )
    rows = points.select(*keys, F.explode(steps).alias("_e")).select(*keys, "_e.*").where("pos is not null")
    summed = running(rows.withColumn("_slice", slice_of(F.col("pos"), width)), keys, "_slice", ["pos", "kind"], F.col("w"), "n")
    return summed.where("kind = 0").select(*keys, F.col("pos").alias(at), "n")


def counts_at(
    points: DataFrame,
    keys: list[str],
    at: str,
    weight: str,
    probe: Column,
    width: int = SLICE_US,
) -> DataFrame:
    """For each point: ``upto``, the weight at or before it, and ``below``, the weight
    strictly before its ``probe`` time. (keys, at) must be unique.

    With these two numbers a count over any time range is a subtraction, and the bound may
    differ from row to row, which a window frame cannot do.
    """
    rows = points.select(
        *keys,
        F.col(at).alias("_owner"),
        F.explode(
            F.array(
                F.struct(F.col(at).alias("pos"), F.lit(1).alias("kind"), F.col(weight).cast("long").alias("w")),
                # kind 0 sorts before a point at the same time, so that one is not counted
                F.struct(probe.cast("long").alias("pos"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("w")),
            )
        ).alias("_e"),
    ).select(*keys, "_owner", "_e.pos", "_e.kind", "_e.w", slice_of(F.col("_e.pos"), width).alias("_slice"))
    # two probes may meet only if their owners do, and owners are unique: _owner makes the order total
    summed = running(rows, keys, "_slice", ["pos", "kind", "_owner"], F.col("w"), "_sum")
    return (
        summed.groupBy(*keys, F.col("_owner").alias(at))
        .agg(
            F.max(F.when(F.col("kind") == 1, F.col("_sum"))).alias("upto"),
            F.max(F.when(F.col("kind") == 0, F.col("_sum"))).alias("below"),
        )
    )
