"""Credentials to tenants, tenant names, per-key rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.slices import SLICE_US, running, slice_of
from loomlog.operators.spaced import FOLD_MAX, spaced
from loomlog.schema import DEFAULT_TENANT
from loomlog.session import broadcast_if_small

_NAME = r"^[a-z0-9][a-z0-9_-]{0,63}\z"


def valid_tenant(c: Column) -> Column:
    return F.coalesce(c.rlike(_NAME), F.lit(False))


def stamp_tenant(df: DataFrame, tenant: Column) -> DataFrame:
    """The credential's tenant replaces whatever the client wrote."""
    return df.withColumn("tenant", tenant)


def resolve(requests: DataFrame, credentials: DataFrame | None) -> DataFrame:
    """Adds ``tenant`` and ``reason`` (NULL if let in). Without credentials all is ``default``.

    One key may send a third of the requests; the small side is broadcast if its size allows,
    else the join is left to Spark, which splits skewed partitions of the left side.
    """
    if credentials is None:
        return requests.withColumns({"tenant": F.lit(DEFAULT_TENANT), "reason": F.lit(None).cast("string")})
    known = broadcast_if_small(credentials.select("api_key", "tenant"))
    return requests.drop("tenant").join(known, "api_key", "left").withColumn(
        "reason",
        F.when(F.coalesce("api_key", F.lit("")) == "", "missing_credential")
        .when(F.col("tenant").isNull(), "unknown_credential")
        .when(~valid_tenant(F.col("tenant")), "invalid_tenant"),
    )


def rate_limit(
    hits: DataFrame,
    key: str,
    at: str,
    seq: str,
    limit: int,
    window_us: int,
    fold_max: int = FOLD_MAX,
    width: int = SLICE_US,
) -> DataFrame:
    """Adds ``allowed``: whether a hit is among the first ``limit`` of its window.

    A key's window opens at its first hit and the next one at the first hit a window later,
    so windows are anchored at hits and not at the clock. ``seq`` orders hits of one instant.
    Hits of one instant are counted first; they are numbered only where the limit falls among them.
    """
    counts = hits.groupBy(key, at).agg(F.count("*").alias("_n"))
    points = counts.select(key, at, F.lit(window_us).cast("long").alias("_gap"))
    opens = spaced(points, [key], at, "_gap", fold_max, width).withColumn("_open", F.lit(True))
    marked = counts.join(opens, [key, at], "left").withColumn("_slice", slice_of(F.col(at), width))
    summed = running(marked, [key], "_slice", [at], F.col("_n"), "_upto")
    # how many hits precede the instant that opened the window
    first = F.when(F.col("_open"), F.struct(F.col(at).alias("at"), (F.col("_n") - F.col("_upto")).alias("neg")))
    placed = running(summed, [key], "_slice", [at], first, "_window", fold=F.max)
    left = F.lit(limit) - (F.col("_upto") - F.col("_n") + F.col("_window.neg"))
    told = hits.join(placed.select(key, at, "_n", left.alias("_left")), [key, at])
    within = F.col("_left").between(1, F.col("_n") - 1)
    whole = told.where(~within).withColumn("allowed", F.col("_left") >= F.col("_n"))
    place = F.row_number().over(Window.partitionBy(key, at).orderBy(seq))
    cut = told.where(within).withColumn("allowed", place <= F.col("_left"))
    return whole.unionByName(cut).drop("_n", "_left")
