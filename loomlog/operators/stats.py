"""Counts over the log table.

Rows are first counted per (tenant, level, service), with partial sums before the shuffle;
everything else is computed from that small result, so the table is read and shuffled once
and a hot tenant costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.schema import LEVELS

TOP_TERMS = 10
TOP_SERVICES = 5
MIN_BAR = 4.0
ALWAYS_SHOWN = ["INFO", "WARNING", "ERROR"]


def count_by_tenant(logs: DataFrame) -> DataFrame:
    return logs.groupBy("tenant").agg(F.count("*").alias("n"))


def cell_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("tenant", "level", "service").agg(F.count("*").alias("n"))


def stats_from_cells(cells: DataFrame) -> DataFrame:
    """(tenant, dimension, key, n): the total, one row per level, one row per service."""

    def entry(dimension: str, key):
        return F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))

    per = F.inline(
        F.array(entry("total", F.lit("")), entry("level", F.col("level")), entry("service", F.col("service")))
    )
    return cells.select("tenant", "n", per).groupBy("tenant", "dimension", "key").agg(F.sum("n").alias("n"))


def stats(logs: DataFrame) -> DataFrame:
    return stats_from_cells(cell_counts(logs))


def stats_maps(logs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """One row per tenant: total, by_level, by_service, each map with its ``top`` largest
    entries. stats() has all of them, as rows."""
    rank = Window.partitionBy("tenant", "dimension").orderBy(F.desc("n"), "key")
    kept = stats(logs).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top)

    def as_map(dimension: str):
        entry = F.when(F.col("dimension") == dimension, F.struct("key", "n"))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    return kept.groupBy("tenant").agg(
        F.max(F.when(F.col("dimension") == "total", F.col("n"))).alias("total"),
        as_map("level").alias("by_level"),
        as_map("service").alias("by_service"),
    )


def terms_top(logs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The largest buckets per tenant and dimension, ties by key."""
    rank = Window.partitionBy("tenant", "dimension").orderBy(F.desc("n"), "key")
    return (
        stats(logs)
        .where("dimension != 'total'")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= top)
    )


def level_distribution(logs: DataFrame) -> DataFrame:
    """(tenant, position, level, n, share): levels in fixed order, the common ones even at zero."""
    spread = F.posexplode(F.array(*map(F.lit, LEVELS)))
    counted = logs.groupBy("tenant").agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col("level") == level).alias(f"_{level}") for level in LEVELS],
    )
    n = F.element_at(F.array(*[F.col(f"_{level}") for level in LEVELS]), F.col("position") + 1)
    return (
        counted.select("*", spread.alias("position", "level"))
        .select("tenant", "position", "level", n.alias("n"), "_total")
        .where((F.col("n") > 0) | F.col("level").isin(ALWAYS_SHOWN))
        .withColumn("share", F.round(F.col("n") / F.nullif("_total", F.lit(0)) * 100, 6))
        .drop("_total")
    )


def top_services(logs: DataFrame, top: int = TOP_SERVICES) -> DataFrame:
    """(tenant, rank, service, n, width): the busiest services with their bar width in percent."""
    counts = logs.groupBy("tenant", "service").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tenant").orderBy(F.desc("n"), "service")
    whole = Window.partitionBy("tenant")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .withColumn(
            "width",
            F.round(F.greatest(F.lit(MIN_BAR), F.col("n") / F.max("n").over(whole) * 100), 6),
        )
    )


def distinct_docs(logs: DataFrame) -> DataFrame:
    """(tenant, received, distinct_n). Ids are deduplicated where they are before they move."""
    per_id = logs.groupBy("tenant", "doc_id").agg(F.count("*").alias("_n"))
    return per_id.groupBy("tenant").agg(F.sum("_n").alias("received"), F.count("*").alias("distinct_n"))
