"""Pipeline metrics: rates, percentiles, throughput, reconciliation, counters, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.times import MICRO
from loomlog.operators.slices import running, slice_of
from loomlog.operators.spread import apart, same_keys
from loomlog.session import checkpointed

EWMA_KEEP, EWMA_NEW = 0.6, 0.4
RECEIVING_ABOVE = 1.0
EWMA_CHUNK = 256
POLL_SLICE_S = 3600
#: A group of percentiles with more distinct values is cut into this many cells, again and again.
CELL_VALUES, CELLS = 10_000, 64
#: Cuts after which a cell holds only values that the sketch's doubles cannot tell apart.
CUTS = 12


def percentiles(
    samples: DataFrame, keys: list[str], value: str, ps: list[float], limit: int = CELL_VALUES, groups: DataFrame | None = None
) -> DataFrame:
    """(keys…, p, value): the element at min(floor(n·p), n-1) of the sorted values.

    Exact without sorting a group in one place. Equal values are counted first. A group with more
    than ``limit`` distinct values is cut at the quantiles of a sketch into cells, the counts of the cells tell which
    one holds the wanted place, and only that one's values go on, to be cut again until at most ``limit`` are
    left to be put in order. The sketch decides how fast cells shrink, never the result.

    Nulls are no values; a null key is a group of its own. ``groups`` (keys…) names groups that are
    to be told even if they have no value: their result is 0.
    """
    v = F.col(value)
    at = [*keys, "_cell"]
    rows = checkpointed(
        samples.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_cell", F.lit(""))
    )
    sizes = rows.groupBy(*at).agg(F.sum("_n").alias("_size"))
    places = sizes.select(*at, "_size", F.explode(F.array(*map(F.lit, ps))).alias("p")).select(
        *at, "p", F.least(F.floor(F.col("_size") * F.col("p")), F.col("_size") - 1).alias("_place")
    )
    found = None
    for step in range(CUTS + 1):
        large = rows.groupBy(*at).agg(F.count("*").alias("_distinct")).where(F.col("_distinct") > limit).drop("_distinct")
        large = checkpointed(large)
        done = step == CUTS or large.isEmpty()
        # the cells that are small enough; the others are cut
        small = rows if done else apart(rows, large, at, "left_anti")
        order = Window.partitionBy(*at).orderBy(value)
        upto = small.withColumn("_upto", F.sum("_n").over(order))
        holds = (F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n"))
        told = same_keys(upto, places, at).where(holds).select(*keys, "p", value)
        found = told if found is None else found.unionByName(told)
        if done:
            break
        rows, places = _cut(apart(rows, large, at, "left_semi"), same_keys(places, large, at, "left_semi"), keys, value)
    if groups is not None:
        all_ps = groups.select(*keys).distinct().withColumn("p", F.explode(F.array(*map(F.lit, ps))))
        found = same_keys(all_ps, found, [*keys, "p"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast(samples.schema[value].dataType)))
    return found


def _cut(rows: DataFrame, places: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The values of the wanted cells one step finer, and the places within them."""
    at, part = [*keys, "_cell"], F.col("_cuts")
    steps = [(i + 1) / CELLS for i in range(CELLS - 1)]
    cuts = rows.groupBy(*at).agg(F.percentile_approx(value, steps, 20 * CELLS).alias("_cuts"))
    v = F.col(value)
    cell = F.size(F.filter(part, lambda c: c < v))
    cells = apart(rows, checkpointed(cuts), at).withColumn("_part", cell).drop("_cuts")
    sums = cells.groupBy(*at, "_part").agg(F.sum("_n").alias("_in"))
    # a row per cell, so at most CELLS in a partition
    upto = sums.withColumn("_upto", F.sum("_in").over(Window.partitionBy(*at).orderBy("_part")))
    below = F.col("_upto") - F.col("_in")
    finer = F.concat("_cell", F.lit("."), F.col("_part").cast("string"))
    places = checkpointed(
        same_keys(upto, places, at)
        .where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= below))
        .select(*keys, finer.alias("_cell"), "p", (F.col("_place") - below).alias("_place"))
    )
    rows = apart(cells.withColumn("_cell", finer).drop("_part"), places.select(*at).distinct(), at, "left_semi")
    return checkpointed(rows), places


def throughput(events: DataFrame, keys: list[str], at: str = "us") -> DataFrame:
    """(keys…, sent, elapsed_s, rate)."""
    span = (F.max(at) - F.min(at)) / MICRO
    return (
        events.groupBy(*keys)
        .agg(F.count("*").alias("sent"), span.alias("elapsed_s"))
        .withColumn("rate", F.round(F.col("sent") / F.nullif("elapsed_s", F.lit(0.0)), 6))
    )


def reconcile(sent: DataFrame, polls: DataFrame, key: str) -> DataFrame:
    """(key, sent, stored, missing, drained_at): what arrived of what was sent, and the first
    poll that shows all of it. ``sent``: (key, n, baseline); ``polls``: (key, t, total)."""
    seen = polls.join(sent, key, "right").withColumn("_stored", F.col("total") - F.col("baseline"))
    return seen.groupBy(key).agg(
        F.max("n").alias("sent"),
        F.coalesce(F.max("_stored"), F.lit(0)).alias("stored"),
        (F.max("n") - F.coalesce(F.max("_stored"), F.lit(0))).alias("missing"),
        F.min(F.when(F.col("_stored") >= F.col("n"), F.col("t"))).alias("drained_at"),
    )


def accept_split(df: DataFrame, keys: list[str], seq: str, capacity: int, width: int = 65_536) -> DataFrame:
    """Adds ``accepted``: whether a row is among the first ``capacity`` of its group."""
    cut = df.withColumn("_slice", slice_of(F.col(seq), width))
    placed = running(cut, keys, "_slice", [seq], F.lit(1).cast("long"), "_place")
    return placed.withColumn("accepted", F.col("_place") <= capacity).drop("_slice", "_place")


def ingest_counters(df: DataFrame, ok: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )


def ingest_rate(polls: DataFrame, key: str = "tenant", t: str = "t", total: str = "total") -> DataFrame:
    """Adds ``rate``: events per second since the poll before, never negative; NULL first."""
    cut = polls.withColumn("_slice", slice_of(F.col(t), POLL_SLICE_S))
    now = F.struct(F.col(t).alias("t"), F.col(total).alias("total"))
    last = running(cut, [key], "_slice", [t], now, "_last", fold=F.max, inclusive=False)
    passed = F.col(t) - F.col("_last.t")
    rate = F.greatest(F.lit(0.0), (F.col(total) - F.col("_last.total")) / passed)
    return last.withColumn("rate", F.when(passed > 0, rate)).drop("_slice", "_last")


def ewma(
    rates: DataFrame, key: str = "tenant", t: str = "t", x: str = "rate", chunk: int = EWMA_CHUNK
) -> DataFrame:
    """(key, t, ewma, status) with r = 0.6·r + 0.4·x, started at the first x.

    Each step is a linear map r → a·r + b, and so is any run of steps. Steps are numbered and
    cut into chunks, chunks are composed apart, and the chunks' maps are chained the same way,
    level upon level, until one chunk per key is left. No task sees more than a chunk.
    """
    known = rates.where(F.col(x).isNotNull()).select(key, t, x, slice_of(F.col(t), POLL_SLICE_S).alias("_slice"))
    steps = running(known, [key], "_slice", [t], F.lit(1).cast("long"), "_n").select(
        key,
        t,
        (F.col("_n") - 1).alias("_i"),
        # the first step forgets what was before it
        F.when(F.col("_n") == 1, 0.0).otherwise(EWMA_KEEP).alias("_a"),
        F.when(F.col("_n") == 1, F.col(x)).otherwise(F.col(x) * EWMA_NEW).cast("double").alias("_b"),
    )
    steps = checkpointed(steps)  # read by the count, the chain and the result
    longest = steps.agg(F.max("_i")).first()[0] or 0
    smooth = _chain(steps.select(key, "_i", "_a", "_b"), key, longest, chunk)
    return (
        steps.select(key, t, "_i")
        .join(smooth, [key, "_i"])
        .select(
            key,
            t,
            F.round("_r", 6).alias("ewma"),
            F.when(F.col("_r") > RECEIVING_ABOVE, "receiving").otherwise("idle").alias("status"),
        )
    )


def _chain(maps: DataFrame, key: str, longest: int, chunk: int) -> DataFrame:
    """(key, _i, _r): the value after each map, for maps numbered from 0 to ``longest``."""

    def compose(acc, m):
        both = F.struct(
            m["_i"].alias("_i"),
            (m["_a"] * acc["_a"]).alias("_a"),
            (m["_a"] * acc["_b"] + m["_b"]).alias("_b"),
        )
        return F.struct(
            both["_a"].alias("_a"), both["_b"].alias("_b"), F.concat(acc["done"], F.array(both)).alias("done")
        )

    start = F.struct(
        F.lit(1.0).alias("_a"),
        F.lit(0.0).alias("_b"),
        F.array().cast("array<struct<_i:bigint,_a:double,_b:double>>").alias("done"),
    )
    folded = (
        maps.groupBy(key, F.floor(F.col("_i") / chunk).cast("long").alias("_chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("_i", "_a", "_b"))).alias("_maps"))
        .select(key, "_chunk", F.aggregate("_maps", start, compose).alias("_f"))
    )
    within = folded.select(key, "_chunk", F.inline("_f.done"))
    if longest < chunk:  # one chunk per key, and its first map forgets
        return within.select(key, "_i", F.col("_b").alias("_r"))
    totals = folded.select(key, F.col("_chunk").alias("_i"), "_f._a", "_f._b")
    after = _chain(totals, key, longest // chunk, chunk)
    begin = after.select(key, (F.col("_i") + 1).alias("_chunk"), F.col("_r").alias("_start"))
    return within.join(begin, [key, "_chunk"], "left").select(
        key, "_i", (F.col("_a") * F.coalesce("_start", F.lit(0.0)) + F.col("_b")).alias("_r")
    )


def tumbling_rate(events: DataFrame, at: str, width: str, keys: list[str]) -> DataFrame:
    """(keys…, window, n): events per fixed interval; works on streams as on tables."""
    return events.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
