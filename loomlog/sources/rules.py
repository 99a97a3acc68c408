"""Alert rules from JSON documents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.text import blank
from loomlog.schema import DEFAULT_COOLDOWN_S, LEVELS

# numbers are read as text first, since quoted ones are allowed
_DOCUMENT = (
    "array<struct<name:string,threshold:string,window_s:string,"
    "cooldown_s:string,level:string,service:string>>"
)


def _need(c: Column, what: str) -> Column:
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"rule without a usable {what}")))


def parse_rules(df: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per rule of every document; a blank document has none.

    A missing name, threshold or window fails the job, and so do a level that no event can
    have and a threshold below 1.
    """
    document = F.from_json(raw, _DOCUMENT, {"mode": "FAILFAST"})
    rows = df.where(~blank(F.col(raw))).select(*keep, F.inline(document))
    threshold = F.expr("try_cast(threshold as double)").cast("int")
    level = F.nullif("level", F.lit(""))
    return rows.select(
        *keep,
        _need(F.col("name"), "name").alias("name"),
        _need(F.when(threshold >= 1, threshold), "threshold").alias("threshold"),
        _need(F.expr("try_cast(window_s as double)"), "window_s").alias("window_s"),
        F.when(F.col("cooldown_s").isNull(), F.lit(DEFAULT_COOLDOWN_S))
        .otherwise(_need(F.expr("try_cast(cooldown_s as double)"), "cooldown_s"))
        .alias("cooldown_s"),
        F.when(level.isNull() | level.isin(LEVELS), level)
        .otherwise(F.raise_error(F.concat(F.lit("no event has level "), level)))
        .alias("level"),
        F.nullif("service", F.lit("")).alias("service"),
    )


def load_rules(spark: SparkSession, raw: str) -> DataFrame:
    """The rules of one configuration text. Names must differ, as state is kept by name."""
    rules = parse_rules(spark.sql("select :raw as raw", args={"raw": raw}))
    names = Counter(r.name for r in rules.collect())  # no more than the given text holds
    if names and max(names.values()) > 1:
        raise ValueError(f"several rules are named {names.most_common(1)[0][0]!r}")
    return rules
