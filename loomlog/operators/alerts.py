"""Threshold rules over a sliding window, with a cooldown, per (rule, tenant).

A rule fires at a time t when the matching events in the closed range [t - window, t] reach
its threshold and its last fire is at least a cooldown ago. Events at one instant count
together, so a rule fires at most once per instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.ids import framed_sha1
from loomlog.functions.text import general_number
from loomlog.functions.times import seconds_to_us
from loomlog.operators.slices import SLICE_US, counts_within
from loomlog.operators.spaced import FOLD_MAX, spaced
from loomlog.operators.spread import apart, row_salt, salted
from loomlog.session import broadcast_if_small

RECENT = 20
#: Up to this many rules go to every task.
FEW_RULES = 10_000
ALERT_COLUMNS = ["timestamp", "tenant", "rule", "level", "service", "count", "window_s", "message"]


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with durations in microseconds and the pattern they are looked up by; marked for
    broadcast if there are few enough. Taking its own result again changes nothing. A name that
    two rules share is refused: alerts, state and cooldowns go by it."""
    if "window_us" in rules.columns:
        return rules
    if shared := rules.groupBy("name").count().where("count > 1").take(1):
        raise ValueError(f"two rules are named {shared[0]['name']!r}")
    level, service = F.nullif("level", F.lit("")), F.nullif("service", F.lit(""))
    table = rules.select(
        F.col("name").alias("rule"),
        "threshold",
        "window_s",
        seconds_to_us(F.col("window_s")).alias("window_us"),
        seconds_to_us(F.col("cooldown_s")).alias("cooldown_us"),
        level.alias("rule_level"),
        service.alias("rule_service"),
        F.concat(
            F.when(level.isNull(), F.lit("*")).otherwise(F.concat(F.lit("="), level)),
            F.lit("\n"),
            F.when(service.isNull(), F.lit("*")).otherwise(F.concat(F.lit("="), service)),
        ).alias("_pattern"),
    )
    return broadcast_if_small(table, FEW_RULES)


def _event_patterns(shapes: list[tuple[bool, bool]]) -> Column:
    """The patterns an event answers to, by whether level and service are open."""
    def name(column: str, is_open: bool) -> Column:
        return F.lit("*") if is_open else F.concat(F.lit("="), column)

    made = [F.concat(name("level", level), F.lit("\n"), name("service", service)) for level, service in shapes]
    return F.array(*made).cast("array<string>")


def match_rules(logs: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """One row per event and rule it answers to.

    Optional predicates make this a lookup of at most four patterns per event, those of the shapes
    that the rules have: an equi-join whose cost does not grow with the number of rules, where testing every
    pair would. Up to ``few`` rules are broadcast. More are copied under salts over which the
    events are dealt, as an open pattern is one key for all events, and a level's for a large part.
    """
    table = rule_table(rules)
    of = table.select(F.col("rule_level").isNull().alias("level"), F.col("rule_service").isNull().alias("service"))
    first = of.take(few + 1)
    is_large = len(first) > few
    shapes = sorted({(r.level, r.service) for r in (of.distinct().collect() if is_large else first)})  # at most four
    asked = logs.withColumn("_pattern", F.explode(_event_patterns(shapes)))
    if is_large:
        asked, table = asked.withColumn("_salt", row_salt(logs)), salted(table)
    return asked.join(table, ["_pattern", "_salt"] if is_large else "_pattern").drop("_pattern", "_salt")


def _hits(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, tenant, us, hits, window_us): hits at one instant are summed before they move."""
    slim = logs.select("tenant", "level", "service", F.unix_micros("timestamp").alias("us"))
    return (
        match_rules(slim, rules)
        .groupBy("rule", "tenant", "us", "window_us")
        .agg(F.count("*").alias("hits"))
    )


def window_counts(logs: DataFrame, rules: DataFrame, width: int = SLICE_US) -> DataFrame:
    """(rule, tenant, us, n): matches in [us - window, us] at every instant with a match."""
    hits = _hits(logs, rules)
    return counts_within(hits, ["rule", "tenant"], "us", "hits", "window_us", width)


def candidates(logs: DataFrame, rules: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Instants that reach the threshold, the cooldown aside. The reported count stops at it."""
    rules = rule_table(rules)
    return (
        apart(window_counts(logs, rules, width), rules.select("rule", "threshold"), ["rule"])
        .where("n >= threshold")
        .select("rule", "tenant", "us", F.least("n", "threshold").cast("int").alias("n"))
    )


def fires(logs: DataFrame, rules: DataFrame, fold_max: int = FOLD_MAX, width: int = SLICE_US) -> DataFrame:
    """(rule, tenant, us): candidates left after the cooldown."""
    rules = rule_table(rules)
    gaps = rules.select("rule", "cooldown_us")
    ready = apart(candidates(logs, rules, width).select("rule", "tenant", "us"), gaps, ["rule"])
    return spaced(ready, ["rule", "tenant"], "us", "cooldown_us", fold_max, width)


def alert_rows(fired: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, tenant, us) to full alerts. The level and service shown are the rule's."""
    return fired.join(rule_table(rules), "rule").select(
        F.timestamp_micros("us").alias("timestamp"),
        "tenant",
        "rule",
        F.col("rule_level").alias("level"),
        F.col("rule_service").alias("service"),
        F.col("threshold").alias("count"),
        "window_s",
        F.concat(
            "rule",
            F.lit(": "),
            F.col("threshold").cast("string"),
            F.lit(" matching events within "),
            general_number(F.col("window_s")),
            F.lit("s"),
        ).alias("message"),
    )


def evaluate(logs: DataFrame, rules: DataFrame, fold_max: int = FOLD_MAX, width: int = SLICE_US) -> DataFrame:
    rules = rule_table(rules)
    return alert_rows(fires(logs, rules, fold_max, width), rules)


def alert_id() -> Column:
    return framed_sha1(F.col("rule"), F.col("tenant"), F.unix_micros("timestamp"))


def notification() -> Column:
    return F.concat(F.lit(":rotating_light: "), "message", F.lit(" (tenant="), "tenant", F.lit(")"))


def recent_alerts(alerts: DataFrame, tenant: str, limit: int = RECENT) -> DataFrame:
    return alerts.where(F.col("tenant") == tenant).orderBy(F.desc("timestamp"), "rule").limit(limit)
