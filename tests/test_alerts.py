"""Batch alerts against fixed timelines and against a small sequential model."""

import random
from collections import defaultdict

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomlog.operators import alerts
from loomlog.operators.slices import counts_within
from loomlog.operators.spaced import spaced
from loomlog.sources.rules import load_rules

US = 1_000_000


def model(events, rules):
    """(rule, tenant, s) of every fire, event by event. events: (s, level, service, message, tenant)."""
    hits, fired, out = defaultdict(list), {}, []
    times = sorted({e[0] for e in events})
    for now in times:
        touched = set()
        for s, level, service, _, tenant in events:
            if s != now:
                continue
            for name, threshold, window, cooldown, rule_level, rule_service in rules:
                if rule_level in (None, level) and rule_service in (None, service):
                    hits[name, tenant].append(now)
                    touched.add((name, tenant, threshold, window, cooldown))
        for name, tenant, threshold, window, cooldown in touched:
            inside = [h for h in hits[name, tenant] if h >= now - window]
            last = fired.get((name, tenant))
            if len(inside) >= threshold and (last is None or now - last >= cooldown):
                fired[name, tenant] = now
                out.append((name, tenant, now))
    return sorted(out)


def rules_df(spark, rules):
    import json

    keys = ["name", "threshold", "window_s", "cooldown_s", "level", "service"]
    return load_rules(spark, json.dumps([dict(zip(keys, r)) for r in rules]))


def fired(spark, df, rules, **options):
    rows = alerts.fires(df, rules_df(spark, rules), **options).collect()
    return sorted((r.rule, r.tenant, r.us / US) for r in rows)


def hits(*seconds, tenant="acme", level="ERROR", service="checkout"):
    return [(float(s), level, service, "m", tenant) for s in seconds]


# fold_max=0 sends every group through the pointer doubling used for hot keys, 40 only some
PATHS = [{}, {"fold_max": 0}]


@pytest.mark.parametrize("path", PATHS)
def test_cooldown_timeline(spark, logs, path):
    rules = [("r", 3, 10.0, 100.0, None, None)]
    assert fired(spark, logs(hits(0, 1, 2, 3, 200, 201, 202)), rules, **path) == [("r", "acme", 2), ("r", "acme", 202)]


def test_alert_content(spark, logs):
    rules = rules_df(spark, [("r", 3, 10.0, 100.0, "ERROR", None)])
    row = alerts.evaluate(logs(hits(0, 0, 1, 1, 2)), rules).first()
    assert (row["count"], row.level, row.service, row.message) == (3, "ERROR", None, "r: 3 matching events within 10s")


def test_filters(spark, logs):
    events = hits(0, 1) + hits(2, 3, level="INFO") + hits(4, 5, service="api")
    rules = [("both", 2, 10.0, 0.0, "ERROR", "checkout"), ("level", 4, 10.0, 0.0, "ERROR", None), ("service", 4, 10.0, 0.0, None, "checkout")]
    assert fired(spark, logs(events), rules) == [("both", "acme", 1), ("level", "acme", 5), ("service", "acme", 3)]


def test_empty_filters_are_none_and_empty_service_is_a_value(spark, logs):
    events = hits(0, service="") + hits(1, service="x")
    assert fired(spark, logs(events), [("r", 2, 10.0, 9.0, "", "")]) == [("r", "acme", 1)]
    assert alerts.match_rules(logs(hits(0, service="")), rules_df(spark, [("r", 1, 1.0, 1.0, None, None)])).count() == 1


def test_tenants_are_apart(spark, logs):
    events = hits(0, 1) + hits(0, 1, tenant="globex")
    assert fired(spark, logs(events), [("r", 2, 10.0, 50.0, None, None)]) == [("r", "acme", 1), ("r", "globex", 1)]


@pytest.mark.parametrize("second, fires", [(10, 1), (10.000001, 0)])
def test_window_is_closed(spark, logs, second, fires):
    assert len(fired(spark, logs(hits(0, second)), [("r", 2, 10.0, 0.0, None, None)])) == fires


def test_ties_fire_once(spark, logs):
    assert fired(spark, logs(hits(5, 5, 5, 5)), [("r", 2, 10.0, 0.0, None, None)]) == [("r", "acme", 5)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("path", [{}, {"fold_max": 0, "width": 7 * US}, {"fold_max": 40, "width": 3 * US}])
def test_random_against_model(spark, logs, seed, path):
    rnd = random.Random(seed)
    events = [
        (rnd.choice([rnd.randrange(400), rnd.random() * 400]), rnd.choice(["ERROR", "INFO"]), rnd.choice("ab"), "m", rnd.choice(["t", "t", "u"]))
        for _ in range(300)
    ]
    events = [(round(float(s), 6), *rest) for s, *rest in events]
    rules = [
        ("any", 3, 5.0, 20.0, None, None), ("err", 2, 12.5, 0.0, "ERROR", None),
        ("a", 4, 30.0, 7.5, None, "a"), ("one", 1, 1.0, 3.0, "INFO", "b"),
    ]
    assert fired(spark, logs(events), rules, **path) == model(events, rules)


def greedy(points):
    """(key, at) of every time taken; points: (key, at, gap)."""
    last, out = {}, []
    for key, at, gap in sorted(points):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            out.append((key, at))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{"fold_max": 20}, {"fold_max": 150}, {"fold_max": 0}])
def test_large_groups_are_spaced_by_chunks(spark, bounds):
    # gaps from one time to a whole group, and a gap that holds more times than a chunk
    rnd = random.Random(5)
    gaps = {"a": 50, "b": 7, "c": 1, "d": 5000, "e": 333, "f": 90}
    points = [
        (k, at, gap) for k, gap in gaps.items() for at in {rnd.randrange(-500, 6000) for _ in range(rnd.choice([40, 300]))} | set(range(2000, 2080))
    ]
    df = spark.createDataFrame(points, "k string, at long, gap long")
    got = spaced(df, ["k"], "at", "gap", width=100, chunk_max=25, **bounds)
    assert sorted(tuple(r) for r in got.collect()) == greedy(points)


def test_spacing_of_large_groups_takes_no_more_jobs_as_they_grow(spark):
    # pointers were doubled: a round of joins and checkpoints more each time that twice as many are taken
    def jobs(n):
        group = f"spaced-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            df = spark.range(n).selectExpr("'k' k", "id at", "10L gap")
            assert spaced(df, ["k"], "at", "gap", fold_max=n // 2, chunk_max=n // 10).count() == n // 10
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(8000) <= jobs(400) + 2


def test_many_rules_are_dealt_over_salts(spark, logs):
    # 20 000 rules: 4 open, 16 for one level, the others for one service each
    n = F.col("id")
    level, service = F.when(n.between(4, 19), "ERROR"), F.when(n > 19, F.concat(F.lit("s"), n))
    rules = spark.range(20_000).select(
        F.concat(F.lit("r"), n).alias("name"), F.lit(2).alias("threshold"), F.lit(10.0).alias("window_s"), F.lit(0.0).alias("cooldown_s"),
        level.alias("level"), service.alias("service"),
    )
    events = logs([(float(i), "ERROR" if i % 3 else "INFO", f"s{i % 40}", "m", "t") for i in range(600)])
    matched = alerts.match_rules(events, rules)
    assert "_salt" in matched._jdf.queryExecution().analyzed().toString()
    got = {(r.rule, r.us) for r in matched.select("rule", F.unix_micros("timestamp").alias("us")).collect()}
    first = alerts.match_rules(events, rules.where("id < 5000"))
    assert "_salt" not in first._jdf.queryExecution().analyzed().toString()
    assert got == {(r.rule, r.us) for r in first.select("rule", F.unix_micros("timestamp").alias("us")).collect()}
    assert len(got) == matched.count() == 600 * 4 + 400 * 16 + 600 // 40 * 20
    # the whole evaluation beyond the bound: the second of two hits in a closed window of 10 s fires
    few = rules.where("id in (0, 4, 25)")
    assert sorted(alerts.fires(events, rules).where("rule in ('r0', 'r4', 'r25')").collect()) == sorted(alerts.fires(events, few).collect())


def test_rules_of_no_shape(spark, logs):
    assert alerts.match_rules(logs(hits(0)), rules_df(spark, [("r", 1, 1.0, 1.0, None, None)]).where("false")).count() == 0


def test_rule_documents(spark):
    assert load_rules(spark, "  ").count() == 0
    row = load_rules(spark, '[{"name":"r","threshold":"3","window_s":10}]').first()
    assert (row.threshold, row.window_s, row.cooldown_s, row.level, row.service) == (3, 10.0, 300.0, None, None)
    two = '[{"name":"r","threshold":3,"window_s":10},{"name":"r","threshold":4,"window_s":10}]'
    with pytest.raises(ValueError, match="several rules"):
        load_rules(spark, two)


@pytest.mark.parametrize(
    "text",
    ['[{"threshold":3,"window_s":10}]', '[{"name":"r","window_s":10}]', '[{"name":"r","threshold":3}]',
     '[{"name":"r","threshold":0,"window_s":1}]', '[{"name":"r","threshold":1,"window_s":1,"level":"WARN"}]', "{oops"],
)
def test_bad_rules_fail(spark, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        load_rules(spark, text)


def test_recent_and_notification(spark, logs):
    rules = rules_df(spark, [("r", 1, 1.0, 0.0, None, None)])
    rows = alerts.evaluate(logs(hits(*range(30)) + hits(99, tenant="acme-eu")), rules)
    recent = alerts.recent_alerts(rows, "acme").withColumn("us", F.unix_micros("timestamp")).collect()
    assert [r.us // US for r in recent] == list(range(29, 9, -1))
    assert rows.where("tenant = 'acme-eu'").select(alerts.notification()).first()[0] == (
        ":rotating_light: r: 1 matching events within 1s (tenant=acme-eu)"
    )


@pytest.mark.parametrize("reach", [0, 7, 30, -3, 2**63 - 1])
def test_counts_within_equal_a_look_at_every_pair(spark, reach):
    rnd = random.Random(reach % 97)
    weights = {(k, t): rnd.randint(1, 3) for k in "ab" for t in rnd.sample(range(1, 200), 60)}
    df = spark.createDataFrame([(k, t, w, reach) for (k, t), w in weights.items()], "k string, at long, w long, reach long")
    got = {(r.k, r["at"]): r.n for r in counts_within(df, ["k"], "at", "w", "reach", 10).collect()}
    before = {(k, t): sum(w for (o, s), w in weights.items() if o == k and s <= t) for k, t in weights}
    gone = {(k, t): sum(w for (o, s), w in weights.items() if o == k and s < t - reach) for k, t in weights}
    assert got == {key: before[key] - gone[key] for key in weights}


def test_window_counts_come_from_the_running_sum_itself(spark, logs):
    # nothing is grouped by its point again behind the running sum, which would move every hit a second time
    counted = alerts.window_counts(logs(hits(1, 2, 3)), rules_df(spark, [("r", 2, 1.0, 5.0, None, None)]))
    assert "Aggregate" not in counted._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted(r.n for r in counted.collect()) == [1, 2, 2]
