import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomlog.functions import ids
from loomlog.operators import metrics, retention, search, stats, tenancy
from loomlog.operators.slices import running
from loomlog.operators.spread import SALTS, apart, row_salt
from loomlog.plans.store import dedupe, only_new, store_rows, upsert
from loomlog.sources.credentials import credential_table
from loomlog.sources.generate import LINE_LEVELS, SERVICES, gen_events, gen_lines


def found(spark, text, q, mode="phrase_prefix"):
    df = spark.createDataFrame([(text,)], "message string")
    return df.where(search.matches(q, mode=mode)).count() == 1


@pytest.mark.parametrize(
    "text, q, prefix, substring",
    [
        ("payment failed: gateway", "failed gate", True, False),
        ("payment failed: gateway", "ailed", False, True),
        ("payment failed", "FAILED", True, True),
        ("payment failed", "failed payment", False, False),
        ("and, the", "and the", True, False),
        ("100% done", "100%", True, True),
        ("100 done", "100%", True, False),
        ("a_b", "a b", True, False),
        ("réseau perdu", "RÉSEAU p", True, True),
        ("anything", "--", False, False),
        ("anything", "", True, True),
    ],
)
def test_search_modes(spark, text, q, prefix, substring):
    assert found(spark, text, q) is prefix
    assert found(spark, text, q, "substring") is substring


def test_search_clauses_scope_and_page(spark, logs):
    rows = [
        (1.0, "ERROR", "api", "boom in checkout", "t0"), (2.0, "INFO", "api", "ok", "t0"),
        (3.0, "ERROR", "worker", "boom in worker", "t0"), (4.0, "ERROR", "api", "boom", "t0-eu"),
    ]
    df = logs(rows).withColumn("doc_id", ids.doc_id())
    hits = search.page(search.search(df, "t0", "boom", "ERROR")).collect()
    assert [h.service for h in hits] == ["worker", "api"]
    assert search.search(df, "t0", level="error").count() == 0
    assert search.page(df, 0).count() == 0 and search.page(df, -3).count() == 0 and search.page(df, 10**6).count() == 4
    assert search.new_rows(df, None, ids.row_key()).count() == 0
    new = search.new_rows(df, df.where("service = 'api'"), ids.row_key())
    assert [r.service for r in new.collect()] == ["worker"]


def test_display(spark):
    df = spark.createDataFrame([("TRACE", None, "m")], "level string, service string, message string").withColumn(
        "timestamp", F.timestamp_micros(F.lit(1_700_000_000_123_999))
    )
    assert tuple(search.display(df).first()) == ("2023-11-14 22:13:20.123", "INFO", "—", "m")


def test_ids(spark, logs):
    a = logs([(1.0, "INFO", "s", "m", "t")])
    same = a.withColumn("attrs", F.lit('{"a":{"x":1,"y":2},"b":1}'))
    swapped = a.withColumn("attrs", F.lit('{"b": 1.0, "a": {"y": 2, "x": 1}}'))
    assert store_rows(same).first().doc_id == store_rows(swapped).first().doc_id
    moved = a.withColumns({"service": F.lit("sm"), "message": F.lit("")})
    assert store_rows(a).first().doc_id != store_rows(moved).first().doc_id
    names = ["logs-acme-eu-2024.01.05", "logs-2024.01.05", "logs-acme-nodate", "logs-acme-2024.13.01"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(ids.parse_index_tenant(F.col("n")), ids.parse_index_day(F.col("n"))).collect()
    day = dt.date(2024, 1, 5)
    assert [tuple(r) for r in got] == [("acme-eu", day), ("default", day), ("acme", None), ("acme", None)]


def test_upsert_and_anti_join(spark, logs):
    first = store_rows(logs([(1.0, "INFO", "s", "a", "t"), (1.0, "INFO", "s", "a", "t"), (2.0, "INFO", "s", "b", "t")]))
    assert dedupe(first).count() == 2
    more = store_rows(logs([(2.0, "INFO", "s", "b", "t"), (3.0, "INFO", "s", "c", "t"), (3.0, "INFO", "s", "c", "t")]))
    assert [r.message for r in only_new(more, first).collect()] == ["c"]
    assert sorted(r.message for r in upsert(first, more).collect()) == ["a", "b", "c"]


def test_credentials(spark):
    df = spark.createDataFrame([(1, "a:1, b:2 ,junk,:x,y:,c:3:4"), (2, " a : 9 ")], "n int, raw string")
    got = {r.api_key: r.tenant for r in credential_table(df, order=("n",)).collect()}
    assert got == {"a": "9", "b": "2", "c": "3:4"}


def test_resolve(spark):
    requests = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), (None, "x"), ("", "x")], "api_key string, tenant string")
    creds = spark.createDataFrame([("a", "acme"), ("b", "*")], "api_key string, tenant string")
    got = {r.api_key: (r.tenant, r.reason) for r in tenancy.resolve(requests, creds).collect()}
    assert got["a"] == ("acme", None) and got["b"][1] == "invalid_tenant" and got["c"][1] == "unknown_credential"
    assert got[None][1] == got[""][1] == "missing_credential"
    assert {r.tenant for r in tenancy.resolve(requests, None).collect()} == {"default"}


@pytest.mark.parametrize("name, ok", [("a", True), ("a-b_9", True), ("A", False), ("-a", False), ("a" * 64, True), ("a" * 65, False), ("a\n", False), ("*", False), (None, False)])
def test_tenant_names(spark, name, ok):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(tenancy.valid_tenant(F.col("n"))).first()[0] is ok


def limiter(hits, limit, window):
    start, count, out = {}, {}, {}
    for key, us, seq in sorted(hits, key=lambda h: (h[1], h[2])):
        if key not in start or us - start[key] >= window:
            start[key], count[key] = us, 0
        count[key] += 1
        out[seq] = count[key] <= limit
    return out


@pytest.mark.parametrize("fold_max, width", [(10**6, 60_000_000), (0, 13), (10**6, 5)])
def test_rate_limit(spark, fold_max, width):
    rnd = random.Random(width)
    hits = [(rnd.choice("kkl"), rnd.randrange(300), i) for i in range(250)]
    df = spark.createDataFrame(hits, "key string, us long, id long")
    rows = tenancy.rate_limit(df, "key", "us", "id", 3, 20, fold_max, width).collect()
    assert {r.id: r.allowed for r in rows} == limiter(hits, 3, 20)


def test_rate_limit_runs_over_instants(spark, monkeypatch):
    hits = [("a", us, i) for us in (5, 7, 40) for i in range(us * 100, us * 100 + 50)] + [("b", 5, 9_000)]
    df = spark.createDataFrame(hits, "key string, us long, id long")
    handed = []

    def spy(rows, keys, *args, **settings):
        handed.append(rows.count() == rows.select(*keys, "us").distinct().count())
        return running(rows, keys, *args, **settings)

    monkeypatch.setattr(tenancy, "running", spy)
    rows = tenancy.rate_limit(df, "key", "us", "id", 70, 20).collect()
    assert handed and all(handed)
    assert {r.id for r in rows if r.allowed} == {*range(500, 550), *range(700, 720), *range(4000, 4050), 9_000} and len(rows) == 151


def test_rate_limit_example(spark):
    df = spark.createDataFrame([("k", u, i) for i, u in enumerate([0, 1, 2, 10, 11])], "key string, us long, id long")
    rows = tenancy.rate_limit(df, "key", "us", "id", 2, 10).orderBy("id").collect()
    assert [r.allowed for r in rows] == [True, True, False, True, True]
    burst = spark.range(15).select(F.lit("k").alias("key"), F.col("id").alias("us"), "id")
    assert tenancy.rate_limit(burst, "key", "us", "id", 10, 60 * 10**6).where("allowed").count() == 10


@pytest.mark.parametrize("fold", [F.sum, F.max])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_a_plain_window(spark, fold, inclusive):
    from pyspark.sql import Window

    df = spark.range(500).selectExpr("id", "cast(id % 3 as string) k", "cast(hash(id) % 100 as bigint) v")
    end = 0 if inclusive else -1
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, end)
    plain = {r.id: r.x for r in df.withColumn("x", fold("v").over(w)).collect()}
    cut = df.withColumn("s", F.floor(F.col("id") / 17))
    sliced = running(cut, ["k"], "s", ["id"], F.col("v"), "x", fold, inclusive)
    assert {r.id: r.x for r in sliced.collect()} == plain


def test_percentiles(spark):
    rnd = random.Random(1)
    runs = {"four": [1.0, 2.0, 3.0, 4.0], "same": [0.0] * 9, "mixed": [rnd.choice([-1, 1]) * round(rnd.expovariate(0.01), 2) for _ in range(333)], "one": [7.5]}
    df = spark.createDataFrame([(k, v) for k, vs in runs.items() for v in vs], "run string, v double")
    ps = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.run, r.p): r.v for r in metrics.percentiles(df, ["run"], "v", ps).collect()}
    assert got == {(k, p): sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for k, vs in runs.items() for p in ps}


@pytest.mark.parametrize("limit", [1, 20, 10_000])
def test_percentiles_of_any_distribution(spark, limit):
    rnd = random.Random(3)
    runs = {
        None: [rnd.gauss(0, 1) for _ in range(300)],  # a null key is a group
        "edge": [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 5e-324, 1.7e308] * 3,
        "heavy": [1.0] * 400 + [1 + i * 1e-15 for i in range(300)] + [2.0] * 400,
        "none": [None, None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in runs.items() for v in vs], "run string, v double")
    groups = spark.createDataFrame([(k,) for k in (*runs, "empty")], "run string")
    ps = [0.0, 0.4, 0.5, 0.6, 1.0]
    got = {(r.run, r.p): r.v for r in metrics.percentiles(df, ["run"], "v", ps, limit, groups).collect()}
    assert len(got) == 5 * len(ps) and not any(got[k, p] for k in ("none", "empty") for p in ps)
    for k in (None, "edge", "heavy"):
        vs = sorted(runs[k], key=lambda v: (v != v, v))
        for p in ps:
            want = vs[min(int(len(vs) * p), len(vs) - 1)]
            assert got[k, p] == want or (want != want and got[k, p] != got[k, p])


def test_percentiles_of_a_narrow_group_stay_in_small_cells(spark, monkeypatch):
    # a million values between 1 and 1.001, and a hundred small groups
    hot = spark.range(1_000_000).select(F.lit("hot").alias("run"), (1 + F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 1e9).alias("v"))
    cold = spark.range(1_000).select(F.concat(F.lit("c"), F.col("id") % 100).alias("run"), F.col("id").cast("double").alias("v"))
    cells = []
    plain = metrics._cut

    def watched(rows, places, keys, value):
        out = plain(rows, places, keys, value)
        cells.append(out[0].groupBy(*keys, "_cell").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(metrics, "_cut", watched)
    got = {(r.run, r.p): r.v for r in metrics.percentiles(hot.union(cold), ["run"], "v", [0.5, 0.99]).collect()}
    assert got["hot", 0.5] == 1 + 500_000 / 1e9 and got["hot", 0.99] == 1 + 990_000 / 1e9 and got["c7", 0.5] == 507.0
    assert len(got) == 202 and cells[0] < 20_000 and cells[-1] <= 10_000


def test_spread_join_deals_a_hot_key_over_its_copies(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("2", 2), (None, 3), ("absent", 4)], "k string, x int")
    want = {(r.id, 1 if r.id % 3 else 3) for r in rows.where("k = 'hot' or k is null").collect()} | {(r.id, 2) for r in rows.where("k = '2'").collect()}
    for few in (0, 10):
        assert {(r.id, r.x) for r in apart(rows, small, ["k"], few=few).collect()} == want
        assert apart(rows, small, ["k"], "left_semi", few).count() == len(want)
        assert apart(rows, small, ["k"], "left_anti", few).count() == 20_000 - len(want)
    sizes = [r["count"] for r in rows.where("k = 'hot'").groupBy(row_salt(rows)).count().collect()]
    assert len(sizes) == SALTS and max(sizes) < 3 * min(sizes)


def test_ewma_and_rate(spark):
    df = spark.createDataFrame([("t", 0.0, 0), ("t", 10.0, 100), ("t", 20.0, 300), ("t", 30.0, 300), ("t", 40.0, 200)], "tenant string, t double, total long")
    rates = metrics.ingest_rate(df)
    assert [r.rate for r in rates.orderBy("t").collect()] == [None, 10.0, 20.0, 0.0, 0.0]
    for chunk in (256, 3, 2):  # in one chunk, two chunks, two levels of chunks
        got = [(r.ewma, r.status) for r in metrics.ewma(rates, chunk=chunk).orderBy("t").collect()]
        assert got == [(10.0, "receiving"), (14.0, "receiving"), (8.4, "receiving"), (5.04, "receiving")]


def test_ewma_of_a_long_series(spark):
    rnd = random.Random(5)
    xs = {k: [rnd.random() * 1000 for _ in range(n)] for k, n in (("a", 700), ("b", 37), ("c", 1))}
    df = spark.createDataFrame([(k, float(i), x) for k, vs in xs.items() for i, x in enumerate(vs)], "tenant string, t double, rate double")
    want = {}
    for k, vs in xs.items():
        r = None
        for i, x in enumerate(vs):
            r = x if r is None else 0.6 * r + 0.4 * x
            want[k, float(i)] = r
    for chunk in (7, 256):
        got = {(r.tenant, r.t): r.ewma for r in metrics.ewma(df, chunk=chunk).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_accept_split(spark):
    df = spark.range(100).selectExpr("id", "id % 2 k")
    rows = metrics.accept_split(df, ["k"], "id", 7, width=10).where("accepted").collect()
    assert sorted(r.id for r in rows) == list(range(14))


def test_reconcile(spark):
    sent = spark.createDataFrame([("a", 10, 5), ("b", 3, 0), ("c", 1, 0)], "run string, n long, baseline long")
    polls = spark.createDataFrame([("a", 1.0, 14), ("a", 2.0, 15), ("a", 3.0, 15), ("b", 1.0, 2)], "run string, t double, total long")
    got = {r.run: (r.stored, r.missing, r.drained_at) for r in metrics.reconcile(sent, polls, "run").collect()}
    assert got == {"a": (10, 0, 2.0), "b": (2, 1, None), "c": (0, 1, None)}


def test_retention_modes(spark, logs):
    as_of = dt.datetime(2024, 1, 31, 12)
    base = dt.datetime(2024, 1, 24, tzinfo=dt.timezone.utc).timestamp()
    df = logs([(base + h * 3600.0, "INFO", "s", str(h), "t") for h in (-1, 0, 11, 12, 24)]).withColumn("day", F.to_date("timestamp"))
    kept, gone = retention.split(df, retention.event_kept(as_of, 7))
    assert sorted(r.message for r in kept.collect()) == ["12", "24"] and gone.count() == 3
    kept, gone = retention.split(df, retention.day_kept(as_of, 7))
    assert [r.message for r in kept.collect()] == ["24"] and gone.count() == 4
    midnight = retention.day_kept(dt.datetime(2024, 1, 31), 7)
    assert df.where(midnight).count() == 4  # a cutoff on midnight keeps that day


def test_stats_shapes(spark, logs):
    rows = [(float(i), "ERROR" if i % 3 == 0 else "INFO", f"s{i % 12:02d}", "m", "t") for i in range(36)] + [(99.0, "INFO", "s00", "m", "t")]
    df = logs(rows)
    row = stats.stats_maps(df).first()
    assert row.total == 37 and row.by_level == {"ERROR": 12, "INFO": 25} and len(row.by_service) == 10 and row.by_service["s00"] == 4
    assert stats.stats(df).where("dimension = 'service'").count() == 12
    assert stats.terms_top(df).where("dimension = 'service'").count() == 10
    dist = {r.level: (r.n, r.share) for r in stats.level_distribution(df).collect()}
    assert set(dist) == {"INFO", "WARNING", "ERROR"} and dist["WARNING"] == (0, 0.0)
    top = stats.top_services(logs([(float(i), "INFO", "big", "m", "t") for i in range(100)] + [(1.0, "INFO", "tiny", "m", "t")]))
    assert {r.service: r.width for r in top.collect()} == {"big": 100.0, "tiny": 4.0}


def test_generators(spark):
    rows = gen_events(spark.range(2000)).collect()
    assert {r.service for r in rows} == set(SERVICES) and {len(r.message.split()) for r in rows} == {4, 5, 6, 7, 8, 9}
    assert 0.7 < sum(r.level == "INFO" for r in rows) / 2000 < 0.9
    assert rows == gen_events(spark.range(2000).repartition(7)).orderBy("id").collect()
    lines = gen_lines(spark.range(100), "id", F.timestamp_micros(F.lit(0))).collect()
    assert all(r.value.split(" ")[1] in LINE_LEVELS and r.value.startswith("1970-01-01T00:00:00 ") for r in lines)
