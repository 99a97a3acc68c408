import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from loomlog.functions.events import wire_columns
from loomlog.operators import retention
from loomlog.operators.alerts import rule_table
from loomlog.operators.search import search
from loomlog.plans.archive import Archive, expire_days, read_json_lines, restore
from loomlog.plans.find import newest
from loomlog.plans.ingest import ingest_raw, ingest_structured
from loomlog.plans.store import LogStore, WriteResult, store_rows
from loomlog.sources.rules import parse_rules
from loomlog.sources.structured import oversize_split
from loomlog.streaming import sinks
from loomlog.streaming.index import index_batch

DAY = 86_400.0
OLD, NEW = 0.0, 20 * DAY
AS_OF = dt.datetime(1970, 1, 22)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def messages(df):
    return sorted(r.message for r in df.collect())


def test_write_is_idempotent(store, logs):
    batch = logs([(1.0, "INFO", "s", "a", "t"), (1.0, "INFO", "s", "a", "t"), (2 * DAY, "INFO", "s", "b", "u")])
    assert store.read().count() == 0
    assert store.write(batch) == WriteResult(received=3, new=2)
    assert store.write(batch) == WriteResult(received=3, new=0)
    assert store.write(logs([(2 * DAY, "INFO", "s", "b", "u"), (2 * DAY, "INFO", "s", "c", "u")])) == WriteResult(2, 1)
    assert store.write(batch.limit(0)) == WriteResult(0, 0)
    assert messages(store.read()) == ["a", "b", "c"]


def test_tenants_that_share_a_prefix_or_look_like_numbers(store, logs):
    store.write(logs([(1.0, "INFO", "s", "a", "t0"), (1.0, "INFO", "s", "b", "t0-eu"), (1.0, "INFO", "s", "c", "007")]))
    assert messages(store.read("t0")) == ["a"]
    assert messages(search(store.read(), "t0", "")) == ["a"]
    assert messages(store.read("007")) == ["c"]
    assert {t for t, _, _ in store.day_folders()} == {"t0", "t0-eu", "007"}


def test_reads_prune_partitions_and_push_filters(store, logs):
    store.write(logs([(d * DAY, "ERROR", "s", str(d), t) for d in range(4) for t in ("t", "u")]))
    df = search(store.read("t", since=dt.date(1970, 1, 3)), "t", level="ERROR")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "EqualTo(level,ERROR)" in plan
    assert messages(df) == ["2", "3"]
    from loomlog.operators.search import page

    assert "TakeOrderedAndProject" in page(df)._jdf.queryExecution().executedPlan().toString()


def test_a_hot_day_is_written_by_many_tasks(spark, store, logs):
    sizes = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = [spark.conf.get(k) for k in sizes]
    try:
        for k in sizes:
            spark.conf.set(k, "64k")
        base = logs([(1.0, "INFO", "s", "m", "hot"), (DAY, "INFO", "s", "m", "small")])
        # hot: 40000 events of one tenant-day; small: one event
        many = base.crossJoin(spark.range(0, 40_000, 1, 8)).where("tenant = 'hot' or id = 0")
        rows = many.withColumn("message", F.sha2(F.col("id").cast("string"), 256))
        assert store.write(rows).new == 40_001
    finally:
        for k, v in zip(sizes, before):
            spark.conf.set(k, v)
    assert len(glob.glob(store.path + "/tenant=hot/day=*/*.parquet")) > 4
    assert len(glob.glob(store.path + "/tenant=small/day=*/*.parquet")) == 1


def test_newest_reads_days_backwards(store, logs):
    rows = [(d * DAY + i, "INFO", "s", f"common {'rare' if d == 1 and i == 0 else ''} {d}", "t") for d in range(9) for i in range(3)]
    store.write(logs(rows))
    assert [r.message.split()[-1] for r in newest(store, "t", "common", limit=4).collect()] == ["8", "8", "8", "7"]
    assert messages(newest(store, "t", "rare")) == ["common rare 1"]
    assert newest(store, "t", "common", limit=100).count() == 27
    assert newest(store, "nobody", "common").count() == 0 and newest(store, "t", "common", limit=0).count() == 0


def test_expire_archive_restore(spark, store, logs, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    store.write(logs([(OLD, "INFO", "s", "old", "t"), (OLD + 1.000001, "WARNING", "s", "old2", "u"), (NEW, "INFO", "s", "new", "t")]))
    ids = {r.message: r.doc_id for r in store.read().collect()}
    assert expire_days(store, AS_OF, 7, archive) == 2
    assert messages(store.read()) == ["new"] and messages(archive.read()) == ["old", "old2"]
    assert expire_days(store, AS_OF, 7, archive) == 0
    files = glob.glob(str(tmp_path / "archive/tenant=*/day=*/*"))
    assert files and all(f.endswith(".json.gz") for f in files)

    # a late event of an archived day joins the archive instead of replacing it
    store.write(logs([(OLD + 5, "INFO", "s", "late", "t"), (OLD, "INFO", "s", "old", "t")]))
    assert expire_days(store, AS_OF, 7, archive) == 1
    assert messages(archive.read()) == ["late", "old", "old2"]

    back = LogStore(spark, str(tmp_path / "back"))
    day = dt.date(1970, 1, 1)
    assert restore(archive, back, "t", day) == WriteResult(2, 2)
    assert restore(archive, back, "t", day) == WriteResult(2, 0)
    restore(archive, back)
    restored = {r.message: r.doc_id for r in back.read().collect()}
    assert restored["old"] == ids["old"] and restored["old2"] == ids["old2"] and len(restored) == 3


def test_expire_without_archive(store, logs):
    store.write(logs([(OLD, "INFO", "s", "old", "t"), (NEW, "INFO", "s", "new", "t")]))
    assert expire_days(store, AS_OF, 7) == 1
    assert messages(store.read()) == ["new"]


def test_nothing_is_deleted_if_the_archive_lacks_events(spark, store, logs, tmp_path):
    class Lossy(Archive):
        def add(self, rows):
            super().add(rows.where("message != 'b'"))

    store.write(logs([(OLD, "INFO", "s", "a", "t"), (OLD, "INFO", "s", "b", "t")]))
    with pytest.raises(RuntimeError, match="lacks"):
        expire_days(store, AS_OF, 7, Lossy(spark, str(tmp_path / "archive")))
    assert messages(store.read()) == ["a", "b"]


def test_loose_json_lines(spark, logs, tmp_path):
    path = str(tmp_path / "day.jsonl")
    df = logs([(1.5, "INFO", "s", "a", "t")])
    df.select(*wire_columns()).write.option("compression", "gzip").json(path)
    row = read_json_lines(spark, path).first()
    assert (row.message, row.tenant, row.attrs, row.day) == ("a", "t", "{}", dt.date(1970, 1, 1))


def test_dead_letters_replay_over_themselves(spark, tmp_path):
    path = str(tmp_path / "dead")
    bad = spark.createDataFrame([("x", "not_json")], "raw string, reason string")
    for batch in (0, 0, 1):
        sinks.dead_letter(bad, path, batch)
    assert sorted(r.batch_id for r in sinks.read_dead_letters(spark, path).collect()) == [0, 1]


def test_incomplete_events_alone_are_dead_lettered(spark, store, logs, tmp_path):
    path = str(tmp_path / "dead")
    batch = logs([(1.0, "INFO", "s", "a", "t"), (2.0, "INFO", "s", None, "t"), (3.0, "INFO", "s", "c", "t")])
    assert index_batch(store, batch, 0, path) == 2
    dead = sinks.read_dead_letters(spark, path).collect()
    assert [r.reason for r in dead] == ["incomplete"] and "00:00:02.000000Z" in dead[0].raw


class Failing(LogStore):
    calls = 0

    def write(self, rows):
        self.calls += 1
        raise OSError("store is away")


def test_retry_then_dead_letter(spark, logs, tmp_path):
    store, slept = Failing(spark, str(tmp_path / "s")), []
    batch = logs([(1.0, "INFO", "s", "a", "t"), (2.0, "INFO", "s", "b", "t")])
    assert index_batch(store, batch, 4, str(tmp_path / "dead"), sleep=slept.append) == 0
    assert store.calls == 3 and slept == [1.0, 2.0]
    dead = sinks.read_dead_letters(spark, str(tmp_path / "dead")).collect()
    assert [r.reason for r in dead] == ["write_failed"] * 2
    with pytest.raises(OSError):
        index_batch(store, batch, 5, None, sleep=slept.append)


def test_alert_table_takes_each_alert_once(spark, tmp_path):
    from loomlog.schema import ALERT_SCHEMA

    path = str(tmp_path / "alerts")
    at = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([(at, "t", "r", None, None, 3, 10.0, "m")], ALERT_SCHEMA)
    assert sinks.append_alerts(one, path).count() == 1
    other = one.withColumn("tenant", F.lit("u"))
    assert sinks.append_alerts(one.unionByName(other), path).count() == 2
    later = one.withColumn("timestamp", F.col("timestamp") + F.expr("interval 3 days"))
    assert sinks.append_alerts(one.unionByName(later), path).count() == 3
    assert sinks.append_alerts(one.limit(0), path).count() == 3


def test_ingest_flow(spark, store):
    at = F.timestamp_micros(F.lit(1_000_000))
    creds = spark.createDataFrame([("k1", "acme"), ("k2", "Bad*")], "api_key string, tenant string")
    structured = spark.createDataFrame(
        [("k1", '{"message":"one","tenant":"forged"}'), ("k1", '[{"message":"two","level":"error"},{"message":3},{"message":"three"}]'),
         ("k2", '{"message":"x"}'), ("nope", '{"message":"x"}'), ("k1", '{"message":"' + "y" * 200 + '"}')],
        "api_key string, body string",
    )
    raw = spark.createDataFrame([("k1", "WARN tape nearly used up\nnothing to see\n\n")], "api_key string, body string")
    events, rejects = ingest_structured(structured, creds, ingest_time=at, max_bytes=150)
    lines, none = ingest_raw(raw, creds, service="legacy", ingest_time=at)
    assert store.write(events.unionByName(lines)).new == 5
    assert {r.tenant for r in store.read().collect()} == {"acme"}
    assert store.read().where("level = 'ERROR'").count() == 1
    assert messages(search(store.read(), "acme", level="WARNING", service="legacy")) == ["WARN tape nearly used up"]
    assert sorted(r.reason for r in rejects.collect()) == ["invalid_tenant", "message", "too_large", "unknown_credential"]
    assert none.count() == 0


def test_a_write_refuses_events_without_a_time(spark, tmp_path, logs):
    store = LogStore(spark, str(tmp_path / "s"))
    rows = logs([(1.0, "INFO", "s", "m", "t")])
    with pytest.raises(ValueError, match="1 events have no timestamp"):
        store.write(rows.union(rows.withColumn("timestamp", F.lit(None).cast("timestamp"))))
    assert not store.exists()


def test_attrs_that_do_not_parse_are_kept_as_they_came(spark, tmp_path, logs):
    store = LogStore(spark, str(tmp_path / "s"))
    rows = logs([(1.0, "INFO", "s", "m", "t")]).withColumn("attrs", F.lit('{"a":1,"a":2}'))
    assert (store.write(rows).new, store.write(rows).new) == (1, 0)
    assert store.read().first().attrs == '{"a":1,"a":2}'


def test_a_write_reads_only_its_own_tenant_days(spark, tmp_path, logs):
    store = LogStore(spark, str(tmp_path / "s"))
    store.write(logs([(86400.0 * d, "INFO", "s", f"m{d}", t) for d in range(3) for t in ("a", "b", "c")]))
    batch = store_rows(logs([(86400.0, "INFO", "s", "m1", "b"), (0.0, "INFO", "s", "new", "d")]))
    us = F.unix_micros("timestamp")
    spans = batch.groupBy("tenant", "day").agg(F.count("*").alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    few = spans.collect()
    ends = [min(r.day for r in few), max(r.day for r in few), min(r.lo for r in few), max(r.hi for r in few)]
    files = store._known(spark, spans, few, ends).inputFiles()
    assert files and all("/tenant=b/day=1970-01-02/" in f for f in files)
    assert store.write(logs([(86400.0, "INFO", "s", "m1", "b"), (0.0, "INFO", "s", "new", "d")])).new == 1


def test_splits_keep_what_cannot_be_decided(spark, logs):
    rows = logs([(1.0, "INFO", "s", "m", "t")])
    both = rows.union(rows.withColumn("timestamp", F.lit(None).cast("timestamp")))
    kept, gone = retention.split(both, retention.event_kept(dt.datetime(2024, 1, 1), 7))
    assert (kept.count(), gone.count()) == (1, 1)
    bodies = spark.createDataFrame([("xy",), ("x",), (None,)], "body string")
    within, beyond = oversize_split(bodies, "body", 1)
    assert ({r.body for r in within.collect()}, [r.body for r in beyond.collect()]) == ({"x", None}, ["xy"])


def test_rules_with_one_name_are_refused(spark):
    rules = parse_rules(spark.createDataFrame([('[{"name":"a","threshold":1,"window_s":1},{"name":"a","threshold":2,"window_s":1}]',)], "raw string"))
    with pytest.raises(ValueError, match="named 'a'"):
        rule_table(rules)
