"""Streams drained over files must give what the batch plans give on the same rows."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check_oracles import compare
from conftest import SF

from loomlog.operators import alerts, stats
from loomlog.plans.ingest import counted
from loomlog.plans.store import LogStore, store_rows
from loomlog.sources.raw import parse_lines
from loomlog.streaming import alerts as stream_alerts
from loomlog.streaming import index, progress, sinks, sources
from loomlog.streaming import stats as stream_stats
from loomlog.sources.rules import load_rules
from workload import tables
from test_alerts import hits, model, rules_df

FAR = 4_000_000_000.0
BASE = 10_000


def file_stream(spark, batches, folder):
    """A stream that reads one micro-batch per given DataFrame, in order."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        target = f"{folder}/in/{i:03d}.parquet"
        os.link(f"{folder}/tmp{i}/{part}", target)
        os.utime(target, (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def parts(events, n):
    events = sorted(events)
    size = -(-len(events) // n)
    return [events[i : i + size] for i in range(0, len(events), size)]


def drain_alerts(spark, logs, tmp_path, batches, rules, name="q", **options):
    # the first watermark is the epoch itself, so the rows are moved away from it and back
    moved = [logs([(s + BASE, *rest) for s, *rest in b]) for b in batches]
    stream = file_stream(spark, moved, str(tmp_path / name))
    query = stream_alerts.alert_stream(
        stream, rules_df(spark, rules), str(tmp_path / f"{name}-alerts"), str(tmp_path / f"{name}-offsets"), once=True, **options
    )
    query.awaitTermination()
    rows = sinks.read_alerts(spark, str(tmp_path / f"{name}-alerts"))
    return sorted((r.rule, r.tenant, round(r.us / 10**6 - BASE, 6)) for r in rows.withColumn("us", F.unix_micros("timestamp")).collect())


END = [[(FAR, "INFO", "s", "end", "end")]]


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 4)])
def test_event_mode_equals_the_model(spark, logs, tmp_path, seed, n):
    rnd = random.Random(seed)
    events = [(round(rnd.random() * 300, 6), rnd.choice(["ERROR", "INFO"]), rnd.choice("ab"), "m", rnd.choice("tu")) for _ in range(200)]
    rules = [("any", 3, 5.0, 20.0, None, None), ("err", 2, 12.5, 0.0, "ERROR", None), ("a", 4, 30.0, 7.5, None, "a")]
    got = drain_alerts(spark, logs, tmp_path, parts(events, n) + END, rules)
    assert [g for g in got if g[1] != "end"] == model(events, rules)


def test_disorder_within_the_delay_changes_nothing(spark, logs, tmp_path):
    rules = [("r", 3, 10.0, 100.0, None, None)]
    late = [hits(0, 2, 3), hits(1), hits(201, 200), hits(202)] + END
    assert drain_alerts(spark, logs, tmp_path, late, rules, delay="1 minute") == [("r", "acme", 2), ("r", "acme", 202)]


def test_rows_behind_the_watermark_do_not_count(spark, logs, tmp_path):
    rules = [("r", 2, 10.0, 0.0, None, None)]
    # a batch is held against the watermark that the batch before it ran with
    batches = [hits(0), hits(1000), hits(2000), hits(1)] + END
    assert drain_alerts(spark, logs, tmp_path, batches, rules, delay="1 second") == []


def test_arrival_mode_takes_a_batch_as_simultaneous(spark, logs, tmp_path):
    rules = [("r", 3, 3600.0, 0.0, None, None)]
    got = drain_alerts(spark, logs, tmp_path, [hits(0, 10**6), hits(2 * 10**6), hits(3 * 10**6)], rules, time_mode="arrival")
    assert len(got) == 2 and all(abs(g[2] + BASE - time.time()) < 600 for g in got)


def test_restart_keeps_state_and_replay_adds_no_alert(spark, logs, tmp_path):
    rules = [("r", 3, 10.0, 100.0, None, None)]
    stream_args = dict(rules=rules_df(spark, rules), path=str(tmp_path / "a"), notifications=str(tmp_path / "n"), once=True)
    first = file_stream(spark, [logs(hits(100, 101))], str(tmp_path / "q"))
    stream_alerts.alert_stream(first, checkpoint=str(tmp_path / "c1"), **stream_args).awaitTermination()
    more = [logs(hits(100, 101)), logs(hits(102)), logs(END[0])]
    again = file_stream(spark, more, str(tmp_path / "q2"))
    for checkpoint in ("c2", "c3"):  # the same rows once more, with nothing remembered
        stream_alerts.alert_stream(again, checkpoint=str(tmp_path / checkpoint), **stream_args).awaitTermination()
    rows = sinks.read_alerts(spark, str(tmp_path / "a")).where("tenant = 'acme'").collect()
    assert [r.message for r in rows] == ["r: 3 matching events within 10s"]


def state_of(spark, tmp_path, name="q"):
    hits, fired = stream_alerts.alert_state(spark, str(tmp_path / f"{name}-offsets"))
    return hits.orderBy("us").collect(), fired.collect()


def test_state_holds_only_what_windows_and_cooldowns_reach(spark, logs, tmp_path):
    rules = [("r", 3, 10.0, 100.0, None, None)]
    batches = [hits(*range(50)), hits(60), hits(62), hits(400, tenant="other")]
    assert drain_alerts(spark, logs, tmp_path, batches, rules, delay="1 second") == [("r", "acme", 2.0)]
    # counted up to 399 seconds: the last instant below is 62
    held, fired = state_of(spark, tmp_path)
    assert [r.us / 1e6 - BASE for r in held] == [60.0, 62.0] and [(r.rule, r.us / 1e6 - BASE) for r in fired] == [("r", 2.0)]


def test_idle_keys_leave_the_state(spark, logs, tmp_path):
    rules = [("r", 1, 1.0, 100.0, None, None)]
    batches = [hits(5), hits(60), hits(110), hits(300, tenant="other"), hits(900, tenant="other")]
    got = drain_alerts(spark, logs, tmp_path, batches, rules, delay="1 second")
    assert got == [("r", "acme", 5.0), ("r", "acme", 110.0), ("r", "other", 300.0)]
    held, fired = state_of(spark, tmp_path)
    assert [r.tenant for r in held] == ["other"] and [r.tenant for r in fired] == ["other"]


def test_a_batch_that_is_run_again_starts_from_the_same_state(spark, logs, tmp_path):
    rules = rules_df(spark, [("r", 2, 10.0, 5.0, None, None)])
    state = stream_alerts.AlertState(spark, str(tmp_path / "state"))

    def step(times, batch_id):
        new = spark.createDataFrame([("r", "t", int(s * 1e6), 1) for s in times], "rule string, tenant string, us long, hits long")
        return sorted(r.us / 1e6 for r in state.step(new, int(min(times) * 1e6), int(max(times) * 1e6), rules, batch_id).collect())

    assert step([1, 2, 3], 4) == [2]
    for _ in range(2):
        assert step([6, 7, 8], 7) == [7]
    assert step([12], 8) == [12]
    assert step([100, 101], 9) == [101]
    assert len(os.listdir(tmp_path / "state" / "hits")) == 2


def test_failed_sends_wait_in_the_outbox(spark, tmp_path):
    box = sinks.Outbox(spark, str(tmp_path / "box"))
    for i in range(3):
        box.put(spark.createDataFrame([(f"m{i}", "t")], "message string, tenant string"), i)
    got, refused = [], iter([True])

    def send(texts):
        rows = [r.text for r in texts.collect()]
        if "m1" in rows[0] and next(refused, False):
            raise OSError("away")
        got.extend(rows)

    assert box.deliver(send) == 1 and box.waiting() == [1, 2]
    assert box.deliver(send) == 2 and box.waiting() == []
    assert got == [f":rotating_light: m{i} (tenant=t)" for i in range(3)]
    assert box.deliver(send) == 0


def test_parts_are_rolled_up(spark, tmp_path):
    from loomlog.streaming.parts import Parts

    parts = Parts(spark, str(tmp_path / "p"), "k string, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every=3)
    for i in range(20):
        for _ in range(1 + i % 2):  # some batches come again
            parts.write(spark.createDataFrame([(f"k{i % 2}", i), ("all", 1)], "k string, n long").coalesce(1), i)
        want = {"all": i + 1, "k0": sum(range(0, i + 1, 2))} | ({"k1": sum(range(1, i + 1, 2))} if i else {})
        if i % 3 == 2:
            assert {r.k: r.n for r in parts.read().collect()} == want
        assert len(os.listdir(tmp_path / "p")) <= 10
    parts.roll_up(5)  # an old one again changes nothing
    assert {r.k: r.n for r in parts.read().collect()} == want


def test_live_stats_write_changed_cells_only(spark, logs, tmp_path):
    batches = [[(float(i), "INFO", f"s{i % 4}", "m", "t") for i in range(40)], [(50.0, "INFO", "s1", "m", "t")], [(51.0, "ERROR", "new", "m", "t")]]
    stream = file_stream(spark, [logs(b) for b in batches], str(tmp_path / "q"))
    stream_stats.live_cells(stream, str(tmp_path / "c"), str(tmp_path / "o"), once=True).awaitTermination()
    assert [spark.read.parquet(str(tmp_path / f"c/batch={i}")).count() for i in range(3)] == [4, 1, 1]
    live = {tuple(r) for r in stream_stats.read_live_stats(spark, str(tmp_path / "c")).collect()}
    assert live == {tuple(r) for r in stats.stats(logs(sum(batches, []))).collect()}


def test_index_stream_replays_add_nothing(spark, logs, tmp_path):
    rows = [(float(i % 40), "INFO", "s", f"m{i % 40}", "t") for i in range(60)]
    stream = file_stream(spark, [logs(rows[:30]), logs(rows[30:])], str(tmp_path / "q"))
    store = LogStore(spark, str(tmp_path / "store"))
    for checkpoint in ("a", "b", "b"):
        index.index_stream(stream, store, str(tmp_path / checkpoint), once=True).awaitTermination()
    assert store.read().count() == 40


def test_dedupe_stats_and_rate(spark, logs, tmp_path):
    rows = [(float(BASE + i), "ERROR" if i % 2 else "INFO", f"s{i % 3}", "m", "t") for i in range(50)]
    df = logs(rows)
    twice = [store_rows(df), store_rows(df), store_rows(logs(END[0]))]
    stream = file_stream(spark, twice, str(tmp_path / "q"))
    out = str(tmp_path / "dedupe")
    index.deduplicated(stream).writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 51

    cells = str(tmp_path / "cells")
    stream_stats.live_cells(stream, cells, cells + "-c", once=True).awaitTermination()
    live = {tuple(r) for r in stream_stats.read_live_stats(spark, cells).where("tenant = 't'").collect()}
    assert live == {tuple(r) for r in stats.stats(df.unionByName(df)).collect()}

    out = str(tmp_path / "rate")
    stream_stats.rate_stream(stream, "10 seconds", "5 seconds").writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).where("tenant = 't'").collect()) == [20, 20, 20, 20, 20]


def test_publish_and_tail(spark, logs, tmp_path):
    df = logs([(1.000001, "INFO", "s", 'quote " and\ttab', "t")])
    wire = str(tmp_path / "wire")
    sinks.publish(df, wire)
    row = sources.decode_events(spark.read.text(wire)).withColumn("us", F.unix_micros("timestamp")).first()
    assert (row.us, row.message, row.attrs) == (1_000_001, 'quote " and\ttab', "{}")

    lines = str(tmp_path / "lines")
    os.makedirs(lines)
    for i, text in enumerate(["ERROR one\n\n", '{"message":"two","level":"warn"}\npartial']):
        with open(f"{lines}/{i}.log", "w") as f:
            f.write(text)
    os.utime(f"{lines}/0.log", (1_600_000_000, 1_600_000_000))

    def tailed(name, **options):
        out = str(tmp_path / name)
        query = sources.tail(spark, lines, **options).writeStream.format("parquet").option("checkpointLocation", out + "-c")
        query.trigger(availableNow=True).start(out).awaitTermination()
        return {(r.message, r.level, r.service) for r in spark.read.parquet(out).collect()}

    everything = {("ERROR one", "ERROR", "shipper"), ("two", "WARNING", "shipper"), ("partial", "INFO", "shipper")}
    assert tailed("all") == everything
    import datetime as dt

    since = tailed("since", started=dt.datetime(2023, 1, 1), service="app")
    assert since == {("two", "WARNING", "app"), ("partial", "INFO", "app")}
    static = parse_lines(spark.read.text(lines), service="shipper").collect()
    assert {(r.message, r.level, r.service) for r in static} == everything


def test_progress_counts(spark, logs, tmp_path):
    stream = file_stream(spark, [logs(hits(*range(7))), logs(hits(1, 2, level="INFO"))], str(tmp_path / "q"))
    seen = progress.IngestCounters()
    spark.streams.addListener(seen)
    try:
        out = str(tmp_path / "out")
        counted(stream, ok=F.col("level") == "ERROR").writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
        for _ in range(50):
            if sum(seen.totals.values()) == 9:
                break
            time.sleep(0.1)
        assert seen.totals == {"accepted": 7, "rejected": 2}
    finally:
        spark.streams.removeListener(seen)


def test_batch_equals_stream_on_one_rule(spark, logs, tmp_path):
    events = hits(*range(0, 300, 3)) + hits(*range(1, 90), tenant="u")
    rules = [("r", 5, 30.0, 45.0, "ERROR", None)]
    batch = alerts.fires(logs(events), rules_df(spark, rules)).collect()
    got = drain_alerts(spark, logs, tmp_path, parts(events, 3) + END, rules)
    assert sorted((r.rule, r.tenant, round(r.us / 10**6, 6)) for r in batch) == got


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The events as 60 files in mixed order, of which a micro-batch takes seven."""
    folder = tmp_path_factory.mktemp("many")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(60, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_rate", "stream_alerts", "stream_dedupe", "stream_index", "stream_stats"])
def test_streams_are_complete_on_many_files(spark, many_files, monkeypatch, name):
    monkeypatch.setattr(tables, "FILES_PER_BATCH", 7)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], many_files) is None


def test_undecodable_rows_reach_the_dead_letters(spark, tmp_path):
    good = '{"timestamp":"2024-01-01T00:00:00Z","level":"INFO","service":"s","message":"m","attrs":"{}","tenant":"t"}'
    wire = spark.createDataFrame([(good,), ("{broken",), ("plain",), (good.replace('"m"', "null"),)], "value string")
    batch = sources.decode_events(wire, keep_raw=True)
    store = LogStore(spark, str(tmp_path / "store"))
    assert index.index_batch(store, batch, 0, str(tmp_path / "dead")) == 1
    letters = sinks.read_dead_letters(spark, str(tmp_path / "dead")).collect()
    assert {r.raw for r in letters} == {"{broken", "plain", good.replace('"m"', "null")}
    assert sources.undecodable(wire).count() == 3


def test_dead_letters_of_a_failed_write_are_stored_later(spark, tmp_path, logs):
    rows = logs([(1.0, "INFO", "s", "m", "t"), (2.0, "INFO", "s", "n", "t")])
    store, dead = LogStore(spark, str(tmp_path / "store")), str(tmp_path / "dead")

    class Down:
        def write(self, _):
            raise OSError("down")

    assert index.index_batch(Down(), rows, 3, dead, attempts=2, sleep=lambda _: None) == 0
    assert index.replay_dead_letters(store, dead) == 2
    assert index.replay_dead_letters(store, dead) == 0
    assert store.read().count() == 2


def test_late_rows_are_counted(spark, tmp_path, logs):
    late = progress.LateRows()
    spark.streams.addListener(late)
    try:
        stream = file_stream(spark, [logs([(s, "INFO", "s", "m", "t")]) for s in (10_000.0, 20_000.0, 30_000.0, 5.0)], str(tmp_path))
        counted = stream_stats.rate_stream(stream, "1 minute", "1 second")
        counted.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if late.totals["late"]:
                break
            time.sleep(0.1)
        assert late.totals["late"] == 1
    finally:
        spark.streams.removeListener(late)


def test_alerts_are_handed_to_a_callback(spark, tmp_path, logs):
    logs([(1.0, "ERROR", "s", "m", "t"), (2.0, "ERROR", "s", "m", "t")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs([]).schema).parquet(str(tmp_path / "in"))
    rules = load_rules(spark, '[{"name":"e","threshold":2,"window_s":10,"cooldown_s":1,"level":"ERROR"}]')
    got = []
    stream_alerts.alert_stream(stream, rules, str(tmp_path / "a"), str(tmp_path / "c"), time_mode="arrival", once=True, send=lambda df: got.extend(r.text for r in df.collect())).awaitTermination()
    assert len(got) == 1


def test_registered_alerts_need_no_event_zero(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").where("event_id > 5").write.parquet(f"{tmp_path}/events.parquet")
    batch, stream = (sorted(map(tuple, queries()[q](spark, str(tmp_path)).collect())) for q in ("alerts", "stream_alerts"))
    assert batch and batch == stream
