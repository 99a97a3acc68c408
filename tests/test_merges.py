"""Compaction, retention by file, and writes that touch many tenant-days."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomlog.plans import merges
from loomlog.plans import store as store_
from loomlog.plans.archive import Archive, expire_days
from loomlog.plans.store import LogStore
from loomlog.streaming import retention as job

DAY = 86_400.0
AS_OF = dt.datetime(1970, 1, 11, tzinfo=dt.timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def ids(df):
    rows = [r.doc_id for r in df.select("doc_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def filled(store, logs, writes=10, tenants=("t", "a b", "x:y%")):
    for i in range(writes):
        store.write(logs([(i + d * DAY, "INFO", "s", f"m{i}", name) for d in range(2) for name in tenants]))


def test_a_merge_changes_no_row(store, logs):
    filled(store, logs)
    before = ids(store.read())
    many = {(r.tenant, r.day): r.files for r in merges.file_counts(store).collect()}
    assert len(many) == 6 and min(many.values()) == 10
    assert merges.compact(store) == 60
    assert {r.files for r in merges.file_counts(store).collect()} == {1}
    assert ids(store.read()) == before and len(store.files()) == 66
    # what was replaced goes later; the same events are still known, new ones still welcome
    assert merges.vacuum(store, grace_s=0) == 60 and len(store.files()) == 6
    assert ids(store.read()) == before
    filled(store, logs, 11)
    assert len(ids(store.read())) == len(before) + 6
    assert merges.compact(store) == 0
    filled(store, logs, 25)
    assert merges.compact(store, grace_s=0) == 96 and {r.files for r in merges.file_counts(store).collect()} == {1}
    assert merges.vacuum(store, grace_s=0) == 96
    assert len(ids(store.read())) == 25 * 6 and len(ids(store.read("a b"))) == 50


def test_a_reader_never_sees_half_a_merge(store, logs, monkeypatch):
    filled(store, logs, tenants=("t",))
    before, early = ids(store.read()), store.read()
    put, seen = merges.MergeLog.put, []

    def watched(self, state):
        seen.append(ids(store.read()))  # files are in place, the log does not name them yet
        put(self, state)
        seen.append(ids(store.read()))

    monkeypatch.setattr(merges.MergeLog, "put", watched)
    merges.compact(store)
    assert len(seen) == 4 and all(s == before for s in seen)
    assert ids(early) == before  # planned before the merge


def test_a_merge_that_stops_leaves_the_table_as_it_was(store, logs, monkeypatch):
    filled(store, logs, tenants=("t",))
    before = ids(store.read())
    put = merges.MergeLog.put
    monkeypatch.setattr(merges.MergeLog, "put", lambda self, state: put(self, state) if not state.committed else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        merges.compact(store)
    monkeypatch.undo()
    assert ids(store.read()) == before and len(store.files()) == 22
    assert merges.compact(store) == 20 and ids(store.read()) == before
    assert merges.vacuum(store, grace_s=0) == 20 and len(store.files()) == 2


def test_appends_during_a_merge_stay(store, logs, monkeypatch):
    filled(store, logs, tenants=("t",))
    put = merges.MergeLog.put

    def late(self, state):
        if state.committed:
            store.write(logs([(500.0, "INFO", "s", "late", "t")]))
        put(self, state)

    monkeypatch.setattr(merges.MergeLog, "put", late)
    merges.compact(store)
    monkeypatch.undo()
    merges.vacuum(store, grace_s=0)
    assert store.read().where("message = 'late'").count() == 1 and store.read().count() == 21


def test_an_event_that_comes_between_archive_and_delete_survives(spark, store, logs, tmp_path):
    class Slow(Archive):
        def missing(self, *args):
            store.write(logs([(7.0, "INFO", "s", "late", "t"), (8.0, "INFO", "s", "late", "new")]))
            return super().missing(*args)

    filled(store, logs, 3)
    merges.compact(store, least=2)
    archive = Slow(spark, str(tmp_path / "archive"))
    assert expire_days(store, AS_OF, 9, archive) == 3
    assert {r.message for r in store.read().where("day = '1970-01-01'").collect()} == {"late"}
    assert archive.read().count() == 9 and archive.read().where("message = 'late'").count() == 0
    assert expire_days(store, AS_OF, 9, Archive(spark, archive.path)) == 2
    assert archive.read().count() == 11 and store.read().count() == 9
    assert expire_days(store, AS_OF, 9, Archive(spark, archive.path)) == 0


def test_writes_of_many_tenant_days_agree_with_those_of_few(spark, tmp_path, logs, monkeypatch):
    rows = [(i * DAY / 4, "INFO", "s", f"m{i % 7}", f"t{i % 5}") for i in range(60)]
    got = []
    for bound in (1_000, 3):
        monkeypatch.setattr(store_, "PROBED_DAYS", bound)
        store = LogStore(spark, str(tmp_path / f"s{bound}"))
        first, second = store.write(logs(rows[:40])), store.write(logs(rows[20:] + rows[50:]))
        got.append((first, second, ids(store.read())))
        with pytest.raises(ValueError):
            store.write(logs(rows).withColumn("timestamp", F.expr("if(message = 'm3', null, timestamp)")))
        assert store.write(logs([])) == store_.WriteResult(0, 0)
    assert got[0] == got[1] and got[0][1] == store_.WriteResult(50, 20)


def test_ticks_run_retention_once_each(spark, store, logs, tmp_path):
    filled(store, logs, 3, tenants=("t",))
    ticks, made = str(tmp_path / "ticks"), str(tmp_path / "runs")

    def tick(day):
        spark.createDataFrame([(dt.datetime(1970, 1, day),)], "timestamp timestamp").coalesce(1).write.mode("append").parquet(ticks)

    def run(checkpoint):
        stream = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
        job.retention_stream(stream, store, 9, made, str(tmp_path / checkpoint), Archive(spark, str(tmp_path / "a")), merge=True, once=True).awaitTermination()
        return {(r.as_of.day, r.dropped_days) for r in job.read_runs(spark, made).collect()}

    tick(10)
    assert run("c") == {(10, 0)} and store.read().count() == 6
    tick(11)
    assert run("c") == {(10, 0), (11, 1)} and store.read().count() == 3
    assert run("c") == {(10, 0), (11, 1)}  # nothing new
    tick(12)
    assert run("c") == {(10, 0), (11, 1), (12, 1)} and store.read().count() == 0
    assert run("other") == {(10, 0), (11, 1), (12, 1)}  # the runs are noted


def test_files_are_deleted_from_many_threads(store, logs):
    filled(store, logs, 6)
    with ThreadPoolExecutor(2) as pool:
        gone = pool.submit(store.drop_files, store.files(before=dt.date(1970, 1, 2))).result()
    assert gone == 3 and {r.day for r in store.read().select("day").distinct().collect()} == {dt.date(1970, 1, 2)}
