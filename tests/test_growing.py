"""Files that grow while they are read: every line once, whole, in the batch of its line end."""

import os

import pytest
from loomlog.streaming import sources


@pytest.fixture
def folder(tmp_path):
    os.makedirs(tmp_path / "logs")
    return tmp_path


def write(folder, name, data, mode="ab"):
    with open(folder / "logs" / name, mode) as f:
        f.write(data)


def drained(spark, folder, name="out", **options):
    out = str(folder / name)
    stream = sources.follow(spark, str(folder / "logs"), **options)
    stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    return sorted(r.message for r in spark.read.schema("message string").parquet(out).collect())


def test_half_lines_wait_and_restarts_repeat_nothing(spark, folder):
    write(folder, "a.log", b"one\ntw")
    write(folder, "b.log", b"no end")
    assert drained(spark, folder) == ["one"]
    write(folder, "a.log", b"o\r\nthree\n\n")
    assert drained(spark, folder) == ["one", "three", "two"]
    write(folder, "b.log", b" yet\n")
    write(folder, "c.log", "späť \U0001f600\n".encode())
    assert drained(spark, folder) == ["no end yet", "one", "späť \U0001f600", "three", "two"]
    assert drained(spark, folder) == ["no end yet", "one", "späť \U0001f600", "three", "two"]


def test_lines_over_many_tasks(spark, folder):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(500)] + ["y" * 3_000]
    write(folder, "a.log", "\n".join(lines).encode() + b"\nhalf")
    assert drained(spark, folder, split_bytes=64) == sorted(line.strip() for line in lines)
    write(folder, "a.log", b" and half\n")
    assert "half and half" in drained(spark, folder, split_bytes=7)


def test_from_the_end_and_by_name(spark, folder):
    write(folder, "a.log", b"old\nha")
    write(folder, "a.txt", b"other\n")
    assert drained(spark, folder, from_end=True, pattern="*.log") == []
    write(folder, "a.log", b"lf\nnew\n")
    write(folder, "later.log", b"from its beginning\n")
    assert drained(spark, folder, from_end=True, pattern="*.log") == ["from its beginning", "half", "new"]


def test_a_file_begun_anew_is_read_from_its_start(spark, folder):
    write(folder, "a.log", b"first\nsecond\n")
    assert len(drained(spark, folder)) == 2
    write(folder, "a.log", b"third\n", "wb")
    assert drained(spark, folder) == ["first", "second", "third"]
    os.unlink(folder / "logs" / "a.log")
    assert len(drained(spark, folder)) == 3


def test_bytes_that_are_no_text_do_not_stop_it(spark, folder):
    write(folder, "a.log", b"\xff\xfe bad\ngood\n")
    assert drained(spark, folder) == ["good", "�� bad"]
