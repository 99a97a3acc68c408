"""Archives are valid, the index is exact, and what is read is what was written."""

import base64
import gzip
import hashlib
import re
from pathlib import Path

from edges import none_of
from pyspark.sql import functions as F

from loomlog.llm import warc


def pages(spark):
    long = "<p>" + "löng " * 60_000
    rows = [(1, "http://a/", "same"), (2, "http://b/ x\r\ny", "same"), (5, None, "same"), (5, "http://again/", "same"), (3, "http://c/", None), (4, "http://d/", ""), (None, "http://e/", "same"), (None, "http://f/", "lone"), (None, "http://g/", "lone"), (6, "", long), (7, "http://h/", "one")]
    return spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id long, url string, html string, record_type string, refers_to int")


def test_round_trip(spark, tmp_path):
    source = pages(spark)
    index = warc.write(warc.with_revisits(source.repartition(3)), str(tmp_path / "w"))
    assert index.count() == source.count()
    rows = warc.read(index).collect()
    want = {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    html = {r.page_id: (r.html or "").encode() for r in source.collect()}
    assert sorted([r.page_id is None for r in rows]) == [False] * 8 + [True] * 3
    for r in rows:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == (("revisit", 5) if r.payload_bytes == 4 and r.payload is None else ("response", None))
            continue
        body = html[r.page_id]
        assert (r.record_type, r.refers_to) == want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.payload == (body if r.record_type == "response" else None)
    # a selection reads its records only
    assert [(r.page_id, bytes(r.payload)) for r in warc.read(index.where("page_id = 7")).collect()] == [(7, b"one")]
    assert warc.read(warc.write(warc.with_revisits(none_of(source)), str(tmp_path / "none"))).collect() == []


def test_archives_follow_the_format(spark, tmp_path):
    warc.write(warc.with_revisits(pages(spark).coalesce(1)), str(tmp_path / "w")).collect()
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w/archives").glob("*.warc.gz"))
    n = 0
    while whole:
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and all(re.fullmatch(r"[A-Za-z-]+: \S.*", x) for x in lines[1:])
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert fields["WARC-Type"] in ("response", "revisit") and rest[size : size + 4] == b"\r\n\r\n"
        whole, n = rest[size + 4 :], n + 1
    assert n == 11


def test_small_payloads_can_be_left_out_of_revisits(spark):
    kinds = warc.with_revisits(pages(spark), least_bytes=5).groupBy("record_type").agg(F.count("*").alias("n")).collect()
    assert {r.record_type: r.n for r in kinds} == {"response": 11}


def test_a_changed_payload_is_an_error():
    import zlib

    import pytest

    pack = lambda b: gzip.compress(b)
    whole = warc.record(1, "u", b"payload", "response", None, "2024-01-01T00:00:00Z")
    assert warc.parse(pack(whole))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(pack(whole.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad")))
    with pytest.raises(zlib.error):
        warc.parse(pack(whole)[:-12])


def test_reading_back_takes_tasks_by_bytes(spark, monkeypatch):
    rows = [(i, f"http://h{i}.org/", f"{i} " + "x" * 2_000) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write(warc.with_revisits(pages))
    total = sum(r.length for r in index.collect())
    assert warc.read(index).rdd.getNumPartitions() == 1
    monkeypatch.setattr(warc, "TASK_BYTES", total // 12)
    spread = warc.read(index)
    assert spread.rdd.getNumPartitions() == 13
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in spread.collect()) == [(i, h) for i, _, h in rows]
