"""The draw towards a target against plain Python."""

import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from edges import edge_docs, none_of
from pyspark.sql import functions as F

from loomlog.llm import target_sampling as ts
from loomlog.llm.queries import target_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall((text or "").encode().lower().decode())
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, share=(25, 100), least=20, seed="7", buckets=10_000, longest=2):
    """Sorted rows (key, n_words, n_features, weight, score) and the ranks."""

    def hashed(text):
        n, found = grams(text, longest)
        return n, [crc32(g.encode()) % buckets for g in found]

    rows = [(k, *hashed(t)) for k, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in rows:
        for b in found:
            s[b] += 1
    for text in target:
        for b in hashed(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for k, n, found in rows:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {i + 1: (r[0], r[4]) for i, r in enumerate(able[: share[0] * len(able) // share[1]])}
    return out, ranks


def check(got, docs, target, **how):
    rows, ranks = brute(docs, target, **how)
    assert sorted(((r[0] is None, r[0] or 0, r[1:]) for r in rows)) == sorted(
        (r[0] is None, r[0] or 0, tuple(r[1:5])) for r in got
    )
    assert {r["rank"]: (r[0], r["score"]) for r in got if r["rank"] is not None} == ranks


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    n_words = {k: grams(t, 1)[0] for k, t in docs}
    got = [(r.doc_id, n_words[r.doc_id], r.n_features, r.weight, r.score, r["rank"]) for r in target_resampling(spark, SF).collect()]
    rows, ranks = brute(docs, target)
    assert sorted(r[:5] for r in got) == sorted(rows)
    assert {r[5]: (r[0], r[4]) for r in got if r[5] is not None} == ranks and len(ranks) > 10


@pytest.mark.parametrize("how", [{}, {"share": (1, 1), "least_words": 1, "buckets": 70_000, "longest": 3, "seed": "a"}, {"longest": 1, "buckets": 1}])
def test_odd_rows(spark, how):
    docs = edge_docs(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    target = spark.createDataFrame([("La la two words",), (None,), ("",)], "text string")
    got = ts.resample(docs, target, **how)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    renamed = {{"least_words": "least"}.get(k, k): v for k, v in how.items()}
    check(got.collect(), texts, ["La la two words"], **renamed)


def test_empty_tables(spark):
    docs = edge_docs(spark)
    assert ts.resample(none_of(docs), docs).collect() == []
    assert ts.resample(docs, none_of(docs)).count() == docs.count()


def test_parts_of_long_texts_make_no_difference():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["ab", "Ü", " ", "\n", "7", ", "]) for _ in range(40_000)) + "z" * 9_000 + " end"
    for longest in (1, 2, 4):
        n, found = ts.Features(5_000, longest).of(text)
        want_n, want = grams(text, longest)
        assert n == want_n
        assert np.array_equal(np.bincount(found, minlength=5_000), np.bincount([crc32(g.encode()) % 5_000 for g in want], minlength=5_000))


def test_numbered_over_many_files(spark):
    rnd = random.Random(4)
    values = [rnd.randrange(40) for _ in range(5_000)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(13)
    got = [r.v for r in ts.numbered(df, F.col("v").desc()).orderBy("place").collect()]
    assert got == sorted(values, reverse=True)
    assert sorted(r.place for r in ts.numbered(df, F.col("v")).collect()) == list(range(1, 5_001))
