"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from edges import edge_docs, none_of

from loomlog.llm import spelling
from loomlog.llm.queries import spelling_variants

SF = "/root/testdata/sf0.001"


def brute_counts(docs, one_in):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.encode().lower().decode()
            h = crc32(f"{'' if key is None else key}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(counts, times=2):
    # words with one edit between them share a form with one letter taken out or blanked
    rows, by_form = {}, defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_form[w[:i] + w[i + 1 :]].add(w)
        by_form[w].add(w)
    near = defaultdict(set)
    for group in by_form.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        rows[w] = (form, n, len(near[w]), counts[form] if form else None)

    def root(w):
        while rows[w][0]:
            w = rows[w][0]
        return w

    return {(w, form, root(w), n, k, m) for w, (form, n, k, m) in rows.items()}


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {w: n for w, n in brute_counts(docs, 97).items() if n >= 3}
    got = [tuple(r) for r in spelling_variants(spark, SF).collect()]
    assert len(got) == len(counts) and set(got) == brute_variants(counts)
    assert sum(r[1] is not None for r in got) > 20


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aaaaab"])
def test_dense_vocabularies(spark, letters):
    rnd = random.Random(len(letters))
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice([4, 5, 6, 7, 12, 40]))) for _ in range(700)}
    words |= {w[:i] + rnd.choice(letters) + w[i + rnd.randrange(2) :] for w in list(words) for i in [rnd.randrange(len(w))]}
    counts = {w: rnd.choice([1, 2, 3, 5, 9, 30]) for w in words if len(w) >= 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(counts) and set(got) == brute_variants(counts)


def test_long_chains_end_at_their_root(spark):
    counts = {}
    for i in range(25):
        counts["a" * (25 - i) + "b" * i] = 3 * 2**i
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.variants(df).collect()}
    assert got == brute_variants(counts) and {r[2] for r in got} == {"a" + "b" * 24}


def test_odd_rows(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for one_in in (None, 1, 3):
        got = {r.word: r.n for r in spelling.word_counts(docs, one_in=one_in).collect()}
        assert got == dict(brute_counts(rows, one_in))
    counted = spelling.word_counts(docs)
    assert {tuple(r) for r in spelling.variants(counted).collect()} == brute_variants(brute_counts(rows, None))
    assert spelling.variants(spelling.word_counts(none_of(docs))).collect() == []


def test_pivots_are_the_cheapest_pair_apart():
    rnd = random.Random(6)
    for _ in range(500):
        places = rnd.sample(range(12), rnd.randrange(3, 6))
        grams = [(rnd.randrange(9), "xy", at) for at in places]
        a, b = spelling.pivots(grams)
        cost = {at: f for f, _, at in grams}
        assert b - a >= 2
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in cost for y in cost if y - x >= 2)
