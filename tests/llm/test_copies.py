"""The n-gram join, decontamination and repeated passages against brute force."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edges import edge_docs, none_of
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, ngram_join, substrings

ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")


def folded(text):
    return ALNUM.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def grams(text):
    w = folded(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_join(rows):
    sets = [grams(t) for _, t in rows]
    classes = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        classes[s].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    linked = defaultdict(set)
    for a, b in itertools.combinations(classes, 2):
        if a and b and len(a & b) >= 0.8 * len(a | b):
            linked[a].add(b)
            linked[b].add(a)

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for t in linked[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return least([least(classes[t]) for t in seen])

    return Counter((i, least(classes[s]), len(classes[s]), len(linked[s]), reach(s)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("block", [512, 3])
def test_join_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: pairs of blocks are compared too
    base = [f"w{i}" for i in range(80)]
    many = [(200 + k, " ".join(base[:k] + [f"new{k}"] + base[k:])) for k in range(0, 80, 9)]
    docs = edge_docs(spark).select("doc_id", "text", F.lit(1).alias("links"))
    docs = docs.union(spark.createDataFrame([(*m, 1) for m in many], docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, ngram_join.join(docs).collect())) == brute_join(rows)


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and 7 not in ids and 8 not in ids  # a repeated row, a copy, a near copy
    assert ids[9] == 1 and ids[3] == 2  # half alike; the same id, but other texts
    assert sum(ids[i] for i in (0, 1, 2)) == 1  # texts without words are copies
    assert ngram_join.join(none_of(docs)).collect() == [] == ngram_join.one_of_each(none_of(docs)).collect()


def test_prefix_is_shortened_until_the_recall_is_reached():
    for threshold, trees, recall in itertools.product((0.5, 0.8, 0.95), (4, 16, 32), (0.9, 0.999)):
        d = ngram_join.depth(threshold, trees, 8, recall)
        assert d == 1 or 1 - (1 - threshold**d) ** trees >= recall
        assert d == 8 or 1 - (1 - threshold ** (d + 1)) ** trees < recall


def test_pairs_at_the_threshold_are_found():
    pairs, n, common = 40_000, 90, 80  # 80 of 100 n-grams in common
    drawn = np.random.default_rng(5).integers(0, 2**64, size=(pairs, 2 * n - common), dtype=np.uint64)
    bounds, deep = np.arange(pairs + 1) * n, ngram_join.depth(ngram_join.THRESHOLD)
    a, b = (ngram_join.prefixes(np.ascontiguousarray(x).ravel(), bounds, ngram_join.TREES, deep) for x in (drawn[:, :n], drawn[:, n - common :]))
    assert (a == b).any(axis=1).all()


def test_groups_of_the_same_classes_are_compared_once(spark):
    own = "struct<a: long, b: long>"
    rows = [((c, c), tree, key) for key, tree, of in ((10, 0, "xy"), (21, 1, "xy"), (32, 2, "xyz"), (43, 3, "xz"), (54, 4, "xyz")) for c in map(ord, of)]
    met = spark.createDataFrame(rows, f"own {own}, tree int, key long")
    met = met.join(met.groupBy("key").count().withColumnRenamed("count", "n"), "key")
    assert sorted(r.key for r in ngram_join._first_groups(met).collect()) == [10, 32, 43]


def brute_marks(rows, items, width):
    windows = defaultdict(set)
    for i, t in items:
        w = folded(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[k : k + width])].update([] if i is None else [str(i)])
    out = Counter()
    for i, t in rows:
        w, hit, found = folded(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= ids
                    hit.update(range(k, k + size))
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("bits", [28, 3])
def test_marks_are_those_of_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)  # few bits: nearly every shingle is a candidate
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = {i: t for i, t in rows}
    w = text[6].split()
    items = [(1, " ".join(w[10:32])), (2, " ".join(w[10:32]).upper()), (30, "two words"), (4, None), (5, ""), (None, "one"), (6, " ".join(text[14].split()[500:560])), (7, "La la " * 10), (8, "one"), (9, "never seen " * 9)]
    items = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, items string")
    marked = decontaminate.mark(docs, items)
    got = Counter((r.doc_id, r.n_words, sum(s.after - s.first for s in r.spans), tuple(r.hit_items)) for r in marked.collect())
    assert got == brute_marks(rows, [(r.item_id, r.text) for r in items.collect()], 10)
    assert decontaminate.mark(none_of(docs), items).collect() == []
    assert {tuple(r.hit_items) for r in decontaminate.mark(docs, none_of(items)).collect()} == {()}


def test_items_without_an_id_mark_words(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (7, "c d"), (None, "c d")], "item_id long, text string")
    told = {r.doc_id: ([tuple(s) for s in r.spans], r.hit_items) for r in decontaminate.mark(docs, items).collect()}
    assert told == {1: ([(1, 4)], ["7"]), 2: ([], [])}


def test_a_passage_of_many_texts_and_windows_of_one_shingle(spark):
    passage = "p q r s t u v w x y z"
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(3_000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"c{i} d{i} {passage} e{i}") for i in range(40)], "item_id long, text string")
    marked = decontaminate.mark(docs, items, keep=["doc_id"])
    assert marked.columns == ["doc_id", "n_words", "spans", "hit_items"]
    everyone = sorted(map(str, range(40)))
    told = marked.collect()
    assert len(told) == 3_000
    assert all([tuple(s) for s in r.spans] == [(1, 12)] and r.hit_items == everyone and r.n_words == 13 for r in told)


def brute_repeats(rows, width):
    split = [(t or "").encode().split() for _, t in rows]
    at = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = Counter()
    for (i, _), w in zip(rows, split, strict=True):
        gone = {j for k in range(len(w) - width + 1) if at[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    return out


@pytest.mark.parametrize(("many", "shard", "longest"), [(2_000, 100_000, 128), (1, 50, 4)])
@pytest.mark.parametrize("width", [35, 6])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, many, shard, longest, width):
    for name, value in (("MANY", many), ("SHARD_WORDS", shard), ("LONGEST", longest)):
        monkeypatch.setattr(substrings, name, value)
    docs = edge_docs(spark).where("length(text) < 9000 or text is null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, sum(s.after - s.first for s in r.removed), r.kept) for r in substrings.without_repeats(docs, width=width).collect())
    assert got == brute_repeats(rows, width)
    assert substrings.without_repeats(none_of(docs)).collect() == []


def test_automaton_knows_the_longest_repeat():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        texts = Counter(tuple(rnd.randrange(3) for _ in range(rnd.randrange(4, 12))) for _ in range(rnd.randrange(1, 6)))
        automaton, runs = substrings.Automaton(), Counter()
        for s, n in texts.items():
            automaton.add(list(s), n)
            for i, j in itertools.combinations(range(len(s) + 1), 2):
                runs[s[i:j]] += n
        automaton.finish()
        for s in texts:
            assert automaton.matching(list(s)) == [max((k for k in range(1, e + 1) if runs[s[e - k : e]] > 1), default=0) for e in range(1, len(s) + 1)]


