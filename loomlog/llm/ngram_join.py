"""Texts whose sets of word n-grams are alike, found by prefixes of MinHash labels in several trees.

Texts with equal sets are one class, found by a digest of the set; only classes are compared. Each tree
gives a class a label of MinHash values, of which a prefix is taken, as deep for all classes as the trees
together still find a pair at the threshold with the target recall; it is known before any data is
seen, and labels are not sorted. Classes that share a prefix meet in a group, and
there the exact similarity is taken from their sets. Of groups with the same classes in several trees
the first one is kept, and a pair that meets in several groups is judged in the first one only, so
links are counted once without comparing lists of pairs. Large groups are cut into blocks, and pairs
of blocks are dealt out. A pair that meets in no tree is missed; nothing looks for it afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import arrow, words
from loomlog.session import checkpointed

GRAM, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 20, 8, 0.999999
#: Classes of a group that are compared in one task with those of another block, or among themselves.
BLOCK = 512


def depth(threshold: float, trees: int = TREES, full: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix, from the full label down, at which the trees find the pair with the target recall."""
    d = full
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _odd(n: int) -> np.ndarray:
    return words.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(column: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of every row as sorted hashes, and where each row's begin.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A text of fewer
    words than ``gram`` has one n-gram, all of its words; one without words has none.
    """
    data, offsets = arrow.texts(column)
    found = words.split(data, offsets, words.ALNUM, words.LOWER)
    whole = words.whole_runs(found, gram)
    hashes, row = words.run_hashes(found.hashes, gram)[whole], found.row_of()[: len(whole)][whole]
    n = np.diff(found.bounds)
    short = np.flatnonzero((n > 0) & (n < gram))
    if len(short):
        alone = [words.run_hashes(found.hashes[found.bounds[r] : found.bounds[r + 1]], int(n[r]))[0] for r in short.tolist()]
        hashes, row = np.append(hashes, np.array(alone, np.uint64)), np.append(row, short)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def prefixes(hashes: np.ndarray, bounds: np.ndarray, trees: int, deep: int) -> np.ndarray:
    """For each row with n-grams and each tree, a hash of the first ``deep`` values of its label."""
    n = len(bounds) - 1
    out = np.zeros((n, trees), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    begins = bounds[:-1][some]
    for tree in range(trees):
        key = np.full(len(some), tree, np.uint64)
        for odd in _odd(trees * deep)[tree * deep : (tree + 1) * deep]:
            key = words.mixed(key * np.uint64(31) + np.minimum.reduceat(hashes * odd, begins))
        out[some, tree] = key
    return out


def sketches(docs: DataFrame, doc_id: str, text: str, gram: int, trees: int, deep: int) -> DataFrame:
    """``doc_id, own`` (a digest of row id and text), ``set`` (the digest of the n-gram set), ``keys`` (of the trees; none if the set is empty)."""

    def make():
        def fn(column: pa.Array) -> list[pa.Array]:
            hashes, bounds = gram_sets(column, gram)
            keys = prefixes(hashes, bounds, trees, deep).view(np.int64)
            cuts = bounds.tolist()
            digests = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            full = np.diff(bounds) > 0
            ends = np.concatenate([[0], np.cumsum(full * trees)]).astype(np.int32)
            return [pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel(), pa.int64()))]

        return fn

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", _own())
    return arrow.appended(rows, "text", make, "set binary, keys array<long>", keep=["doc_id", "own"])


def _own(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("other"), text, doc_id).alias("b"))


def _members(gram: int, trees: int, deep: int, columns: list[str]):
    """Texts of classes with the groups they are in -> a row with the n-gram set for each block pair of each group."""
    at = {c: columns.index(c) for c in ("text", "groups")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at["text"])
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1], 1 << 19):
                hashes, bounds = gram_sets(column.slice(lo, hi - lo), gram)
                keys = prefixes(hashes, bounds, trees, deep).view(np.int64)
                out: list[tuple] = []
                for r, groups in enumerate(batch.column(at["groups"]).slice(lo, hi - lo).to_pylist()):
                    own = hashes[bounds[r] : bounds[r + 1]].tobytes()
                    digest, labels = hashlib.md5(own).digest(), keys[r].tobytes()
                    for group in groups:
                        blocks = -(-group["n"] // BLOCK)
                        mine = int.from_bytes(digest[:4], "little") % blocks
                        for other in range(blocks):
                            out.append((group["key"], min(mine, other), max(mine, other), digest, mine, labels, own))
                columns_ = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns_, _MEMBER_TYPES, strict=True)], _MEMBER_NAMES)

    return run


_MEMBERS = "key long, i int, j int, set binary, block int, labels binary, grams binary"
_MEMBER_NAMES = [f.split()[0] for f in _MEMBERS.split(", ")]
_MEMBER_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in _MEMBERS.split(", ")]


def _first_groups(met_in: DataFrame) -> DataFrame:
    """``key`` of the groups without those whose classes are also the group of an earlier tree.

    All pairs of such a group are judged in the earlier one. Groups are alike by a digest of their classes.
    """
    digests = [F.bit_xor(F.xxhash64(F.lit(i), "own")).alias(c) for i, c in enumerate(("a", "b"))]
    known = met_in.groupBy("key", "n").agg(F.min("tree").alias("tree"), *digests)
    return known.groupBy("n", "a", "b").agg(F.min_by("key", "tree").alias("key")).select("key")


def _linked(key: int, i: int, j: int, rows: list[tuple], threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(class, a class of the same local component, number of links found here) for a pair of blocks."""
    sets = [r[0] for r in rows]
    block = np.array([r[1] for r in rows])
    labels = np.array([np.frombuffer(r[2], np.int64) for r in rows])
    grams = [np.frombuffer(r[3], np.uint64) for r in rows]
    size = np.array([len(g) for g in grams])
    tree = int(np.flatnonzero(labels[0] == key)[0])
    begins = np.concatenate([[0], np.cumsum(size)])
    distinct, number = np.unique(np.concatenate(grams), return_inverse=True)
    flag = np.zeros(len(distinct), bool)
    links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows) - 1):
        if i != j and block[a] != i:
            break  # rows are in the order of their blocks
        first = a + 1 if i == j else int(np.searchsorted(block, j))
        others = np.arange(first, len(rows))
        small, large = np.minimum(size[a], size[others]), np.maximum(size[a], size[others])
        wanted = small >= threshold * large - 1e-9
        if tree:
            wanted &= ~(labels[others, :tree] == labels[a, :tree]).any(axis=1)
        others = others[wanted]
        if not len(others):
            continue
        mine = number[begins[a] : begins[a + 1]]
        flag[mine] = True
        if len(others) * 4 >= len(rows) - first:
            both = np.add.reduceat(flag[number[begins[first] :]], begins[first:-1] - begins[first], dtype=np.int64)[others - first]
        else:
            both = np.array([int(flag[number[begins[b] : begins[b + 1]]].sum()) for b in others.tolist()])
        flag[mine] = False
        alike = others[both >= threshold * (size[a] + size[others] - both) - 1e-9]
        links[a] += len(alike)
        links[alike] += 1
        for b in alike.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(sets[x], sets[find(x)], int(links[x])) for x in np.flatnonzero(links).tolist()]


def _judged(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at: tuple, rows: list[tuple]) -> list[tuple]:
            return _linked(*at, rows, threshold) if len(rows) > 1 else []

        at, rows, out = None, [], []
        for batch in batches:
            for key, i, j, digest, block, labels, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    out += done(at, rows)
                    at, rows = (key, i, j), []
                if not rows or rows[-1][0] != digest:  # an equal row came with another copy of the class
                    rows.append((digest, block, labels, own))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        out += done(at, rows)
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["set", "root", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of its connected component, from edges ``a, b``.

    Each round takes the least label among the neighbours, then the label of that label, so paths get
    shorter by half. Minima are taken before shuffling; every round is written to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b")
    both = checkpointed(both.union(both.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("further"))
        new = checkpointed(step.join(jump, "l", "left").select("node", "old", F.least("l", F.coalesce("further", "l")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id, class_id, copies, links, group_id``.

    A class holds the documents with equal n-gram sets; its id is their least doc_id and ``copies``
    their number. ``links`` counts the other classes with a Jaccard similarity of ``threshold`` or more;
    ``group_id`` is the least doc_id of all documents that links connect. Texts without words (null,
    empty) form one class without links. Repeated rows are copies; rows with a null doc_id are in
    their class, which has a null id if no row of it has one. A pair at the threshold is found with
    probability ``recall`` or more, if MinHash values are independent (the README has measured rates), a
    closer one more surely; what is found is exact, what is missed stays missed.
    """
    return _joined(docs, doc_id, text, gram, threshold, trees, recall).select("doc_id", "class_id", "copies", "links", "group_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without all but one of each group that links connect: the one with the least doc_id.

    Of repeated rows one stays; documents with a null doc_id stay only if their whole group has none.
    All columns are kept. Texts without words are copies of each other.
    """
    told = _joined(docs, doc_id, text, **settings)
    least = told.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("m"))
    chosen = least.select(F.col("m.own").alias("__own"))
    keyed = docs.withColumn("__own", _own(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return keyed.join(chosen, "__own", "left_semi").dropDuplicates(["__own"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(docs: DataFrame, doc_id: str, text: str, gram: int = GRAM, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    deep = depth(threshold, trees, LABEL, recall)
    sketched = checkpointed(sketches(docs, doc_id, text, gram, trees, deep))
    # Equal sets have equal keys, so any row speaks for its class.
    classes = checkpointed(sketched.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("own").alias("own"), F.first("keys").alias("keys")))
    labelled = classes.select("own", F.posexplode("keys").alias("tree", "key"))
    groups = labelled.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met_in = checkpointed(labelled.join(groups, "key"))
    wanted = met_in.join(_first_groups(met_in), "key", "left_semi").groupBy("own").agg(F.collect_list(F.struct("key", "n")).alias("groups"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = rows.withColumn("own", _own()).join(wanted, "own").select("text", "groups")
    members = met.mapInArrow(_members(gram, trees, deep, met.columns), _MEMBERS)
    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "set")
    found = checkpointed(dealt.mapInArrow(_judged(threshold), "set binary, root binary, links long"))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    connected = labels.join(classes.select(F.col("set").alias("node"), "class_id"), "node")
    least = connected.groupBy("label").agg(F.min("class_id").alias("group_id"))
    grouped = connected.join(least, "label").select(F.col("node").alias("set"), F.col("label").alias("group"), "group_id")
    told = classes.select("set", "class_id", "copies").join(links, "set", "left").join(grouped, "set", "left")
    told = told.select("set", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "set").alias("group"), F.when(F.col("group").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"))
    return sketched.select("doc_id", "own", "set").join(told, "set")
