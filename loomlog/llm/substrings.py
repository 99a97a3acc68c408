"""Passages that stand more than once in a corpus, found with suffix automata of reference shards.

Every window of ``width`` words is named by the least hash of its ``GRAM``-word runs, its anchor:
equal windows have equal anchors. Neighbouring windows with one anchor make a segment. Only segments
whose anchor stands in two places can hold a repeated window; these are the reference. It is dealt by anchor
into shards of bounded size, each shard becomes a suffix automaton of its distinct segments with
their numbers of occurrences, and the segments of the documents are read through it: at each word the
automaton gives the longest run of words up to there that occurs at least twice. Since all
occurrences of a window meet in one shard, a document meets the shards of its anchors only, not all
of the corpus, and the result is exact whatever the anchors are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import arrow, words

GRAM = 8
#: Windows of a segment at most; longer runs with one anchor (a word that repeats) are cut.
LONGEST = 128
#: Words in a shard, but for the last anchor of it.
SHARD_WORDS = 100_000
#: From so many occurrences on, the windows of an anchor are dealt one by one, by their own hash.
MANY = 2_000


def _split(column: pa.Array) -> tuple[np.ndarray, words.Words]:
    data, offsets = arrow.texts(column)
    return data, words.split(data, offsets, words.SPACED)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    out, have = values, 1
    while 2 * have <= span:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == span else np.minimum(out[: len(out) - (span - have)], out[span - have :])


def segments(found: words.Words, width: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor of each segment, and in how many places of it the anchor is (2: or more).

    Windows count from the row's first word.
    """
    none = np.zeros(0, np.int64)
    span = width - min(GRAM, width) + 1
    at = np.flatnonzero(words.whole_runs(found, width))
    if not len(at):
        return none, none, none, none, none
    hashes = words.run_hashes(found.hashes, width - span + 1)
    least = _least(hashes, span)[at]
    row = found.row_of()[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    if n.max() > LONGEST:
        parts = -(-n // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(LONGEST, np.repeat(n, parts) - nth * LONGEST)
        first = np.repeat(first, parts) + nth * LONGEST
    anchor, grams = least[first], n + span - 1
    begins = np.cumsum(grams) - grams
    same = hashes[np.repeat(at[first] - begins, grams) + np.arange(grams.sum())] == np.repeat(anchor, grams)
    places = np.minimum(np.add.reduceat(same, begins, dtype=np.int64), 2)
    return row[first], at[first] - found.bounds[row[first]], n, anchor.view(np.int64), places


class Automaton:
    """A suffix automaton of several word sequences, with the number of places of every run of words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def add(self, sequence: list[int], n: int) -> None:
        """Take in a sequence that stands at ``n`` places."""
        nxt, link, length, places = self.next, self.link, self.length, self.places
        last = 0
        for c in sequence:
            have = nxt[last].get(c)
            if have is not None and length[have] == length[last] + 1:
                last = have
                places[last] += n
                continue
            if have is None:
                made, p = len(nxt), last
                nxt.append({})
                length.append(length[last] + 1)
                places.append(0)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = made
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[made] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = made
            else:
                last = self._clone(last, c, have)
            places[last] += n

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.places.append(0)
        link[q] = made
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        return made

    def finish(self) -> None:
        """Sum the places along the links, then keep for each state the longest run with two places or more."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            self.places[self.link[s]] += self.places[s]
        self.repeated = [0] * len(self.next)
        for s in order:
            self.repeated[s] = self.length[s] if self.places[s] >= 2 else self.repeated[self.link[s]]

    def matching(self, sequence: list[int]) -> list[int]:
        """At each word, the length of the longest run up to it that stands at two places or more."""
        s, out = 0, []
        for i, c in enumerate(sequence, 1):
            s = self.next[s][c]
            out.append(min(i, self.repeated[s]))
        return out


def _runs(matching: list[int], width: int) -> list[int]:
    """Maximal runs of words within repeated windows, as first, after, first, after ..."""
    out: list[int] = []
    for end, n in enumerate(matching, 1):
        if n >= width:
            if out and out[-1] >= end - width:
                out[-1] = end
            else:
                out += (end - width, end)
    return out


def _judged(width: int):
    """Segments sorted by anchor -> the repeated runs of words of each distinct one."""

    def shard(texts: dict[bytes, int]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        automaton, sequences = Automaton(), []
        for text, n in texts.items():
            sequence = [numbers.setdefault(w, len(numbers)) for w in text.split()]
            sequences.append(sequence)
            automaton.add(sequence, n)
        automaton.finish()
        digests, runs = [], []
        for text, sequence in zip(texts, sequences, strict=True):
            if run := _runs(automaton.matching(sequence), width):
                digests.append(hashlib.md5(text).digest())
                runs.append(run)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(runs, pa.list_(pa.int32()))], ["digest", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, int] = {}
        size, last = 0, None
        for batch in batches:
            for anchor, text, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if anchor != last and size >= SHARD_WORDS:
                    yield shard(texts)
                    texts, size = {}, 0
                last = anchor
                if text in texts:
                    texts[text] += n
                else:
                    texts[text] = n
                    size += text.count(b" ") + 1
        if texts:
            yield shard(texts)

    return run


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1]):
                _, found = _split(column.slice(lo, hi - lo))
                row, first, _, anchor, places = segments(found, width)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in (0, 1)), pa.array(anchor), pa.array(first, pa.int32()), pa.array(places, pa.int32())],
                    ["k1", "k2", "anchor", "first", "places"],
                )

    return run


def _suspects(width: int, columns: list[str], occurrences: bool):
    """Documents with their suspect segments -> where each segment is, or what it says and how often."""
    at = {c: columns.index(c) for c in ("__text__", "k1", "k2", "suspects")}

    def pieces(data, found, batch, lo, hi):
        row, first, n, anchor, _ = segments(found, width)
        wanted = batch.column(at["suspects"]).slice(lo, hi - lo).to_pylist()
        asked = [{s["first"]: s["many"] for s in suspects} for suspects in wanted]
        begins, ends, bounds = found.starts, found.ends, found.bounds
        for r, f, k, a in zip(row.tolist(), first.tolist(), n.tolist(), anchor.tolist(), strict=True):
            many = asked[r].get(f)
            if many is None:
                continue
            for g, m in [(i, 1) for i in range(f, f + k)] if many else [(f, k)]:
                i = int(bounds[r]) + g
                text = b" ".join(data[begins[i] : ends[i + m + width - 2]].tobytes().split())
                yield r, g, text, int.from_bytes(hashlib.md5(text).digest()[:8], "little", signed=True) if many else a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at["__text__"])
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1], 1 << 20):
                data, found = _split(column.slice(lo, hi - lo))
                if occurrences:
                    got = [(r, f, hashlib.md5(text).digest()) for r, f, text, _ in pieces(data, found, batch, lo, hi)]
                    rows = pa.array([r for r, _, _ in got], pa.int64())
                    keys = [batch.column(at[k]).slice(lo, hi - lo).take(rows) for k in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([f for _, f, _ in got], pa.int32()), pa.array([d for _, _, d in got], pa.binary())], ["k1", "k2", "first", "digest"])
                else:
                    counts: dict[tuple[int, bytes], int] = {}
                    for _, _, text, anchor in pieces(data, found, batch, lo, hi):
                        counts[anchor, text] = counts.get((anchor, text), 0) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in counts], pa.int64()), pa.array([t for _, t in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["anchor", "words", "n"])

    return run


def _kept(columns: list[str], passed: int):
    """Documents with the repeated runs of their segments -> what is left of them."""
    at, marks = columns.index("__text__"), columns.index("marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1]):
                data, found = _split(column.slice(lo, hi - lo))
                whole, begins, ends = data.tobytes(), found.starts.tolist(), found.ends.tolist()
                removed, kept = [], []
                for row, mark in enumerate(batch.column(marks).slice(lo, hi - lo).to_pylist()):
                    a, b = int(found.bounds[row]), int(found.bounds[row + 1])
                    spans: list[list[int]] = []
                    for f, e in sorted((m["first"] + x, m["first"] + y) for m in mark or [] for x, y in zip(m["runs"][::2], m["runs"][1::2], strict=True)):
                        if spans and f <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([f, e])
                    removed.append([{"first": f, "after": e} for f, e in spans])
                    parts, i = [], a
                    for f, e in [*spans, [b - a, b - a]]:
                        if i < a + f:
                            parts += whole[begins[i] : ends[a + f - 1]].split()
                        i = a + e
                    kept.append(b" ".join(parts).decode())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(passed)), pa.array(np.diff(found.bounds), pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.string())],
                    [*columns[:passed], "n_words", "removed", "kept"],
                )

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``removed`` (runs of words as first and after) and ``kept`` (the other words, one blank apart).

    A word goes if a window of ``width`` words that covers it also begins anywhere else, in this or
    another row. Words are runs of other bytes than space, tab and line ends. Null and empty texts
    and texts shorter than a window lose nothing; equal rows, also with equal ids, are copies of each
    other and lose every window. Columns named like the added ones are replaced; an empty table stays
    empty.
    """
    added = {"n_words", "removed", "kept"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.col(f"`{doc_id}`").cast("string")
    # Equal rows may share a key: they share all results too.
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        body.alias("__text__"),
        F.xxhash64(own, body).alias("k1"),
        F.xxhash64(F.lit("other"), body, own).alias("k2"),
    )
    anchors = keyed.select("k1", "k2", "__text__").mapInArrow(_anchors(width), "k1 long, k2 long, anchor long, first int, places int")
    repeated = anchors.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1")
    suspects = (
        anchors.join(repeated, "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("first", (F.col("n") > MANY).alias("many"))).alias("suspects"))
    )
    suspected = keyed.join(suspects, ["k1", "k2"])
    pieces = suspected.mapInArrow(_suspects(width, suspected.columns, False), "anchor long, words binary, n long")
    places = suspected.mapInArrow(_suspects(width, suspected.columns, True), "k1 long, k2 long, first int, digest binary")
    judged = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_judged(width), "digest binary, runs array<int>")
    marks = places.join(judged, "digest").groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "runs")).alias("marks"))
    marked = keyed.join(marks, ["k1", "k2"], "left").select(*[F.col(f"`{c}`") for c in kept], "__text__", "marks")
    out = T.StructType([*marked.schema.fields[: len(kept)], *T._parse_datatype_string("n_words long, removed array<struct<first: long, after: long>>, kept string").fields])
    return marked.mapInArrow(_kept(marked.columns, len(kept)), out)
