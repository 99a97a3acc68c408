"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text are its words and pairs of neighbouring words, as spelled and as shapes: a shape
keeps the kinds of characters (capital, other letter, digit, each sign) and forgets how often each
comes in a row. A pair of two equal words has a shape of its own. Features are hashed into a fixed
number of buckets and weigh their share of the text, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import arrow, words

BUCKET_BITS = 18
#: Labelled rows that are trained on at most; of more, those with the least hash of their id.
MAX_TRAINING_ROWS = 20_000
SHARDS = 8  # learned apart, then averaged
EPOCHS = 3
SCALE = 12.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = ord("X")
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("x")
_CLASS[0x30:0x3A] = ord("d")
_SAME = np.uint64(0x5851F42D4C957F2D)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of all rows, and where each row's features begin."""
    data, offsets = arrow.texts(column)
    spelled = words.split(data, offsets, words.SPACED)
    kinds = _CLASS[data]
    kept = np.ones(len(data), bool)
    if len(data):
        kept[1:] = kinds[1:] != kinds[:-1]
        kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    shaped = words.split(kinds[kept], np.concatenate([[0], np.cumsum(kept)])[offsets], words.SPACED)
    if not np.array_equal(shaped.bounds, spelled.bounds):  # a separator run collapses, a word never does
        raise AssertionError("shapes and words differ in number")
    n = len(spelled.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    same = np.zeros(n, bool)
    same[:-1] = spelled.hashes[1:] == spelled.hashes[:-1]
    pairs = np.zeros((2, n), np.uint64)
    for k, found in enumerate((spelled, shaped)):
        pairs[k, :-1] = words.run_hashes(found.hashes, 2, base=0)
    pairs[1][same] ^= _SAME
    pairs[1][same] = words.mixed(_SAME + np.zeros(int(same.sum()), np.uint64))
    last = spelled.bounds[1:][np.diff(spelled.bounds) > 0] - 1
    pairs[:, last] = words.mixed(np.array([1], np.uint64))  # the end of a text
    families = np.stack([spelled.hashes, words.mixed(shaped.hashes + np.uint64(3)), pairs[0], words.mixed(pairs[1] + np.uint64(5))], axis=1)
    return (families >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).ravel(), spelled.bounds * 4


class Learner:
    """Per-coordinate follow-the-regularised-leader for the logistic loss; the last weight is the constant."""

    def __init__(self) -> None:
        size = (1 << BUCKET_BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "label") -> np.ndarray:
    """Weights learned from labelled texts, as float32 (1 MB, whatever the input).

    Labels with a null key or value are left out. If more than ``MAX_TRAINING_ROWS`` keys are
    labelled, the ones with the least hash are taken; only their texts are shuffled. Of a repeated key
    one text and one label is taken. Each of ``SHARDS`` groups is learned in one task of at most a few
    thousand rows; the weights are averaged. With no labelled text all weights are 0 and every score 0.5.
    """
    named = labels.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{label}`").cast("double").alias("label")).where("key is not null and label is not null")
    known = named.groupBy("key").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64("key"))
    chosen = known.orderBy("h", "key").limit(MAX_TRAINING_ROWS)
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    one = rows.join(F.broadcast(chosen), "key").groupBy("key", "h", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for shard, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, _ = features(pa.array([text], pa.string()))
                buckets, counts = np.unique(at, return_counts=True)
                x = np.append(counts * (SCALE / max(1, len(at))), 1.0)
                shards.setdefault(shard, []).append((np.append(buckets, 1 << BUCKET_BITS).astype(np.int32), x.astype(np.float32), y))
        for samples in shards.values():
            learner = Learner()
            for _ in range(EPOCHS):
                for at, x, y in samples:
                    learner.learn(at, x, y)
            w = learner.weights()
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(w[some], pa.float64())], ["bucket", "w"])

    dealt = one.select(F.pmod("h", F.lit(SHARDS)).alias("shard"), "key", "text", "label").repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("key", F.lit(1)), "key")
    learned = dealt.select("shard", "text", "label").mapInArrow(run, "bucket int, w double")
    weights = np.zeros((1 << BUCKET_BITS) + 1, np.float64)
    # at most a row for each bucket
    for r in learned.groupBy("bucket").agg(F.sort_array(F.collect_list("w")).alias("ws")).collect():
        weights[r.bucket] = sum(r.ws) / SHARDS
    return weights.astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``into``, the probability of label 1 for the whole text, 0 to 1.

    Null and empty texts have no feature but the constant one and get its score. Equal texts get equal
    scores; a column named ``into`` is replaced; an empty table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, weights)

    def make():
        w = shared.broadcast.value.astype(np.float64)

        def fn(column: pa.Array) -> list[pa.Array]:
            at, bounds = features(column)
            n = np.diff(bounds)
            total = np.full(len(n), w[-1])
            some = n > 0
            if some.any():
                total[some] += np.add.reduceat(w[at], bounds[:-1][some]) * (SCALE / n[some])
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())]

        return fn

    return arrow.appended(df, text, make, f"`{into}` double", keep)
