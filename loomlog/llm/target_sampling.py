"""Importance resampling towards a target: documents whose words look like the target's are drawn sooner.

Words come from an untrained pre-tokenizer with their offsets. Every run of words is a feature and
falls into one of a fixed number of buckets by its checksum. A bucket's gain is how much more frequent it is in the
target than in the documents, a document's weight is the mean gain of its features, and noise
from a hash of its id makes the draw a sample without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from loomlog.llm import arrow
from loomlog.session import checkpointed

# What is a word, what is not, and the scale of gains and noise.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
SCALE = 1000
PART = 2_000  # characters that the pre-tokenizer sees at once; parts end between words
MAX_LISTED = 1 << 18  # checksums kept as Python numbers
MAX_BUCKETS = 1 << 20  # gains of all buckets go through the driver and to every task


class Features:
    """The buckets of all runs of 1 to ``longest`` words of a text."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """How many words, and the bucket of each run."""
        n, sums, done, before = 0, [], [], []
        for part in arrow.cut(text.encode().lower().decode(), BETWEEN, PART):
            words = before + [part[a:b].encode() for _, (a, b) in self.split.pre_tokenize_str(part)]
            old = len(before)
            n += len(words) - old
            runs = [crc32(w) for w in words]  # of the run that starts at each word
            sums += runs[old:]
            spaced = [b" " + w for w in words] if self.longest > 1 else []
            for size in range(2, self.longest + 1):
                runs = [*map(crc32, spaced[size - 1 :], runs)]
                sums += runs[max(0, old - size + 1) :]  # those that end in this part
            before = words[max(0, len(words) - self.longest + 1) :] if self.longest > 1 else []
            if len(sums) > MAX_LISTED:
                done.append(self._buckets(sums))
                sums = []
        return n, np.concatenate([*done, self._buckets(sums)])

    def _buckets(self, sums: list[int]) -> np.ndarray:
        return (np.array(sums, np.uint32) % self.buckets).astype(self.kind)


def features(df: DataFrame, buckets: int = 10_000, longest: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words`` and ``buckets``: the bucket of each run of 1 to ``longest`` words, packed as
    little-endian integers of two bytes (four above 65 536 buckets).

    A-Z are lower-cased; words are runs of ASCII letters, digits and all characters from U+0080 on. Null and empty texts have none. Texts of any
    length are read in parts; repeated rows are kept; columns named like the added ones are replaced.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must lie between 1 and {MAX_BUCKETS}")

    def make():
        of = Features(buckets, longest).of

        def fn(column: pa.Array) -> list[pa.Array]:
            found = [of(t or "") for t in column.to_pylist()]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]

        return fn

    return arrow.appended(df, text, make, "n_words long, buckets binary", keep)


def _packed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column and where those of each row begin."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // size


def histogram(featured: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows fall into each bucket; summed per task first."""
    kind = Features(buckets, 1).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_packed(batch.column(0), kind)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["bucket", "n"])

    summed = featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.toLocalIterator():  # at most one row per bucket
        out[row.bucket] = row.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's smoothed shares in target and source."""
    t_all, s_all, n = float(target.sum()), float(source.sum()), len(source)
    ratio = [(float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)) for t, s in zip(target.tolist(), source.tolist(), strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weighted(featured: DataFrame, gain: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Replaces ``buckets`` by ``n_features`` and ``weight``, the floored mean of the features' gains (0 without features)."""
    kind = Features(len(gain), 1).kind
    shared = arrow.Shared(featured.sparkSession, gain)
    kept = [c for c in (featured.columns if keep is None else keep) if c.lower() not in ("buckets", "n_features", "weight")]
    source = featured.select(*[F.col(f"`{c}`") for c in kept], "buckets")
    out = source.drop("buckets").withColumns({"n_features": F.lit(0).cast("long"), "weight": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.broadcast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, at = _packed(batch.column(len(kept)), kind)
            n = np.diff(at)
            summed = np.concatenate([[0], np.cumsum(gain[buckets])])
            weight = (summed[at[1:]] - summed[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(n), pa.array(weight)], out.names)

    return source.mapInArrow(run, out)


def noise(key: Column, seed: str) -> Column:
    """Floored thousandths of a Gumbel value from the hash of ``<seed>:<key>``; a null key counts as empty."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``, 1, 2, 3... in ``order`` over the whole table, without bringing it into one task.

    The rows are dealt by ranges and written once; a row's place is its place in its file and the
    rows of the files before it. Only one count per file is brought to the driver.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    part, inside = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select("*", part.cast("int").alias("_part"), inside.alias("_inside"))
    sizes = {r._part: r.n for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    start = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part")) if before else F.lit(0).cast("long")
    return placed.withColumn("place", start + F.col("_inside") + 1).drop("_part", "_inside")


def resample(
    df: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (25, 100),
    least_words: int = 20,
    seed: str = "7",
    buckets: int = 10_000,
    longest: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Draws floor(share * N) of the N documents with at least ``least_words`` words, likest to ``target`` first.

    Returns ``key``, n_words, n_features, weight, score and rank (null if not drawn) of every row. Ties of
    the score go to the smaller key, a null key last; among rows with equal keys and scores any may come first. Null texts
    have no words. An empty table gives an empty table; with an empty target all buckets have a count of
    one there. Further columns are not looked at.
    """
    featured = checkpointed(features(df, buckets, longest, text, [key]))
    gain = gains(histogram(features(target, buckets, longest, text, []), buckets), histogram(featured, buckets))
    score = F.col("weight") + noise(F.col(f"`{key}`"), seed)
    scored = checkpointed(weighted(featured, gain).withColumn("score", score))
    drawable = F.col("n_words") >= least_words
    n = scored.where(drawable).count()
    ranked = numbered(scored, F.when(drawable, F.col("score")).desc_nulls_last(), F.col(f"`{key}`").asc_nulls_last())
    drawn = drawable & (F.col("place") <= share[0] * n // share[1])
    return ranked.withColumn("rank", F.when(drawn, F.col("place"))).drop("place")
