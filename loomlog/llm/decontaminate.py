"""Which words of a document stand in a passage of a benchmark: a prefix-filtered set join.

Every item is cut into windows of ``width`` words. A window is contained in a document only if
all its shingles are, so the prefix that must be joined is its single rarest shingle, rarity
being the count over all documents. A document's shingles that may be such prefix tokens are joined
to the windows by the shingle's hash, with the words around them; the place of the shingle in the window
bounds where the window would begin, and its words are compared one by one.

Tasks know which shingles may matter by a bitmap of hashes, whose size has a fixed bound. It only saves
rows: a bitmap that is too small for a benchmark lets more shingles through to the join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import arrow, words
from loomlog.session import checkpointed

SHINGLE = 3
#: A bitmap has about so many bits for each of its hashes, but at most two to the power of ``MOST_BITS`` (32 MB).
BITS_A_HASH, MOST_BITS = 256, 28
#: Bits in one row of a bitmap while it is built; what Spark's bitmap function makes.
_ROW_BITS = 15


def _split(column: pa.Array) -> tuple[np.ndarray, words.Words]:
    data, offsets = arrow.texts(column)
    return data, words.split(data, offsets, words.ALNUM, words.LOWER)


def _spelled(data: np.ndarray, found: words.Words, lo: int, hi: int) -> bytes:
    """Words lo .. hi - 1, lower-cased and one blank apart."""
    return b" ".join(data[s:e].tobytes().lower() for s, e in zip(found.starts[lo:hi].tolist(), found.ends[lo:hi].tolist(), strict=True))


def windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """The distinct windows of all items: ``words`` (blank between), ``items`` (sorted ids as text; without the null ones)."""
    source = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1], 1 << 18):
                data, found = _split(column.slice(lo, hi - lo))
                owners, out = [], []
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                for row, name in enumerate(names):
                    a, b = int(found.bounds[row]), int(found.bounds[row + 1])
                    if a == b:
                        continue
                    for i in range(a, max(b - width, a) + 1):
                        owners.append(name)
                        out.append(_spelled(data, found, i, min(i + width, b)).decode())
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(out, pa.string())], ["item", "words"])

    return source.mapInArrow(run, "item string, words string").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def shingles(windows: DataFrame) -> DataFrame:
    """``words, size, k, offset, token``: each shingle of ``k`` words of a window, where it stands, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for lo, hi in arrow.row_ranges(arrow.texts(column)[1]):
                some = column.slice(lo, hi - lo)
                found = _split(some)[1]
                size = np.diff(found.bounds)
                for k in range(1, SHINGLE + 1):
                    of = np.flatnonzero(np.minimum(size, SHINGLE) == k)
                    n = size[of] - k + 1
                    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    of = np.repeat(of, n)
                    token = words.run_hashes(found.hashes, k)[found.bounds[:-1][of] + offset]
                    out = [some.take(pa.array(of)), size[of], np.full(len(of), k), offset, token.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["words", "size", "k", "offset", "token"])

    return windows.select("words").mapInArrow(run, "words string, size long, k long, offset long, token long")


class Bitmap:
    """Hashes that may be wanted: the bits at their upper and at their lower end are both set; the same bits for every ``k``."""

    def __init__(self, tokens: DataFrame):
        """``tokens`` has rows of ``k, token``. At most 2 ** (MOST_BITS - _ROW_BITS) rows of 4 KB come to the driver."""
        self.widths = sorted(r.k for r in tokens.select("k").distinct().collect())
        self.bits = min(max(tokens.count() * BITS_A_HASH, 2).bit_length(), MOST_BITS)
        ends = F.array(F.shiftrightunsigned("token", 64 - self.bits), F.col("token").bitwiseAND(F.lit((1 << self.bits) - 1)))
        place = F.col("place")
        rows = tokens.select(F.explode(ends).alias("place")).select(F.shiftright(place, _ROW_BITS).alias("row"), place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("bit"))
        made = bytearray(max(1 << self.bits, 1 << _ROW_BITS) // 8)
        step = (1 << _ROW_BITS) // 8
        for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
            made[r.row * step : (r.row + 1) * step] = r.bits
        self.shared = arrow.Shared(tokens.sparkSession, bytes(made))

    def found_in(self, got: words.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width the places of its shingles that may be wanted, each within its row, and all hashes."""
        table = np.frombuffer(self.shared.broadcast.value, np.uint8)
        for k in self.widths:
            hashes = words.run_hashes(got.hashes, k)
            at = np.flatnonzero(_held(table, hashes >> np.uint64(64 - self.bits)))
            at = at[_held(table, hashes[at] & np.uint64((1 << self.bits) - 1))]
            yield k, at[words.whole_runs(got, k)[at]], hashes


def _held(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, words.Words]]:
    for lo, hi in arrow.row_ranges(arrow.texts(column)[1]):
        yield lo, *_split(column.slice(lo, hi - lo))


def rarest(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``words, items, size, k, offset, token``: of each window the shingle that is rarest in the documents, the first of equal ones.

    The shingles of the windows are counted over all documents; only counts by hash are shuffled.
    """
    spread = checkpointed(shingles(windows))
    wanted = Bitmap(spread.select("k", "token").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, got in _slices(batch.column(0)):
                for _, at, hashes in wanted.found_in(got):
                    token, n = np.unique(hashes[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    told = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "token long, n long")
    counted = told.groupBy("token").agg(F.sum("n").alias("n"))
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token", "size", "k")).alias("best")
    best = spread.join(counted, "token", "left").groupBy("words").agg(first)
    return windows.join(best, "words").select("words", "items", "best.size", "best.k", "best.offset", "best.token")


def _key(text: Column) -> Column:
    """Equal texts are one: they have the same passages."""
    return F.unhex(F.sha2(text, 256))


def candidates(docs: DataFrame, text: str, prefixes: DataFrame, width: int) -> DataFrame:
    """``key, token, near, lead, at``: the shingles of each distinct text that may be the prefix of a window.

    ``near`` are the words that a window around the shingle may have, ``lead`` of them before it; ``at`` lists
    the numbers of the shingle's first word, all of those with the same words around.
    """
    wanted = Bitmap(prefixes.select("k", "token").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for begin, data, got in _slices(batch.column(1)):
                row_of = got.row_of()
                for k, at, hashes in wanted.found_in(got):
                    room = width - k if k == SHINGLE else 0
                    places = defaultdict(list)
                    rows = row_of[at]
                    firsts, afters = got.bounds[:-1][rows], got.bounds[1:][rows]
                    los, his = np.maximum(at - room, firsts), np.minimum(at + k + room, afters)
                    token = hashes[at].view(np.int64)
                    for i, row, first, lo, hi, t in zip(*(x.tolist() for x in (at, rows, firsts, los, his, token)), strict=True):
                        places[row, t, _spelled(data, got, lo, hi), i - lo].append(i - first)
                    out = list(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array([begin + o[0] for o in out], pa.int64())),
                            pa.array([o[1] for o in out], pa.int64()),
                            pa.array([o[2].decode() for o in out], pa.string()),
                            pa.array([o[3] for o in out], pa.int64()),
                            pa.array(list(places.values()), pa.list_(pa.int64())),
                        ],
                        ["key", "token", "near", "lead", "at"],
                    )

    body = F.col(f"`{text}`").cast("string")
    source = docs.select(_key(body).alias("key"), body.alias("text")).where("text is not null")
    return source.mapInArrow(run, "key binary, token long, near string, lead long, at array<long>").distinct()


def _runs(places: Column) -> Column:
    """The maximal runs of sorted distinct numbers, as (first, after)."""
    firsts = F.filter(places, lambda p, i: ~F.coalesce(F.get(places, i - 1) == p - 1, F.lit(False)))
    lasts = F.filter(places, lambda p, i: ~F.coalesce(F.get(places, i + 1) == p + 1, F.lit(False)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("after")))


def passages(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, width: int) -> DataFrame:
    """``key, spans, hit_items`` of each distinct text that has a window."""
    prefixes = checkpointed(rarest(checkpointed(windows(items, item_id, item_text, width)), docs, text))
    begin = (F.col("lead") - F.col("offset")).cast("int")
    held = F.array_join(F.slice(F.split("near", " "), F.greatest(begin, F.lit(0)) + 1, F.col("size").cast("int")), " ")
    found = candidates(docs, text, prefixes, width).join(prefixes, "token").where((begin >= 0) & (held == F.col("words")))
    covered = F.flatten(F.transform("at", lambda p: F.sequence(p - F.col("offset"), p - F.col("offset") + F.col("size") - 1)))
    # What a text has of one window is one row here, so the lists of a text are as long as the text and its items.
    hit = found.select("key", covered.alias("covered"), "items").groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
    )
    return hit.select("key", _runs(F.col("places")).alias("spans"), "hit_items")


def _counted(column: pa.Array) -> list[pa.Array]:
    return [pa.array(np.diff(_split(column)[1].bounds), pa.int64())]


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``n_words``, ``spans`` and ``hit_items`` to every document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or the whole item if it has fewer but not none.
    ``spans`` are the maximal runs of words inside windows as (first, after) word numbers, and
    ``hit_items`` the sorted ids (as text) whose windows occur. Null and empty texts have no words;
    items without words have no windows, and an empty table of items leaves all documents without spans. Windows of
    items with a null id mark words, but add no id. Windows that several items share hit all
    of them; repeated documents get equal results. Columns named like the added ones are replaced.

    Windows and documents meet in a join on prefix tokens; of a document only the words around such a token are
    shuffled for it. Nothing of the items goes through the driver but two bitmaps of at most 32 MB.
    Spans come back to the documents by a hash of the text, so ``keep`` says what is shuffled for that.
    """
    found = checkpointed(passages(docs, items, text, item_id, item_text, width))
    added = ("n_words", "spans", "hit_items")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    body = F.col(f"`{text}`").cast("string")
    rows = arrow.appended(docs.withColumn("__key", _key(body)), text, lambda: _counted, "n_words long", [*names, "__key"])
    joined = rows.join(found.withColumnRenamed("key", "__key"), "__key", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,after:bigint>>")).alias("spans"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
    )
