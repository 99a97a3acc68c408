"""Spelling variants: words that differ by one letter are linked, each to its most frequent neighbour.

Candidates come from pivotal bigrams. A word's prefix is its three rarest bigrams, its pivots are two
of them that do not overlap. One edit spoils at most one pivot; the other one stands in the
prefix of the other word, if that word's prefix reaches as far, and everything on the side of it
where the edit is not is equal. So pivots meet prefixes on the bigram, its place and that
side, and what meets is verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import arrow
from loomlog.session import checkpointed

# What is a word, and what lies between words.
WORD = re.compile("[A-Za-z\u00C0-\u00FF]+")
BETWEEN = re.compile("[^A-Za-z\u00C0-\u00FF]")
LONG_TEXT = 1 << 20
HELD_WORDS = 200_000  # distinct words that a task holds before it passes their counts on
LEAST_LENGTH = 5
PREFIX = 3  # one edit spoils two bigrams at most, so one of three is left
MAX_ROUNDS = 64  # of doubling: more than any count of words can need


def misspelt(word: str, key: str, one_in: int) -> str:
    """The word without one letter, for one in ``one_in`` pairs of key and word; by a checksum."""
    h = crc32(f"{key}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame, text: str = "text", key: str = "doc_id", one_in: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all whole texts: runs of Latin letters with A-Z lower-cased, of ``least_length`` code points or more.

    With ``one_in`` a word loses a letter in some documents, see ``misspelt``, before its length is looked at. A null
    key counts as empty, null texts have no words, repeated rows count each time. Tasks count first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in arrow.cut((t or "").encode().lower().decode(), BETWEEN, LONG_TEXT):
                    for word, n in Counter(WORD.findall(part)).items():
                        if one_in:
                            word = misspelt(word, k or "", one_in)
                        if len(word) >= least_length:
                            counts[word] += n
                    if len(counts) > HELD_WORDS:
                        yield told()
        yield told()

    source = df.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(grams: list[tuple[int, str, int]]) -> list[int]:
    """Places of the two bigrams of least summed frequency that do not overlap, among (frequency, bigram, place).

    Over the places from the left: the best single one up to each place, and with it the best pair.
    """
    by_place = sorted((at, f) for f, _, at in grams)
    single: list[tuple[int, int]] = []  # the cheapest of the first so many
    best: tuple[int, int, int] | None = None
    for i, (at, f) in enumerate(by_place):
        apart = next((j for j in range(i - 1, -1, -1) if by_place[j][0] <= at - 2), None)
        if apart is not None:
            other = single[apart]
            best = min(filter(None, [best, (other[0] + f, other[1], at)]))
        single.append(min(single[-1], (f, at)) if single else (f, at))
    return list(best[1:])


class Grams:
    """Bigrams of a word in the order of their frequency, rare ones first."""

    def __init__(self, frequency: dict[str, int]):
        self.frequency = frequency
        self.order = {g: i for i, g in enumerate(sorted(frequency, key=lambda g: (frequency[g], g)))}
        self.bit: dict[str, int] = {}

    def entries(self, word: str) -> tuple[int, list[int], list[int], int]:
        """The order of the last bigram in the prefix, places of the prefix, the pivots, and a mask of the letters."""
        order, size = self.order, len(word)
        grams = sorted((order[word[i : i + 2]], i) for i in range(size - 1))
        last = grams[PREFIX - 1][0]
        prefix = [i for o, i in grams if o <= last]  # all places of the last one
        chosen = pivots([(self.frequency[word[i : i + 2]], word[i : i + 2], i) for _, i in grams[:PREFIX]])
        mask = 0
        for c in word:
            mask |= 1 << ord(c) * 37 % 63
        return last, prefix, chosen, mask


def _key(size: int, side: str, rest: str) -> str:
    return f"{size}{side}{rest}"


def index(words: DataFrame, frequency: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Prefix entries and pivot probes of (word, n). Both have a key: the length of the indexed
    word, the side that is equal, and that side with the bigram."""
    shared = arrow.Shared(words.sparkSession, frequency)
    columns = ["key", "word", "n", "last", "mask"]

    def made(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = shared.as_(Grams).entries
            for batch in batches:
                for lo in range(0, batch.num_rows, 10_000):
                    part = batch.slice(lo, 10_000)
                    rows = []
                    for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        last, prefix, chosen, mask = entries(word)
                        size = len(word)
                        for at in chosen if probing else prefix:
                            before, after = word[: at + 2], word[at:]
                            for change in (-1, 0, 1) if probing else (0,):
                                # the edit is to the right, or to the left, and has letters to take
                                if not probing or change == 1 or at + 2 < size:
                                    rows.append((_key(size + change, "<", before), word, n, last, mask))
                                if not probing or change == 1 or at:
                                    rows.append((_key(size + change, ">", after), word, n, last, mask))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in kinds], columns)

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return words.select("word", "n").mapInArrow(run, "key string, word string, n long, last long, mask long")

    return made(False), made(True)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words with exactly one inserted, deleted or replaced code point.

    ``words`` has distinct words of four code points or more. Frequencies of bigrams go to the tasks;
    there are at most the square of the number of letters.
    """
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    frequency = {r.gram: r.n for r in words.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    entries, probes = index(words, frequency)
    e, p = entries.alias("e"), probes.alias("p")
    met = (
        (F.col("p.key") == F.col("e.key"))
        & (F.col("p.last") <= F.col("e.last"))
        & (F.bit_count(F.col("p.mask").bitwiseXOR(F.col("e.mask"))) <= 2)
        & (F.col("p.word") != F.col("e.word"))
        & (F.levenshtein(F.col("p.word"), F.col("e.word"), 1) == 1)
    )
    least = F.least("p.word", "e.word").alias("a")
    found = p.join(e, met).select(
        least, F.greatest("p.word", "e.word").alias("b"),
        F.when(F.col("p.word") < F.col("e.word"), F.col("p.n")).otherwise(F.col("e.n")).alias("a_n"),
        F.when(F.col("p.word") < F.col("e.word"), F.col("e.n")).otherwise(F.col("p.n")).alias("b_n"),
    )
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return found.distinct().select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) end. Counts grow along forms, so there are no
    circles, and the distance that a round follows doubles."""
    reached = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    for _ in range(MAX_ROUNDS):
        reached = checkpointed(reached)
        if reached.where("open").isEmpty():
            return reached.drop("open")
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        )
    raise RuntimeError("the forms run in a circle")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of (word, n).

    ``form`` is the neighbour of largest n (ties: the least in code-point order) if that n is at least ``times``
    the word's, ``root`` the last word reached by following forms. Words without neighbours have 0 and null. ``words``
    are distinct, not null, and of four code points or more; an empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    words = checkpointed(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = neighbours(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    linked = checkpointed(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(linked.where("form is not null").select("word", "form"))
    joined = words.join(linked, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
