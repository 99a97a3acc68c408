"""Per-task helpers: Arrow batches in, Arrow batches out, in pieces of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from re import Pattern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


class Shared:
    """A broadcast value and what a worker makes of it, made once per worker and kind."""

    _made: dict[tuple[str, str], object] = {}

    def __init__(self, spark: SparkSession, value: object):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def as_(self, kind: Callable, only: bool = True) -> object:
        """``kind`` of the value; ``only``: what was made before by the same kind is let go."""
        key = (self.key, kind.__qualname__)
        if key not in self._made:
            for old in [k for k in self._made if only and k[1] == key[1]]:
                del self._made[old]
            self._made[key] = kind(self.broadcast.value)
        return self._made[key]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges that hold at most ``limit`` bytes each, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def cut(text: str, boundary: Pattern, limit: int) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, each ending where ``boundary`` matches; longer if it does not."""
    at = 0
    while len(text) - at > limit and (found := boundary.search(text, at + limit)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def appended(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns if None) and the columns ``added`` that a function makes of ``text``.

    ``make`` runs once per task. An input column with the name of an added one is replaced.
    Rows stay in their partition, so nothing is shuffled and a lost task is simply run again.
    """
    schema = T._parse_datatype_string(added)
    taken = {f.name.lower() for f in schema}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text__"))
    out = T.StructType([*source.schema.fields[:-1], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in row_ranges(texts(column)[1]):
                kept_columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*kept_columns, *fn(column.slice(lo, hi - lo))], out.names)

    return source.mapInArrow(run, out)
