"""Byte-level BPE from a file of token ranks, by the tiktoken library inside the tasks.

Ids are packed little-endian, as training readers map them into memory. Long texts are cut first, where the
library's own pattern must end a match; a part that offers no such place is cut into its matches
here, so that neither a megabyte of blanks nor one endless word ends the library's pattern search.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import arrow
from loomlog.llm.token_counts import MAX_VOCAB_BYTES

LONG_TEXT = 1 << 16
# No match goes on from a letter or digit to another kind, or from what is no blank to a blank.
SAFE = regex.compile(r"(?<=[A-Za-z])(?=[\x00-\x40\x5B-\x60\x7B-\x7F])|(?<=[0-9])(?=[\x00-\x2F\x3A-\x7F])|(?<=[^\s\x1C-\x1F])(?=[ \t\r\n])")


def read_ranks(path: str, pattern: str) -> dict:
    """Token bytes to ranks of a rank file, with the pattern that cuts texts before the merges.

    Read once on the driver, at most 64 MB, and broadcast to the tasks.
    """
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return {"ranks": {base64.b64decode(token): int(rank) for token, rank in lines}, "pattern": pattern}


class Coder:
    def __init__(self, told: dict):
        ranks, pattern = told["ranks"], told["pattern"]
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # takes whatever it is given as one match
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return np.array(self.library.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(ids, "<u4") for ids in self._long(text)])

    def _long(self, text: str) -> Iterator[list[int]]:
        for part in arrow.cut(text, SAFE, LONG_TEXT):
            if len(part) <= 2 * LONG_TEXT:
                yield self.library.encode_ordinary(part)
            else:
                for found in self.matches.finditer(part):
                    yield self.whole.encode_ordinary(found.group())

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


def encode(df: DataFrame, told: dict, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``into``, the ids of the whole text as a binary of little-endian unsigned 32-bit integers.

    Special tokens' strings are ordinary text. Null counts as empty and gives an empty binary. Texts of any length are cut step by step. A column named
    ``into`` is replaced; equal rows get equal ids; an empty table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, told)

    def make():
        coder = shared.as_(Coder)
        return lambda column: [pa.array([coder.encode(t or "").tobytes() for t in column.to_pylist()], pa.binary())]

    return arrow.appended(df, text, make, f"`{into}` binary", keep)


def decode(df: DataFrame, told: dict, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``into``, the raw bytes that packed ids stand for, as a binary: ids may end within a character.

    Null counts as empty; an id that no token has is an error. A column named ``into`` is replaced; an empty
    table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, told)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids__"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.as_(Coder)
        for batch in batches:
            packed = batch.column(len(kept))
            sizes = pc.fill_null(pc.binary_length(packed), 0).to_numpy()
            for lo, hi in arrow.row_ranges(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
                made = [coder.decode(np.frombuffer(p or b"", "<u4")) for p in packed.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), pa.array(made, pa.binary())], out.names)

    return source.mapInArrow(run, out)
