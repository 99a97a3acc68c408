"""Byte-pair encoding in linear time, and decoding through an offset table.

A piece of text is covered from the left with its longest token; a token is kept only if it
would not have been merged otherwise with the one before it, else a shorter one is tried and,
when none is left, the token before it is taken back. A position that failed once is never
tried again, which makes the walk linear. The result is that of the merge loop.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import arrow
from loomlog.llm.token_counts import MAX_VOCAB_BYTES, byte_alphabet

# Fixed value: the pattern by which byte-level vocabularies of this family cut a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 150_000
CACHED_PAIRS = 300_000
CACHED_LENGTH = 48
LONG_TEXT = 1 << 20
_GAP = "\U0010ffff"  # between pieces; no byte maps to it


def read_vocabulary(path: str) -> dict:
    """Tokens by id, the pair that makes each token, and the special tokens of a vocabulary file.

    Read once on the driver, at most 64 MB, and broadcast to the tasks.
    """
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    ids, alphabet = told["model"]["vocab"], byte_alphabet()
    tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        tokens[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    pairs: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
    last = -1
    for merge in told["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = ids[left + right]
        if made <= last:
            raise ValueError("ids must follow the order of the merges")
        last = made
        pairs[made] = (ids[left], ids[right])
    return {"tokens": tokens, "pairs": pairs, "special": special}


class Encoder:
    def __init__(self, vocabulary: dict):
        self.pairs = vocabulary["pairs"]
        self.special: dict[str, int] = vocabulary["special"]
        names = set(self.special.values())
        self.made = {left << 32 | right: i for i, (left, right) in enumerate(self.pairs) if left != i}
        spelled = {t.decode("latin-1"): i for i, t in enumerate(vocabulary["tokens"]) if t and i not in names}
        self.length = [len(t) for t in vocabulary["tokens"]]
        self.whole = spelled
        # token -> the longest token that it starts with
        self.shorter = [-1] * len(self.length)
        for token, i in spelled.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := spelled.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        # Over the text read backwards, the longest match that ends at a byte is the longest token
        # that starts there in the text.
        # A single byte is the shortest of them, so it is filled in beforehand.
        self.single = {token: i for token, i in spelled.items() if len(token) == 1} | {_GAP: -1}
        self.longest = ahocorasick.Automaton()
        for token, i in spelled.items():
            if len(token) > 1:
                self.longest.add_word(token[::-1], i)
        self.longest.make_automaton()
        self.cut = regex.compile(PIECES)
        self.names = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}

    def stays(self, left: int, right: int) -> bool:
        """Do both tokens survive when their texts are merged as one?"""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, the latest first: no pair across the border may merge before it."""
        made, pairs = self.made, self.pairs
        before = len(pairs)
        while True:
            across = made.get(left << 32 | right)
            if across is not None and across < before:
                return False
            if left > right:
                halves = pairs[left]
                if halves[0] != left:
                    before, left = left, halves[1]
                    continue
                halves = pairs[right]
                if halves[0] == right:
                    return True
                before, right = right + 1, halves[0]
            else:
                halves = pairs[right]
                if halves[0] != right:
                    before, right = right + 1, halves[0]
                    continue
                halves = pairs[left]
                if halves[0] == left:
                    return True
                before, left = left, halves[1]

    def covered(self, longest: list[int]) -> list[int]:
        """The tokens of a piece, given the longest token at each of its bytes."""
        n, length, shorter, stays = len(longest), self.length, self.shorter, self.stays
        out: list[int] = []
        failed = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not failed[end] and (not out or stays(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                failed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def encode_new(self, pieces: list[str]) -> list[list[int]]:
        """Tokens of distinct pieces; one pass of the automaton serves all of them."""
        spelled = [p.encode().decode("latin-1") for p in pieces]
        out: list = [None] * len(pieces)
        todo = []
        for i, s in enumerate(spelled):
            if (whole := self.whole.get(s)) is not None:
                out[i] = [whole]
            else:
                todo.append(i)
        joined = _GAP.join([spelled[i] for i in todo])[::-1]
        longest = [*map(self.single.__getitem__, joined)]
        last = -1
        for end, token in self.longest.iter(joined):  # the longest first at each end
            if end != last:
                longest[end] = token
                last = end
        longest.reverse()
        at = 0
        for i in todo:
            n = len(spelled[i])
            out[i] = self.covered(longest[at : at + n])
            at += n + 1
        return out

    def _chunks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while chunk := list(islice(found, 1 << 16)):
            yield chunk

    def _plain(self, text: str) -> list[bytes]:
        out, known = [], self.known
        for pieces in self._chunks(text):
            new = [p for p in set(pieces) if p not in known]
            extra: dict[str, bytes] = {}
            if new:
                if len(known) + len(new) > CACHED_PIECES:
                    known.clear()
                    new = list(set(pieces))
                for p, ids in zip(new, self.encode_new(new), strict=True):
                    packed = np.array(ids, np.int32).tobytes()
                    if len(p) <= CACHED_LENGTH and len(known) < CACHED_PIECES:
                        known[p] = packed
                    else:
                        extra[p] = packed
            if extra:
                out += [known.get(p) or extra[p] for p in pieces]
            else:
                out += map(known.__getitem__, pieces)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as int32; the strings of special tokens stand for these."""
        if self.names is None or not any(name in text for name in self.special):
            return np.frombuffer(b"".join(self._plain(text)), np.int32)
        out: list[bytes] = []
        for part in self.names.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            else:
                out += self._plain(part)
        return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    """All tokens' bytes in one row, and where each begins."""

    def __init__(self, vocabulary: dict):
        tokens = vocabulary["tokens"]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a row of ids, and where those of each id begin among them."""
        begins = self.begins[ids]
        sizes = self.begins[ids + 1] - begins
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[np.repeat(begins - at[:-1], sizes) + np.arange(at[-1])], at


def encode(df: DataFrame, vocabulary: dict, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``into``, the token ids of the whole text as an array of int.

    Null counts as empty and gives an empty array. Texts of any length are cut into pieces step by
    step. A column named ``into`` is replaced; equal rows get equal ids; an empty table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, vocabulary)

    def make():
        encoder = shared.as_(Encoder)

        def fn(column: pa.Array) -> list[pa.Array]:
            rows = [encoder.encode(t or "") for t in column.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]

        return fn

    return arrow.appended(df, text, make, f"`{into}` array<int>", keep)


def decode(df: DataFrame, vocabulary: dict, ids: str = "ids", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``into``, the text that the ids in ``ids`` stand for; bytes that are no UTF-8 become U+FFFD.

    A null array counts as empty; a null or unknown id inside one is an error. A column named
    ``into`` is replaced; an empty table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, vocabulary)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids__"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.as_(Decoder)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            if column.null_count:
                column = pa.array([x if x is not None else [] for x in column.to_pylist()], column.type)
            ends = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy()
            for lo, hi in arrow.row_ranges(ends * 4):
                got, at = decoder.joined(values[ends[lo] : ends[hi]])
                cuts, whole = at[ends[lo : hi + 1] - ends[lo]].tolist(), got.tobytes()
                texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                kept_columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(texts, pa.string())], out.names)

    return source.mapInArrow(run, out)
