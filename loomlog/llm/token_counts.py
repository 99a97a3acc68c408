"""Word-piece counts without building the pieces.

The vocabulary is a byte trie. Every node has a failure link (where greedy longest-match
goes on once no child fits) and the number of pieces that are popped on the way, so a word is
counted in one pass over its bytes, however long it is.
"""

from __future__ import annotations

import json
import os
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm import arrow

MAX_VOCAB_BYTES = 64 << 20  # what is broadcast is a vocabulary file of at most this size
CACHED_WORDS = 300_000
CACHED_LENGTH = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file in the order of their ids, without special tokens."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told.get("added_tokens", [])}
    alphabet = byte_alphabet()
    ordered = sorted(told["model"]["vocab"].items(), key=lambda x: x[1])
    return [bytes(alphabet[c] for c in token) for token, _ in ordered if token not in special]


class PieceCounter:
    """Counts greedy longest-match pieces of b" " + word; a word that cannot be covered counts as one."""

    def __init__(self, tokens: list[bytes]):
        self.go: dict[int, int] = {}
        ends, parents = [False], [(0, 0)]
        for token in tokens:
            node = 0
            for b in token:
                nxt = self.go.get(node << 8 | b)
                if nxt is None:
                    nxt = self.go[node << 8 | b] = len(ends)
                    ends.append(False)
                    parents.append((node, b))
                node = nxt
            ends[node] = bool(token)
        children: list[list[int]] = [[] for _ in ends]
        for node in range(1, len(ends)):
            children[parents[node][0]].append(node)
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque(children[0])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if ends[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            parent, b = parents[node]
            at, popped = self.fail[parent], self.pops[parent]
            while at >= 0 and (at << 8 | b) not in self.go:
                popped += self.pops[at]
                at = self.fail[at]
            self.fail[node] = -1 if at < 0 else self.go[at << 8 | b]
            self.pops[node] = popped

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for b in b" " + word:
            nxt = go.get(node << 8 | b)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = go.get(node << 8 | b)
            node = nxt
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class WordCounts(dict):
    """Counts by word, up to a bound; then it starts anew."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.counter = PieceCounter(tokens)

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(df: DataFrame, tokens: list[bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` of the whole text.

    Words are runs of other bytes than space, tab and line ends; each is counted with one space
    before it, as greedy longest-match pieces of ``tokens``. Null and empty texts count 0 and 0;
    a word with a byte that no token covers counts as one piece. Equal rows get equal counts.
    Columns named like the added ones are replaced; an empty table stays empty.
    """
    shared = arrow.Shared(df.sparkSession, tokens)

    def make():
        known = shared.as_(WordCounts).__getitem__

        def fn(column: pa.Array) -> list[pa.Array]:
            data, offsets = arrow.texts(column)
            whole = data.tobytes()
            n_words, n_tokens = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = whole[lo:hi].split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known, words)))
            return [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]

        return fn

    return arrow.appended(df, text, make, "n_words long, n_tokens long", keep)
