"""Words of many texts at once: where they are, their hashes, and hashes of runs of them.

All of it is numpy over the bytes of an Arrow column, with temporaries of about a megabyte.
Hashes only find candidates or name features; what must be exact is compared word by word,
or rests on two independent 64-bit hashes where the callers say so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(*word: range) -> np.ndarray:
    table = np.zeros(256, bool)
    for part in word:
        table[part.start : part.stop] = True
    return table


ALNUM = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
SPACED = ~byte_class(range(0x09, 0x0E), range(0x20, 0x21))
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += 0x20
AS_IS = np.arange(256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK)
        p = _ODD[base]
        made = []
        for x in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


@dataclass
class Words:
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # the byte after it
    bounds: np.ndarray  # the words of row i are bounds[i] .. bounds[i + 1]
    hashes: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def rows_end(self) -> np.ndarray:
        return np.repeat(self.bounds[1:], np.diff(self.bounds))


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, folded: np.ndarray = AS_IS) -> Words:
    """The runs of ``word`` bytes of each row, hashed after ``folded`` was applied to each byte."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = word[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + CHUNK, side="right")), a + 1)
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power(hi - lo, 0)
        summed = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((folded[data[lo:hi]] + np.uint64(1)) * up[: hi - lo], out=summed[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = mixed((summed[e] - summed[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        a = b
    return Words(starts, ends, np.searchsorted(starts, offsets).astype(np.int64), hashes)


def run_hashes(hashes: np.ndarray, k: int, base: int = 1) -> np.ndarray:
    """A hash of each run of k, whichever row it is in; entry i is the run that starts at i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        up, down = _power(hi - lo + k, base)
        summed = np.zeros(hi - lo + k, np.uint64)
        np.cumsum(hashes[lo : hi + k - 1] * up[: hi - lo + k - 1], out=summed[1:])
        out[lo:hi] = mixed((summed[k:] - summed[:-k]) * down[: hi - lo])
    return out


def whole_runs(words: Words, k: int) -> np.ndarray:
    """For each entry of run_hashes: does the run lie in one row?"""
    n = max(0, len(words.hashes) - k + 1)
    return np.arange(n) + k <= words.rows_end()[:n]
