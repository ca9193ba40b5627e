"""Vectorised text kernels over Arrow string buffers: words, word hashes, n-gram hashes, winnowing.

A word is a maximal run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r) in the UTF-8 text.
Whole texts are processed, some hundred kilobytes of documents at a time.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 19  # bytes at a time: what a kernel holds fits in the cache, and workers stay small
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE, NBASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up, down = np.full(size, base, np.uint64), np.full(size, U(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * CHUNK:  # tables for one huge document aren't kept
            _tables[int(base)] = have
    return have


@dataclass
class Words:
    """Words of documents lo..hi-1 of a batch: hash of each, byte range in ``data``, first word of each
    document (and the end), first byte of each document (and the end)."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def strings(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(col: pa.Array, hashed: bool = True, limit: int = CHUNK) -> Iterator[Words]:
    offsets, data = strings(col)
    for lo, hi in pieces(offsets, limit):
        base = int(offsets[lo])
        own = data[base : int(offsets[hi])]
        at = (offsets[lo : hi + 1] - base).astype(np.int64)
        solid = ~SPACE[own]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cut = at[(at > 0) & (at < len(own))]
        begins[cut] |= solid[cut]
        ends[cut - 1] |= solid[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, at)
        h = np.zeros(0, np.uint64)
        if hashed:
            up, down = _powers(BASE, len(own) + 1)
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(BYTE[own] * up[: len(own)], out=total[1:])
            h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        yield Words(lo, hi, own, start, end, first, h, at)


class Spans:
    """Hashes of ranges of a sequence of hashes, each in constant time."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        up, self.down = _powers(NBASE, self.n + 1)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[: self.n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Of every range of n items, by its start."""
        if self.n < n:
            return np.zeros(0, np.uint64)
        m = self.n - n + 1
        return mix((self.total[n:] - self.total[:m]) * self.down[:m] + U(n))


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w neighbours, by the first of them."""
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def winnow(grams: np.ndarray, first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of the n-grams that are the least of some ``window`` neighbouring n-grams of one document, so that any
    two equal runs of n + window - 1 words have an equal n-gram chosen at the same place.  Ties are all chosen."""
    total = int(first[-1])
    if len(grams) < window or total < n + window - 1:
        return np.zeros(0, np.int64)
    low = _slide(grams, window, np.minimum)  # by first n-gram of the window
    last = np.repeat(first[1:], np.diff(first))[: len(low)]
    inside = np.arange(len(low)) + (n + window - 1) <= last
    low = np.where(inside, low, U(0))
    pad = np.zeros(window - 1, np.uint64)
    best = _slide(np.concatenate([pad, low, pad]), window, np.maximum)  # best[p]: greatest low of the windows that hold p
    return np.flatnonzero((best[: len(grams)] == grams) & (best[: len(grams)] > 0))
