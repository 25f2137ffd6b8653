"""Vectorised text primitives over Arrow string buffers: words, their hashes, and hashes of word n-grams.

A word is a maximal run of bytes that are ASCII letters, ASCII digits or part of a non-ASCII
character; A-Z count as a-z. One pass of NumPy over the UTF-8 buffer serves a whole slice of
documents, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_VALUE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Words of a slice of texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = _LOWER[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = _IS_WORD[low]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.raw, self.low, self.offsets = raw, low, offsets
        self.first = np.searchsorted(self.start, offsets)
        self._prefix = prefix_hash(low)
        self.hash = self.span_hash(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the lower-cased texts."""
        return hash_between(*self._prefix, start, end)

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def doc_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array) -> Words:
    return Words(*utf8(column))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash of bytes, and the inverse powers that move a difference to position 0."""
    return prefix_sums(_VALUE[data])


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a sequence of 64-bit values."""
    n = len(values)
    power = np.full(n + 1, BASE, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * power[:-1], out=total[1:])
    inverse = np.full(n + 1, BASE_INV, dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return total, inverse


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return hash_between(*prefix_hash(data), start, end)


def hash_between(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hash_words(tokens: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those that Words gives."""
    raw = [t.encode() for t in tokens]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(r) for r in raw], dtype=np.int64)
    return spans_hash(_LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)], starts, ends)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that stay in one text, and the word each starts at."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + size]
    inside = np.ones(size, dtype=bool)
    ends = first[1:-1]
    for k in range(1, n):
        at = ends - k
        inside[at[(at >= 0) & (at < size)]] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at
