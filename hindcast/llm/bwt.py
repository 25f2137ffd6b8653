"""Burrows-Wheeler transforms of shards and their merge by interleave refinement.

The merge starts with one shard before the other and refines the interleaving a symbol a pass: a stable
distribution of the interleaving by the symbols before it orders all suffixes by one symbol more. Blocks
of suffixes that agree so far come with it, so the depth at which neighbours part is their common
prefix, and blocks of two or more at depth n are the repeated strings of n bytes. No suffix is sorted
again.

This is the method that repeats.py would use if it could: it takes a pass over all bytes for each byte
of the repeat length, in each of the levels of merges, with both transforms in one place. README.md has
its figures. It serves bounded corpora, and the tests of repeats.py as a second opinion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Symbols before the suffixes in their order (0 at the start of a text), and where each suffix starts."""

    before: np.ndarray
    text: np.ndarray
    start: np.ndarray


def of_text(data: bytes, text: int) -> Transform:
    """The transform of one text with an end mark; its suffixes are sorted by doubling."""
    n = len(data) + 1
    symbols = np.append(np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1, 0)
    rank, width = symbols, 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        order = np.lexsort((after, rank))
        pairs = np.stack([rank[order], after[order]])
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.cumsum(np.append(False, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))
        if new.max() == n - 1:
            break
        rank, width = new, 2 * width
    order = np.argsort(new)
    return Transform(symbols[order - 1].astype(np.uint16), np.full(n, text), order)


def merge(a: Transform, b: Transform, most: int | None = None) -> tuple[Transform, np.ndarray]:
    """The transform of both, and each suffix's common prefix with the one before it, up to `most`."""
    n, m = len(a.before), len(b.before)
    side = np.repeat(np.array([False, True]), [n, m])
    block = np.zeros(n + m, dtype=np.int64)
    common = np.zeros(n + m, dtype=np.int64)
    both = (a.before, b.before)
    depth = 0
    while most is None or depth < most:
        before = np.empty(n + m, dtype=np.uint16)
        before[~side], before[side] = both
        order = np.argsort(before, kind="stable")
        symbol, parent = before[order], block[order]
        # end marks differ from each other, so texts never run into one another
        fresh = np.append(True, (symbol[1:] != symbol[:-1]) | (parent[1:] != parent[:-1]) | (symbol[1:] == 0))
        same = ~fresh
        new_side, new_block = side[order], np.cumsum(fresh) - 1
        depth += 1
        common[same] = depth
        if np.array_equal(new_block, block) and np.array_equal(new_side, side):
            break
        side, block = new_side, new_block
    out = []
    for x, y in ((a.before, b.before), (a.text, b.text), (a.start, b.start)):
        joined = np.empty(n + m, dtype=x.dtype)
        joined[~side], joined[side] = x, y
        out.append(joined)
    return Transform(*out), common


def repeated_starts(texts: list[bytes], length: int) -> set[tuple[int, int]]:
    """(text, start) of all strings of `length` bytes that start anywhere else too."""
    shards = [of_text(t, i) for i, t in enumerate(texts)]
    common = np.zeros(len(shards[0].before) if shards else 0, dtype=np.int64)
    while len(shards) > 1:
        merged = [merge(x, y, length) for x, y in zip(shards[::2], shards[1::2], strict=False)]
        common = merged[-1][1]
        shards = [t for t, _ in merged] + (shards[-1:] if len(shards) % 2 else [])
    if not shards:
        return set()
    if len(texts) == 1:
        empty = Transform(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64))
        shards[0], common = merge(shards[0], empty, length)
    found, hit = shards[0], common >= length
    hit[:-1] |= hit[1:].copy()
    return set(zip(found.text[hit].tolist(), found.start[hit].tolist(), strict=True))
