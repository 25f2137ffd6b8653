"""Alignments of word sequences, many pairs in step: banded edit distance and local alignment."""

from __future__ import annotations

import numpy as np

CELLS = 1 << 17
INF = np.int32(1 << 28)


def trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop the common prefix and suffix, which never change the edit distance."""
    n = min(len(a), len(b))
    same = a[:n] != b[:n]
    head = int(same.argmax()) if same.any() else n
    a, b = a[head:], b[head:]
    n -= head
    if n:
        same = a[-n:] != b[-n:]
        tail = int(same[::-1].argmax()) if same.any() else n
        if tail:
            a, b = a[:-tail], b[:-tail]
    return a, b


def bag_bound(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words that the multisets don't share."""
    values, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(values)
    shared = np.minimum(np.bincount(counts[: len(a)], minlength=n), np.bincount(counts[len(a) :], minlength=n)).sum()
    return max(len(a), len(b)) - int(shared)


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> list[int]:
    """Edit distance of each pair, or limit + 1 where it exceeds the limit.

    Bands start narrow and double until the distance fits in the band or the band covers the limit,
    so that the work of near copies follows their distance rather than their length. Widths are powers
    of two: pairs of one width go in step, whatever their lengths and limits.
    """
    out = [0] * len(pairs)
    todo: dict[int, list[tuple[int, np.ndarray, np.ndarray, int]]] = {}
    for i, ((a, b), limit) in enumerate(zip(pairs, limits, strict=True)):
        a, b = trim(a, b)
        out[i] = limit + 1
        least = abs(len(a) - len(b))
        if not len(a) or not len(b):
            out[i] = min(least, limit + 1)
        elif least <= limit and bag_bound(a, b) <= limit:
            todo.setdefault(max(8, 1 << (least - 1).bit_length() if least else 0), []).append((i, a, b, limit))
    while todo:
        width = min(todo)
        rows = sorted(todo.pop(width), key=lambda x: len(x[1]))
        size = max(1, CELLS // (2 * width + 1))
        for at in range(0, len(rows), size):
            group = rows[at : at + size]
            for row, d in zip(group, banded([(a, b) for _, a, b, _ in group], width), strict=True):
                i, _, _, limit = row
                if d <= width:
                    out[i] = min(d, limit + 1)
                elif width < limit:
                    todo.setdefault(2 * width, []).append(row)
    return out


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> list[int]:
    """Edit distances within a band of diagonals -width..width; larger ones come out larger than width."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, cols = int(n.max()), int(max(n.max() + width, m.max()))
    size = len(pairs)
    left = np.zeros((size, rows), dtype=np.uint64)
    right = np.zeros((size, cols + 2 * width + 1), dtype=np.uint64)
    valid = np.zeros(right.shape, dtype=bool)
    for p, (a, b) in enumerate(pairs):
        left[p, : len(a)] = a
        right[p, width : width + len(b)] = b
        valid[p, width : width + len(b)] = True
    k = np.arange(-width, width + 1, dtype=np.int32)
    row = np.where(k < 0, INF, k)[None, :].repeat(size, axis=0)
    out = np.full(size, INF)
    for i in range(rows):
        span = slice(i, i + 2 * width + 1)
        cost = (right[:, span] != left[:, i : i + 1]) | ~valid[:, span]
        new = row + cost
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.minimum.accumulate(new - k, axis=1) + k
        if i < width:
            new[:, : width - i - 1] = INF
        row = new
        for p in np.flatnonzero(n == i + 1).tolist():
            at = int(m[p] - n[p]) + width
            if 0 <= at <= 2 * width:
                out[p] = row[p, at]
    return out.tolist()


def local_scores(queries: list[np.ndarray], targets: list[np.ndarray], match: int = 1, mismatch: int = -1, gap: int = -1) -> list[tuple[int, int]]:
    """Smith-Waterman with linear gaps: best score of each pair and the end of its alignment in the target."""
    out: list[tuple[int, int]] = [(0, 0)] * len(queries)
    order = sorted(range(len(queries)), key=lambda i: (len(targets[i]), len(queries[i])))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end - at + 1) * max(len(targets[order[end]]), 1) <= max(CELLS, len(targets[order[end]]) + 1):
            end += 1
        end = max(end, at + 1)
        group = order[at:end]
        rows, cols = max(len(queries[i]) for i in group), max(len(targets[i]) for i in group)
        q = np.zeros((len(group), rows), dtype=np.uint64)
        t = np.zeros((len(group), cols), dtype=np.uint64)
        inq, int_ = np.zeros(q.shape, dtype=bool), np.zeros(t.shape, dtype=bool)
        for p, i in enumerate(group):
            q[p, : len(queries[i])] = queries[i]
            t[p, : len(targets[i])] = targets[i]
            inq[p, : len(queries[i])] = True
            int_[p, : len(targets[i])] = True
        h = np.zeros((len(group), cols + 1), dtype=np.int32)
        best, where = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        ramp = np.arange(cols + 1, dtype=np.int32) * -gap
        for r in range(rows):
            same = (t == q[:, r : r + 1]) & int_ & inq[:, r : r + 1]
            new = np.maximum(h + gap, 0)
            new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + np.where(same, match, mismatch))
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp
            top = h.argmax(axis=1)
            value = h[np.arange(len(group)), top]
            better = value > best
            best[better], where[better] = value[better], top[better]
        for p, i in enumerate(group):
            out[i] = (int(best[p]), int(where[p]))
        at = end
    return out
