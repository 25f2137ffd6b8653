"""Repeated byte strings against brute force, on texts with planted, periodic and copied passages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hindcast.llm import repeats
from hindcast.llm.textvec import WORD, utf8

L = repeats.LENGTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                gone[i : i + L] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts):
    every = [[c.lower() for c in re.findall(WORD, t or "")] for t in texts]
    n = repeats.PASSAGE
    seen = Counter(tuple(t[i : i + n]) for t in every for i in range(len(t) - n + 1))
    out = []
    for t in every:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[tuple(t[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append((int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), int(gone.sum())))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(int(n)) for n in (60, 90, 110, 140, 300)]
    texts = [None, "", "short", "a" * 399, "b" * 401, "c" * 1200, "xy" * 450, "z" * 400 + "q" + "z" * 400]
    for _ in range(30):
        t = prose(int(rng.integers(20, 200)))
        for s in shared:
            if rng.random() < 0.4:
                a = int(rng.integers(0, max(len(s) - 390, 1)))
                b = a + int(rng.integers(380, 430)) if rng.random() < 0.6 else len(s)
                t += rng.choice(["", " ", "|"]) + s[a:b] + word() + prose(int(rng.integers(0, 60)))
        texts.append(t)
    texts += [texts[-1], texts[-1], texts[-2][:-1] + "!", texts[-3] + texts[-3]]
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, node binary").repartition(5)
        rows = repeats.remove_repeats(docs).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
        assert got == dict(enumerate(brute(texts)))
        assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in rows} == dict(enumerate(brute_passages(texts)))


def test_runs_cover_all_starts():
    texts = corpus(3)
    raw, offsets = utf8(pa.array(texts, pa.string()))
    found = repeats.runs_of(raw, offsets)
    starts = Counter()
    for d, low, high, at in zip(found["doc"].tolist(), found["low"].tolist(), found["high"].tolist(), found["at"].tolist(), strict=True):
        for p in range(low, high + 1):
            starts[d, p] += 1
            assert p <= at <= p + L - repeats.GRAM
    assert set(starts.values()) == {1}
    assert len(starts) == sum(max(0, len((t or "").encode()) - L + 1) for t in texts)


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "é" * 300), (1, "é" * 300)], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    rows = sorted((tuple(r)[:5] for r in repeats.remove_repeats(docs).collect()), key=str)
    assert rows == sorted([(None, 0, 0, 0, empty), (1, 0, 0, 0, empty), (1, 600, 600, 1, empty), (1, 600, 600, 1, empty)], key=str)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
