"""The transform merge against brute force, and as a second opinion on repeats.py."""

from collections import Counter

import numpy as np
import pytest

from hindcast.llm import bwt


@pytest.mark.parametrize("seed", range(6))
def test_repeated_starts(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 99 + seed % 3, int(rng.integers(0, 60)), dtype=np.uint8)) for _ in range(1 + seed)]
    texts[0] += texts[-1][:20]
    for length in (1, 3, 8):
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = {(d, i) for d, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}
        assert bwt.repeated_starts(texts, length) == want


def test_merge_orders_suffixes():
    merged, common = bwt.merge(bwt.of_text(b"banana", 0), bwt.of_text(b"bandana", 1))
    texts = [b"banana", b"bandana"]
    suffixes = [texts[t][s:] for t, s in zip(merged.text.tolist(), merged.start.tolist(), strict=True)]
    assert suffixes == sorted(suffixes)
    prefix = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    assert common[1:].tolist() == [prefix(x, y) for x, y in zip(suffixes, suffixes[1:], strict=False)]


def test_agrees_with_repeats(spark):
    from hindcast.llm import repeats
    from tests.llm.test_repeats import corpus

    texts = corpus(5)[:24]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    covered = [set() for _ in texts]
    for d, s in bwt.repeated_starts([(t or "").encode() for t in texts], repeats.LENGTH):
        covered[d].update(range(s, s + repeats.LENGTH))
    assert got == {d: len(c) for d, c in enumerate(covered)}
