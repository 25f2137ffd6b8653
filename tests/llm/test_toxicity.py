"""Toxicity: segments against brute force, the fit, held-out accuracy and odd tables."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindcast.llm import toxicity

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Maximal scoring segments by the recursive definition: the best segment (shortest, then leftmost), then both rests."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or s == best[2] and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-5.0, -3.0, -1.0, 1.0, 2.0, 4.0]), max_size=14))
def test_segments(scores):
    found = toxicity.maximal_segments(np.array(scores))
    assert [s for _, _, s in found] == pytest.approx([s for _, _, s in brute_segments(scores)])
    assert all(sum(scores[a:b]) == pytest.approx(s) for a, b, s in found)


def test_without_both_classes():
    assert toxicity.fit([]).score(0.0) == 0.0
    assert toxicity.fit([(1, "a b c", 1)]).score(0.0) == 1.0
    assert 0 <= toxicity.fit([(1, "a b", 1), (2, "a b", 0), (3, None, 0), (4, "", 1)]).score(0.0) <= 1


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    found = toxicity.query(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = both[both.held_out]
    assert len(out) > 300 and (out.predicted == out.toxic).mean() > 0.95
    assert len(found) == 10000 and found.score.between(0, 1).all()


def test_rows(spark):
    rng = np.random.default_rng(1)  # copies count once in the fit, so texts differ
    calm = lambda: " ".join(rng.choice([f"bird{i}" for i in range(400)], 40))
    rows = [(i, calm() + (" you idiot scum " + calm() if i % 3 == 0 else ""), 0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, 0), (61, "", 0), (3, rows[3][1], 0), (62, "x " * 50000, 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.toxicity(docs, model).collect()
    assert len(found) == 64
    assert {r.doc_id: r.predicted for r in found} == {**{i: int(i % 3 == 0) for i in range(60)}, None: 0, 61: 0, 62: 0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    assert toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0))).count() == 64


def test_bounded_sample_keeps_the_class_share(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        t, toxic = list(rng.choice([f"bird{k}" for k in range(3000)], 40)), i % 10 == 0
        if rng.random() < (0.8 if toxic else 0.15):  # wording that both classes have
            t[3:3] = ["idiot", "scum"]
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    mean = lambda model: np.mean([r.score for r in toxicity.toxicity(docs, model).collect()])
    assert mean(toxicity.train(docs, labels)) == pytest.approx(0.1, abs=0.03)
    assert mean(toxicity.train(docs, labels, 600)) == pytest.approx(0.1, abs=0.03)


def test_logistic_map_reaches_its_optimum():
    """Also of many rows whose classes lie apart, where whole Newton steps swing."""
    for high, low in ((2.5, 2.3), (3.0, 2.3), (4.0, 0.8)):
        x = np.concatenate([np.linspace(0, low, 4000), np.linspace(high, high + 2, 2000)])
        y = np.repeat([0.0, 1.0], [4000, 2000])
        weight = np.where(y == 1, 0.3, 1.35)
        slope, offset = toxicity.logistic(x, y, weight)
        rest = weight * (y - 1 / (1 + np.exp(-(slope * x + offset))))
        assert abs(rest @ x - 0.01 * slope) < 1e-3 and abs(rest.sum() - 0.01 * offset) < 1e-3
        assert ((slope * x + offset > 0) == (y == 1)).all()


def test_scores_against_plain_python(spark):
    """Words, their strongest tokens, segments by definition, tail probabilities and their sum, without the operator's arrays."""
    import math
    import re

    from hindcast.llm.textvec import WORD, hash_words, mix

    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        t = list(rng.choice([f"calm{k}" for k in range(300)], 25))
        if i % 4 == 0:
            t[5:5] = list(rng.choice(["idiots", "scumbag", "vermin"], 3))
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, "Scumbag! vermin, É idiotically calm1", 0), (901, None, 0)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.where("doc_id < 200").select("doc_id", "toxic"))
    weight = dict(zip(model.tokens.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        w = [x.encode() for x in re.findall(WORD, (text or "").lower())]
        scores = []
        for x in w:
            own = [int(hash_words([x.decode()])[0])] + [int(mix(hash_prefix(x[:n]) + np.uint64(n))[0]) for n in toxicity.PREFIXES if len(x) > n]
            scores.append(max([weight[t] for t in own if t in weight], default=model.other))
        found = [model.evidence(s, len(w)) for *_, s in brute_segments(scores)]
        evidence = max(sum(e for e in found if e > toxicity.SIGNIFICANT), max(found, default=0.0))
        return model.score(math.log1p(evidence))

    def hash_prefix(data):
        from hindcast.llm.textvec import spans_hash

        return spans_hash(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))

    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert got == pytest.approx({r.doc_id: plain(r.text) for r in docs.collect()}, abs=1e-9)
    assert got[900] > 0.5 > got[1]


def test_texts_that_share_a_passage_stay_in_the_sample():
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(60)), 0) for i in range(20)]
    assert len(toxicity.distinct(rows)) == 20
    assert len(toxicity.distinct([*rows, *((50 + i, t + " more", 0) for i, t, _ in rows)])) == 20
    assert len(toxicity.distinct([*rows, *((50 + i, t, 1) for i, t, _ in rows)])) == 40


def test_driver_holds_no_texts(spark, monkeypatch):
    """The fit runs in a worker, not in the driver's process."""
    made = toxicity.Model
    monkeypatch.setattr(toxicity, "fit", lambda rows, weights=(1.0, 1.0): made(None, None, len(rows), 0.0, 0.0, 1.0, 0.0, 0.0, float(os.getpid())))
    docs = spark.createDataFrame([(i, "a b c", i % 2) for i in range(50)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert model.rate != os.getpid() and model.other == sum(not toxicity.held_out(i) for i in range(50))
