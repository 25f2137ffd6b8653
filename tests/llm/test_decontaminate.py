"""Decontamination against a plain search, with edited, moved and chance passages."""

import numpy as np

from hindcast.llm import decontaminate


def make(rng):
    common = ["the", "of", "and", "to", "in"]
    rare = [f"q{i}" for i in range(3000)]
    prose = lambda n: [str(rng.choice(common if rng.random() < 0.4 else rare)) for _ in range(n)]
    items = [prose(int(rng.integers(14, 60))) for _ in range(40)]
    docs, want = [], {}
    for i in range(200):
        t = prose(int(rng.integers(30, 300)))
        if i % 3 == 0:
            k = int(rng.integers(len(items)))
            own = list(items[k])
            for _ in range(int(rng.integers(0, 1 + len(own) // 10))):
                own[int(rng.integers(len(own)))] = "changed"
            if i % 2:
                del own[len(own) // 2]
            at = int(rng.integers(len(t)))
            t[at:at] = own
            want[i] = k
        elif i % 3 == 1:
            k = int(rng.integers(len(items)))
            t[5:5] = items[k][:5]
        docs.append(" ".join(t))
    return [" ".join(x) for x in items], docs, want


def test_leaks(spark):
    items, docs, want = make(np.random.default_rng(6))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[0]), (93, "changed only")], "item_id long, text string")
    table = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(docs)] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double").repartition(4)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table, bench).collect()}
    assert {k for k in got if k[1] < 90} == set(want.items())
    assert {d for d, k in got if k == 92} == {d for d, k in want.items() if k == 0}
    for (d, k), r in got.items():
        words = docs[d].split()[r.first_word : r.end_word]
        assert r.score >= 0.5 and set(words) & set((items + [""] * 60)[k].split() or words)


def test_frequent_passage_keeps_its_seeds(spark):
    items, _, _ = make(np.random.default_rng(7))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start{i} " + items[3] + f" end{i}") for i in range(300)], "doc_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 3) for i in range(300)}
    assert all(r.score == 1 and r.first_word == 1 for r in found)


def test_blocks_and_empty(spark, monkeypatch):
    items, docs, want = make(np.random.default_rng(8))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == set(want.items())
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0
    assert decontaminate.leaks(table.limit(0), bench).count() == 0


def test_edited_copy_that_is_repeated(spark):
    rng = np.random.default_rng(12)
    items = [[f"q{j}" for j in rng.integers(0, 3000, int(n))] for n in rng.integers(40, 100, 12)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    docs, want = [], set()
    for k, item in enumerate(items):
        own = list(item)
        share = (0.2, 0.22, 0.24)[k % 3]
        for i in rng.choice(len(own), int(share * len(own)), replace=False).tolist():
            own[i] = f"changed{k}x{i}"
        for c in range(300 if k < 3 else 40):
            want.add((len(docs), k))
            docs.append(f"start{c} before{k} " + " ".join(own) + f" after{c}")
        docs.append(f"chance{k} " + " ".join(item[4:7]) + " alone")
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(4)
    found = decontaminate.leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.score >= 0.5 for r in found)


def test_rarest_seeds():
    rows = [(0, " ".join(f"a{i}" for i in range(12))), (1, "x y z"), (2, None)]
    items = decontaminate.prepare(rows)
    distinct = np.unique(items.seeds)
    counts = np.zeros(len(distinct), dtype=np.int64)
    common = items.seeds[(items.owner == 0) & (items.place == 4)]
    counts[np.searchsorted(distinct, common)] = 1000
    kept = decontaminate.rarest(items, counts)
    # of 10 trigrams of 12 words, three changed words spoil 9 at most; all 10 stay, or 9 + 1
    assert (kept.owner == 0).sum() == 10 and (kept.owner == 1).sum() == 1
    rows = [(0, " ".join(f"a{i}" for i in range(42)))]
    items = decontaminate.prepare(rows)
    counts = np.zeros(40, dtype=np.int64)
    often = np.searchsorted(np.unique(items.seeds), items.seeds[items.place >= 31])
    counts[often] = decontaminate.COMMON  # not more than copies of a part would explain
    assert len(decontaminate.rarest(items, counts).seeds) == 40
    counts[often] = 1000
    kept = decontaminate.rarest(items, counts)
    assert len(kept.seeds) == 31 and kept.place.max() <= 31 + 9 and set(range(31)) <= set(kept.place.tolist())


def test_stage_does_not_depend_on_blocks(spark, monkeypatch):
    items, docs, want = make(np.random.default_rng(9))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(900, None, None, None, None), (901, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(decontaminate, "table", lambda *a: bench)
    left = []
    for size in (5, 20_000):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        left.append({r.doc_id for r in decontaminate.keep_unleaked(spark, frame, "").collect()})
    assert left[0] == left[1] == (set(range(len(docs))) - set(want)) | {900, 901}


def test_repeated_rows_and_a_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    long = "w " * 200_000 + item + " v" * 200_000
    docs = spark.createDataFrame([(1, "a " + item), (1, "a " + item), (None, long), (3, None)], "doc_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.score, r.first_word) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert found == sorted([(1, 1, 1.0, 1)] * 4 + [(None, 1, 1.0, 200_000)] * 2, key=str)
