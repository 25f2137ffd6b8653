"""The pipeline against the stages in plain Python."""

import os

import pytest

import corpus_pipeline
from hindcast.llm import bpe, decontaminate, toxicity
from hindcast.llm.alignment import edit_distances, local_scores
from hindcast.llm.textvec import words
from tests.llm.test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def hashes(text):
    import pyarrow as pa

    return words(pa.array([text], pa.string())).hash


def brute_classes(docs):
    """Least id of each class of (id, text)."""
    w = {d: hashes(t) for d, t in docs}
    text, root = dict(docs), {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(root)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if text[a] == text[b] or min(len(w[a]), len(w[b])) >= max(0.8 * max(len(w[a]), len(w[b])), 1)]
    limits = [int(0.2 * max(len(w[a]), len(w[b])) + 1e-9) for a, b in pairs]
    found = edit_distances([(w[a], w[b]) for a, b in pairs], limits)
    for (a, b), d, limit in zip(pairs, found, limits, strict=True):
        if text[a] == text[b] or d <= limit:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in ids}


def test_stages_and_order():
    assert [f.__module__.rpartition(".")[2] for _, f in corpus_pipeline.STAGES] == ["toxicity", "lines", "neardup", "decontaminate", "bpe"]


def test_run_equals_plain_python(spark):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if not scores[r.doc_id]]
    left = list(brute_lines(left).items())
    classes = brute_classes(left)
    left = [(d, t) for d, t in left if classes[d] == d]
    items = [hashes(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = set()
    for d, t in left:
        found = local_scores(items, [hashes(t)] * len(items))
        if any(s >= decontaminate.LEAST * len(q) for (s, _), q in zip(found, items, strict=True)):
            leaked.add(d)
    want = {d: t for d, t in left if d not in leaked}
    assert {d: r.text for d, r in rows.items()} == want
    encoder = bpe.Encoder(bpe.tokenizer_path())
    for d, t in want.items():
        ids = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert rows[d].n_tokens == len(ids) and rows[d].n_chars == len(t)


def odd_tables(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, key double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "p q r s t u v w x y z")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, further columns and a table of labels without rows."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, "a b c d e f g h", "en", "s", 15, "x", 1.0), (1, "a b c d e f g h", "en", "s", 15, "x", 1.0), (2, "A b c, d e f g h", None, None, None, None, None),
        (3, None, None, None, None, None, None), (4, None, None, None, None, None, None), (5, "", "en", "s", 0, None, None), (None, "one two three four five six", None, None, 27, None, None),
        (6, "x1 p q r s t u v w x y z x2", "en", "s", 26, None, None), (7, long, "en", "s", len(long), None, None), (8, "line one is here\nown words of eight stay", "en", "s", 40, None, None),
    ]
    found = corpus_pipeline.run(spark, odd_tables(spark, tmp_path, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r.doc_id: r for r in found.collect()}
    # 2 loses its line to 1; it is then empty, like 3 to 5, of which the least id stays; 6 holds a test item
    assert set(kept) == {1, 2, None, 7, 8} and found.count() == 5
    assert kept[1].text == "a b c d e f g h" and kept[2].text == "" and kept[2].n_chars == 0
    assert kept[7].text == long and kept[7].n_tokens >= 60_000 and kept[2].n_tokens == 0


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0


def test_tokens_stage(spark):
    rows = [(1, "Hello  world", "en", "s", 12), (2, None, None, None, None), (2, None, None, None, None), (None, "", "x", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.lang, r.n_tokens) for r in bpe.add_tokens(spark, docs, "").collect()), key=str)
    ids = bpe.Encoder(bpe.tokenizer_path()).tokenizer.encode("Hello  world", add_special_tokens=False).ids
    assert got == sorted([(1, "Hello  world", "en", len(ids)), (2, None, None, 0), (2, None, None, 0), (None, "", "x", 0)], key=str)
    assert bpe.add_tokens(spark, docs.limit(0), "").count() == 0
