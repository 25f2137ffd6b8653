"""Line dedup against all pairs in plain Python."""

import re

import numpy as np

from hindcast.llm import lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(line):
    return frozenset(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def brute(docs):
    """Kept text by document; docs are (doc_id, text) with distinct ids."""
    every = [(d, i, tokens(line)) for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)) if t is not None for i, line in enumerate(t.split("\n"))]
    gone = set()
    for j, (d, i, y) in enumerate(every):
        if y and any(x and len(x & y) >= 0.8 * len(x | y) - 1e-9 for _, _, x in every[:j]):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def make(seed):
    rng = np.random.default_rng(seed)
    common, rare = ["the", "Of", "and", "to"], [f"w{i}" for i in range(500)]
    line = lambda: [str(rng.choice(common if rng.random() < 0.4 else rare)) for _ in range(int(rng.integers(1, 30)))]
    pool = [line() for _ in range(25)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(int(rng.integers(0, 8))):
            words = list(pool[int(rng.integers(25))]) if rng.random() < 0.7 else line()
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = str(rng.choice(rare))
            own.append(str(rng.choice([" ", ", "])).join(words) + str(rng.choice(["", ".", " !"])))
        docs.append((i, "\n".join(own)))
    hot = [f"h{i}" for i in range(40)]
    for i in range(80):  # a family of near copies
        words = list(hot)
        words[i % 40] = f"edit{i}"
        docs.append((100 + i, "The common line.\n" + " ".join(words)))
    return [*docs, (None, "Null id line one\nthe common line"), (300, None), (301, ""), (302, "\n\n...\n"), (303, "é É ß " * 3000)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = make(seed)
        frame = spark.createDataFrame([(d, t, 1, b"k") for d, t in docs], "doc_id long, text string, line int, key binary").repartition(5)
        assert {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()} == brute(docs)


def test_repeated_rows_and_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c\nd e f", "en", "s", 11), (1, "a b c\nd e f", "en", "s", 11), (2, "x y z\na b c", None, None, 11), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    found = sorted((tuple(r) for r in lines.keep_lines(spark, docs, "").collect()), key=str)
    assert found == sorted([rows[0], rows[1], (2, "x y z", None, None, 5), rows[3]], key=str)
    assert lines.keep_lines(spark, docs.limit(0), "").count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f", 7, 8, 11), (2, "a b c", 9, 10, 5)], "doc_id long, text string, key long, removed long, n_chars long")
    found = sorted(tuple(r) for r in lines.keep_lines(spark, docs, "").collect())
    assert found == [(1, "a b c\nd e f", 7, 8, 11), (2, "", 9, 10, 0)]


def test_what_was_held_wrongly_is_made_up_for(spark, monkeypatch):
    """Sets that a sketch key held as settled, all of them here, still meet what they are similar to."""
    made = lines.family_pairs

    def every(firsts):
        head = firsts.select("id").limit(1).collect()[0].id
        return made(firsts).union(firsts.where(firsts.id != head).selectExpr(f"{head}L AS a", "id AS b", "0 AS bits", "true AS later")).distinct()

    monkeypatch.setattr(lines, "family_pairs", every)
    docs = make(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()} == brute(docs)


def test_long_lines_without_likeness_are_not_compared(spark, monkeypatch):
    """Narrow parity maps of long lines differ in few bits by chance; such pairs must not grow with the square of the lines."""
    made, seen = lines.verified, []

    def counted(pairs, firsts, docs):
        seen.append(pairs.count())
        return made(pairs, firsts, docs)

    monkeypatch.setattr(lines, "verified", counted)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1500, 150)) for _ in range(120)]
    texts += [texts[5] + " more", "short lines of few words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in lines.dedup_lines(frame).collect() if r.n_removed} == {120}
    assert sum(seen) == 1
