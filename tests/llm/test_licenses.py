"""License scans against regular expressions over words, and the template markup."""

import re

import pytest

from hindcast.llm import licenses
from hindcast.llm.textvec import WORD

WORD_RE = re.compile(WORD)


def ids_of(*texts):
    names = sorted({w for t in texts for w in WORD_RE.findall(t.lower())})
    return {w: i for i, w in enumerate(names)}


@pytest.mark.parametrize(
    ("markup", "text", "end"),
    [
        ("a b c", "a b c", 3),
        ("a b c", "a x c", -1),
        ("a [[b]] c", "a c", 2),
        ("a [[b]] c", "a b c", 3),
        ("a {{2}} c", "a x y c", 4),
        ("a {{2}} c", "a x y z c", -1),
        ("a {{2}} c", "a c c", 3),
        ("[[x [[y]] z]] a", "x z a", 3),
        ("[[x [[y]] z]] a", "a", 1),
        ("a [[b]]", "a q", 1),
    ],
)
def test_automaton(markup, text, end):
    ids = ids_of(markup, text)
    tokens = [ids[w] for w in text.split()]
    assert licenses.TokenAutomaton(markup, ids).run(tokens, 0, len(tokens)) == end


CASES = [
    None,
    "",
    "plain words only",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
    "the MIT   license; mit\nLICENSE mit licensed",
    "GNU General Public\nLicense GNU general public",
    "Permission is hereby granted, free of charge, to any person",
    "ÉMIT license émit license mit license",
    "x " * 30000 + "Licensed under the Apache License, Version 2.0." + " y" * 30000,
]


def brute(text):
    w = WORD_RE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(3, CASES[3], "x")], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    for i, text in enumerate(CASES):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert rows[3].labels == "cc-by,cc-by-notice"
    assert rows[4].labels == "gpl,gpl-notice,mit,mit-notice"
    assert rows[9].labels == "apache,apache-2.0"
    assert rows[7].labels == "" and rows[2].score == 0
    assert licenses.licenses(docs).count() == len(CASES) + 1
    assert licenses.licenses(docs.limit(0)).count() == 0


def plain(markup, filler="the Holder"):
    """A text that follows a template: optional regions written out, replaceable ones filled."""
    return re.sub(r"\{\{\d+\}\}", filler, markup.replace("[[", "").replace("]]", ""))


def labels_of(*texts):
    import pyarrow as pa

    from hindcast.llm.textvec import words

    found = licenses.scanner().scan(words(pa.array(texts)))
    return [{x[2] for x in found[d][1]} if d in found else set() for d in range(len(texts))]


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_every_template(k):
    label, markup = licenses.TEMPLATES[k]
    text = plain(markup)
    short = re.sub(r"\s+", " ", re.sub(r"\{\{\d+\}\}", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", markup)))).strip()
    whole, least = labels_of("Intro. " + text + " more", short)
    assert label in whole and label in least
    spoilt = short.split()
    spoilt[len(spoilt) // 2] = "spoilt"
    assert label not in labels_of(" ".join(spoilt))[0]


def test_neighbouring_licenses_are_told_apart():
    by = {label: plain(m) for label, m in licenses.TEMPLATES}
    two, three, gpl2, gpl3, lgpl = labels_of(by["bsd-2-clause"], by["bsd-3-clause"], by["gpl-2.0-or-later"], by["gpl-3.0-or-later"], by["lgpl-3.0-or-later"])
    assert two == {"bsd-text", "bsd-2-clause"} and three == {"bsd-text", "bsd-3-clause"}
    assert "gpl-3.0-or-later" not in gpl2 and "gpl-2.0-or-later" not in gpl3 and not any(x.startswith("gpl") for x in lgpl)
