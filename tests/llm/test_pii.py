"""Personal data: the anchor parsers against the fixed patterns, and the extra kinds."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindcast.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m[0])] for k, p in PATTERNS.items()}


ANCHORS = pii.automaton()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "1", "25", "255", "256", "4242424242424242", "@", ".", "-", "+", " ", "(", ")", "%", "_", "é", "x@y.z", "+1 (555) 555-2485", "1.2.3.4", "\n"]), max_size=24).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = pii.find(text, ANCHORS)
    assert {k: found[k] for k in PATTERNS} == brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("IBAN: GB82 WEST 1234 5698 7654 32 please", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("see https://me:secret@host.example/x now", "login", "https://me:secret@host.example"),
        ("Her SSN 078-05-1120.", "ssn", "078-05-1120"),
        ("account number: 12345678 is", "account", "12345678"),
        ('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" ends', "secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"),
        ("API_KEY: Zk9-aaBB_1234567890xyz.", "secret", "Zk9-aaBB_1234567890xyz"),
        ("Authorization: Bearer abc.DEF-123456789012 x", "secret", "abc.DEF-123456789012"),
        ("lives at 12 Old Mill Lane, upstairs", "address", "12 Old Mill Lane"),
    ],
)
def test_own_kinds(text, kind, span):
    assert [text[a:b] for a, b in pii.find(text, ANCHORS)[kind]] == [span]


@pytest.mark.parametrize("text", ["", "IBAN GB82WEST12345698765433", "lossnk 123456789", "the lane", "https://host/x", "a token of gratitude", "token = aaaaaaaaaaaaaaaaaaaa1", "password: correct", "tokenf3ef4d6b2755a36d7d9c25bd72c4"])
def test_clean(text):
    assert not any(pii.find(text, ANCHORS).values())


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a@b.c" * 3, "x"), (3, "a@b.c" * 3, "x"), (None, "+1 555 555 2485", None)], "doc_id long, text string, spans string")
    rows = sorted(map(tuple, pii.personal_data(docs).select("doc_id", "n_email", "n_phone", "spans").collect()), key=str)
    emails = brute("a@b.c" * 3)["email"]
    three = (3, len(emails), 0, ",".join(f"email:{a}:{b}" for a, b in emails))
    assert rows == sorted([(1, 0, 0, ""), (2, 0, 0, ""), three, three, (None, 0, 1, "phone:0:15")], key=str)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    """A text of several megabytes is read whole."""
    text = "word " * 600_000 + "me@host.example 10.0.0.1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.personal_data(docs).first()
    assert (row.n_email, row.n_ip, row.n_spans) == (1, 1, 2) and row.spans.endswith(f"ip:{len(text) - 8}:{len(text)}")
