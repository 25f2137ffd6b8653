"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, URL schemes and
identifier cues. Each anchor is handed to a small deterministic parser that expands the boundaries to
both sides and validates what it found (label rules, octet range, Luhn, IBAN check digits, street
pattern). Offsets are code points, ends exclusive.

Base kinds: email, ip, card, phone, each exactly the leftmost non-overlapping matches of its fixed
pattern. Own kinds after them: iban, login (a URL that carries user information), ssn, account (a
number after an account cue), address (house number, name and street word), secret (an assigned value
after a cue such as a token or password, long and mixed enough not to be a word).

Null and empty texts give no spans; the length of a text is not limited; repeated rows give repeated
results; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, sha256, table, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "login", "ssn", "account", "address", "secret")

# Anchors and cue words.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
ACCOUNT_CUES = ("account number", "account no", "acct no", "acct", "account id", "passport no", "passport number", "member id")
SSN_CUES = ("ssn", "social security number", "social security no")
IBAN_CUES = ("iban",)
SECRET_CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key", "bearer")
STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "square", "straße", "platz", "calle", "avenida")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_SECRET = _ALNUM | frozenset("_-+/=.~")
_PHONE = _DIGITS | frozenset(" ().-")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    cues = [("scheme", s) for s in SCHEMES] + [("account", s) for s in ACCOUNT_CUES] + [("ssn", s) for s in SSN_CUES]
    cues += [("iban", s) for s in IBAN_CUES] + [("street", s) for s in STREETS] + [("secret", s) for s in SECRET_CUES]
    for kind, cue in cues:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`, whose local part starts at `floor` or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, pos = len(text), 0, at + 1
    while True:
        label = pos
        while pos < n and text[pos] in _LABEL:
            pos += 1
        if pos == label:
            break
        end, labels = pos, (1 if label == at + 1 else 2)
        if pos < n and text[pos] == ".":
            pos += 1
        else:
            break
    return (start, end) if end and labels == 2 else None


def digit_runs(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Runs of digits joined by single dots, from the run that starts at `at`."""
    runs, n, pos = [], len(text), at
    while True:
        start = pos
        while pos < n and text[pos] in _DIGITS:
            pos += 1
        if pos == start:
            break
        runs.append((start, pos))
        if pos < n and text[pos] == ".":
            pos += 1
        else:
            break
    return runs, runs[-1][1]


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def parse_card(text: str, at: int) -> tuple[int, str]:
    """End and digits of the chain from `at` whose digits are at most one space or hyphen apart."""
    n, pos, digits = len(text), at + 1, [text[at]]
    while pos < n:
        if text[pos] in _DIGITS:
            digits.append(text[pos])
            pos += 1
        elif text[pos] in " -" and pos + 1 < n and text[pos + 1] in _DIGITS:
            digits.append(text[pos + 1])
            pos += 2
        else:
            break
    return pos, "".join(digits)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def parse_phone(text: str, at: int) -> tuple[int, int] | None:
    """End and number of digits of the number after the plus sign at `at`."""
    n, pos = len(text), at + 2
    if at + 1 >= n or text[at + 1] not in _DIGITS:
        return None
    while pos < n and text[pos] in _PHONE:
        pos += 1
    while pos > at + 3 and text[pos - 1] not in _DIGITS:
        pos -= 1
    if pos <= at + 3 or text[pos - 1] not in _DIGITS:
        return None
    return pos, sum(c in _DIGITS for c in text[at:pos])


def iban_ok(compact: str) -> bool:
    """Length and check digits (ISO 13616, modulo 97)."""
    if not 15 <= len(compact) <= 34 or not compact[:2].isalpha() or not compact[2:4].isdigit():
        return False
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def parse_iban(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN within a few separators after a cue that ends at `at`."""
    n, pos = len(text), at
    while pos < n and pos - at < 4 and text[pos] in " :.=#":
        pos += 1
    start, kept = pos, []
    best = None
    while pos < n and len(kept) <= 34:
        if text[pos] in _ALNUM:
            kept.append(text[pos].upper())
            pos += 1
            if (pos == n or text[pos] not in _ALNUM) and iban_ok("".join(kept)):
                best = (start, pos)
        elif text[pos] == " " and kept and pos + 1 < n and text[pos + 1] in _ALNUM:
            pos += 1
        else:
            break
    return best


def parse_login(text: str, at: int, begin: int) -> tuple[int, int] | None:
    """A URL with user information, whose scheme spans begin to at."""
    n, pos, sign = len(text), at, -1
    while pos < n and not text[pos].isspace() and text[pos] not in "/<>\"'":
        if text[pos] == "@":
            sign = pos
        pos += 1
    return (begin, pos) if at < sign < pos - 1 else None


def parse_number(text: str, at: int, least: int, most: int) -> tuple[int, int] | None:
    """A number of `least` to `most` digits, hyphens allowed inside, within a few separators after a cue."""
    n, pos = len(text), at
    while pos < n and pos - at < 4 and text[pos] in " :.=#":
        pos += 1
    start, count = pos, 0
    while pos < n and (text[pos] in _DIGITS or text[pos] == "-" and pos + 1 < n and text[pos + 1] in _DIGITS):
        count += text[pos] in _DIGITS
        pos += 1
    whole = pos == n or text[pos] not in _ALNUM
    return (start, pos) if least <= count <= most and whole and start > at else None


def parse_secret(text: str, at: int) -> tuple[int, int] | None:
    """The value that is assigned behind a cue which ends at `at`: a colon, an equals sign or (after bearer) a space, perhaps a quote, then the value.

    A value has 16 characters at least, 8 different ones, and digits as well as letters.
    """
    n, pos, assigned = len(text), at, text[max(at - 6, 0) : at].lower() == "bearer"
    while pos < n and pos - at < 6 and text[pos] in " \t:=\"'`":
        assigned |= text[pos] in ":="
        pos += 1
    start = pos
    while pos < n and text[pos] in _SECRET:
        pos += 1
    while pos > start and text[pos - 1] in ".-":
        pos -= 1
    value = text[start:pos]
    mixed = any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)
    return (start, pos) if assigned and start > at and len(value) >= 16 and len(set(value)) >= 8 and mixed else None


def parse_address(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """House number, one to three capitalised names and the street word that spans begin to end."""
    if end < len(text) and text[end].isalnum() or begin == 0 or text[begin - 1] != " ":
        return None
    pos, names = begin - 1, 0
    while names < 3:
        stop = pos
        while pos > 0 and text[pos - 1].isalpha():
            pos -= 1
        if pos == stop or not text[pos].isupper() or pos == 0 or text[pos - 1] != " ":
            return None
        names, pos = names + 1, pos - 1
        stop = pos
        while pos > 0 and text[pos - 1] in _DIGITS:
            pos -= 1
        if pos < stop:
            return (pos, end) if stop - pos <= 5 and (pos == 0 or text[pos - 1] in " \n,;:(") else None
    return None


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = run_end = phone_end = 0
    for last, (kind, size) in anchors.iter(text):
        begin = last + 1 - size
        if kind == "digit":
            if begin >= run_end:
                runs, run_end = digit_runs(text, begin)
                if len(runs) >= 4:
                    for i in range(0, len(runs) - 3, 4):
                        four = runs[i : i + 4]
                        if all(octet(text[a:b]) for a, b in four):
                            spans["ip"].append((four[0][0], four[3][1]))
            if begin >= card_end:
                card_end, digits = parse_card(text, begin)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append((begin, card_end))
        elif kind == "at":
            if found := parse_email(text, begin, email_end):
                spans["email"].append(found)
                email_end = found[1]
        elif kind == "plus":
            if begin >= phone_end and (found := parse_phone(text, begin)):
                phone_end = found[0]
                if 8 <= found[1] <= 15:
                    spans["phone"].append((begin, found[0]))
        elif kind == "street":
            if found := parse_address(text, begin, last + 1):
                spans["address"].append(found)
        elif begin and text[begin - 1].isalnum():
            continue
        elif kind == "scheme":
            if found := parse_login(text, last + 1, begin):
                spans["login"].append(found)
        elif kind == "iban":
            if found := parse_iban(text, last + 1):
                spans["iban"].append(found)
        elif kind == "ssn":
            if found := parse_number(text, last + 1, 9, 9):
                spans["ssn"].append(found)
        elif kind == "secret":
            if found := parse_secret(text, last + 1):
                spans["secret"].append(found)
        elif kind == "account":
            if found := parse_number(text, last + 1, 6, 18):
                spans["account"].append(found)
    for kind in KINDS[len(BASE_KINDS) :]:
        spans[kind] = sorted(set(spans[kind]))
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_more long, n_spans long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*BASE_KINDS, "more", "spans")), ("base_sha256", pa.string()), ("spans", pa.string())])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts and spans of personal data."""

    def scan(part: pa.RecordBatch) -> dict:
        anchors = automaton()
        out: dict[str, list] = {f.name: [] for f in _ARROW}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            spans = find(text or "", anchors)
            out["doc_id"].append(doc_id)
            for k in BASE_KINDS:
                out[f"n_{k}"].append(len(spans[k]))
            out["n_more"].append(sum(len(spans[k]) for k in KINDS[len(BASE_KINDS) :]))
            out["n_spans"].append(sum(map(len, spans.values())))
            out["base_sha256"].append(sha256(joined(spans, BASE_KINDS).encode()))
            out["spans"].append(joined(spans, KINDS))
        return out

    return map_slices(texts(docs), scan, _SCHEMA, _ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
