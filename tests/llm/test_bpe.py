"""BPE encoding against the library, with and without the word cache, on texts that are hard to cut."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.tokenizer_path()
PLAIN = tokenizers.Tokenizer.from_file(PATH)

WORDS = ["the", "Straße", "naïve", "don't", "éa", "<|endoftext|>", "12345", "中文", "a,b;c", "\U0001f600", "'s", "İstanbul"]
RNG = np.random.default_rng(5)


def texts():
    yield from ["", " ", "\n\n", "word", "<|startoftext|>x", "no" * 3000, "́" * 50, "x " * 4000, "中" * 2000]
    for n in (5, 200, 3000):
        yield "".join(RNG.choice(WORDS) + RNG.choice([" ", "  ", "\n", "\t", " ", "\r\n", ""]) for _ in range(n))
    shared = "".join(RNG.choice(WORDS) + " " for _ in range(1500))
    yield from [shared + "tail", "head " + shared, "a" + shared[7:] + shared]


@pytest.mark.parametrize("by_words", [True, False])
def test_ids_and_decoding_equal_the_library(by_words):
    encoder = bpe.Encoder(PATH)
    assert encoder.splits_at_space
    encoder.splits_at_space = by_words
    column = list(texts())
    got = encoder.encode_slice(pa.array(column, pa.string()))
    for text, ids in zip(column, got, strict=True):
        want = PLAIN.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert encoder.decode(ids) == PLAIN.decode(want, skip_special_tokens=False)
    assert encoder.reused


def test_cuts_follow_content():
    body = " ".join(f"w{i * 7919 % 1000}" for i in range(4000))
    a, b = ("x" * 31 + " " + body).encode(), ("another beginning " + body).encode()
    found = []
    for raw in (a, b):
        data = np.frombuffer(raw, np.uint8)
        at = bpe.cuts(data, np.array([0, len(raw)]))
        found.append({raw[i : i + 40] for i in at[1:].tolist()})
    assert len(found[0] & found[1]) > 0.9 * len(found[0]) > 5


def test_flanks_that_disagree_are_widened():
    encoder = bpe.Encoder(PATH)
    text = " ".join(f"word{i}" for i in range(2000))
    column = pa.array([text])
    first = encoder.encode_slice(column)[0]
    for key in list(encoder.flanks):
        encoder.flanks[key] = np.array([1], dtype="<u4")
    again = encoder.encode_slice(column)[0]
    assert encoder.widened and again.tolist() == first.tolist()


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "Hello world", 3), (3, "Hello world", 4)], "doc_id long, text string, ids int")
    rows = sorted(tuple(r) for r in bpe.digests(docs, PATH).collect())
    ids = PLAIN.encode("Hello world", add_special_tokens=False).ids
    empty = hashlib.sha256(b"").hexdigest()
    full = (3, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(PLAIN.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert rows == [(1, 0, empty, empty), (2, 0, empty, empty), full, full]
    assert [r.ids for r in bpe.encode(docs.where("doc_id = 3"), PATH).collect()] == [ids, ids]
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_core_that_disagrees_with_its_join_is_encoded_whole():
    encoder = bpe.Encoder(PATH)
    text = " ".join(f"word{i}" for i in range(4000))
    encoder.encode_slice(pa.array([text]))
    for key, ids in encoder.cores.items():
        encoder.cores[key] = np.append(ids[:-1], np.uint32(7))
    assert encoder.encode_slice(pa.array([text]))[0].tolist() == PLAIN.encode(text, add_special_tokens=False).ids
