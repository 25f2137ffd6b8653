"""BPE encoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes hits a mask, so equal passages of different
documents give equal chunks whatever stands around them. A chunk's core runs from its first to its
last white space; each core is encoded once for a worker and its ids are reused wherever it recurs
(a bounded cache). A core is encoded by the library, or, where the tokenizer splits at white space, as a
probe at the start shows, from its words, each of which the library has encoded once. What a cut tore
apart, the words at a join of two chunks, is repaired: the library encodes the join anew, as it stands in
the text, together with a flank of whole words of both cores, and it stands when the ids of both flanks
agree exactly with those that the cores have there; else the flanks are doubled, and at last the whole
text is encoded by the library. Every join is thus a test of what the cores on both sides were given.

Decoding joins the vocabulary's pieces as the library does for a tokenizer without a decoder. Null
and empty texts give no ids; texts are read whole; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, sha256, slices, table, texts
from .textvec import mix, prefix_hash, utf8

TOKENIZER = "word_bpe_49k.json"
WINDOW = 24
MASK_BITS = 10
CACHED = 16_384
WORDS_CACHED = 300_000
MARK, RUN = b"\x01", 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks: starts of texts, and characters after a window whose hash ends in zeros."""
    n = len(raw)
    found = offsets[:-1][offsets[:-1] < offsets[1:]]
    if n > WINDOW:
        total, inverse = prefix_hash(raw)
        h = mix((total[WINDOW:] - total[:-WINDOW]) * inverse[:-WINDOW][: n + 1 - WINDOW])
        at = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
        at = at[at < n]
        text = np.searchsorted(offsets, at, side="right") - 1
        at = at[(at - offsets[text] >= WINDOW) & ((raw[at] & 0xC0) != 0x80)]
        found = np.union1d(found, at)
    return found


class Encoder:
    """A tokenizer with the chunk cache of one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.cores: dict[bytes, np.ndarray] = {}
        self.flanks: dict[bytes, np.ndarray] = {}
        self.joins: dict[bytes, np.ndarray] = {}
        self.words: dict[bytes, bytes] = {}
        self.encoded = self.reused = self.widened = 0
        probe = "Ab c'd  é,f\n12 gh\t<|x|> i"
        parts = [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.splits_at_space = self.tokenizer.encode(probe, add_special_tokens=False).ids == parts and self.mark is not None

    def encode_all(self, parts: list[bytes]) -> list[np.ndarray]:
        return self.encode_words(parts) if self.splits_at_space else self.encode_whole(parts)

    def encode_whole(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of parts by the library, as they stand."""
        got = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in got]

    def encode_words(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of parts from those of their words; the library encodes each new word once."""
        split = [p.split() for p in parts]
        if len(self.words) > WORDS_CACHED:
            self.words.clear()
        self.learn(list({w for s in split for w in s if w not in self.words}))
        of = self.words.__getitem__
        return [np.frombuffer(b"".join(map(of, s)), dtype="<u4") for s in split]

    def learn(self, new: list[bytes]) -> None:
        """Encode new words, many in one call: a mark between them, an id of its own, parts their ids."""
        marked = [w for w in new if MARK in w]
        plain = [w for w in new if MARK not in w]
        for w in marked:
            self.words[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        between = b" " + MARK + b" "
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([between.join(r).decode() for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark)
            data, starts = ids.tobytes(), (4 * np.concatenate([[0], ends + 1])).tolist()
            stops = (4 * np.append(ends, len(ids))).tolist()
            self.words.update((w, data[a:b]) for w, a, b in zip(run, starts, stops, strict=True))

    def cached(self, cache: dict[bytes, np.ndarray], parts: list[bytes]) -> None:
        """Encode the parts that the cache lacks, each once."""
        new = [p for p in dict.fromkeys(parts) if p not in cache]
        self.encoded += len(new)
        self.reused += len(parts) - len(new)
        cache.update(zip(new, self.encode_all(new), strict=True))

    def encode_slice(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        for cache in (self.cores, self.flanks, self.joins):
            if len(cache) > CACHED:
                cache.clear()
        raw, offsets = utf8(column)
        start = cuts(raw, offsets)
        end = np.append(start[1:], len(raw))
        white = np.flatnonzero(_SPACE[raw])
        lo, hi = np.searchsorted(white, start), np.searchsorted(white, end)
        data = raw.tobytes()
        # A core needs two white spaces at least with a word between; chunks without one are part of a join.
        has = hi - lo >= 2
        first = np.where(has, white[np.minimum(lo, max(len(white) - 1, 0))] if len(white) else 0, -1)
        last = np.where(has, white[np.maximum(hi - 1, 0)] if len(white) else 0, -1)
        owner = np.searchsorted(offsets, start, side="right") - 1
        texts_cores: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for d, a, b in zip(owner[has].tolist(), first[has].tolist(), last[has].tolist(), strict=True):
            texts_cores[d].append((a, b + 1))
        bounds = offsets.tolist()
        wanted = [data[a:b] for own in texts_cores for a, b in own]
        self.cached(self.cores, wanted)
        # joins: (left core or None, right core or None, from, to), encoded with one flank word of each core
        joins, flanks = [], []
        for d, own in enumerate(texts_cores):
            edges = [bounds[d], *(x for c in own for x in c), bounds[d + 1]]
            for j in range(len(own) + 1):
                a, b = edges[2 * j], edges[2 * j + 1]
                left, right = (own[j - 1] if j else None), (own[j] if j < len(own) else None)
                if a == b:
                    joins.append(None)
                    continue
                lf = flank_left(data, left, 1) if left else b""
                rf = flank_right(data, right, 1) if right else b""
                joins.append((lf, data[a:b], rf, left, right))
                flanks += [f for f in (lf, rf) if f]
        self.cached(self.flanks, flanks)
        todo = [j for j in joins if j]
        whole = [lf + mid + rf for lf, mid, rf, _, _ in todo]
        new = [w for w in dict.fromkeys(whole) if w not in self.joins]
        self.joins.update(zip(new, self.encode_whole(new), strict=True))
        none, at, out = np.zeros(0, "<u4"), 0, []
        repaired = map(self.joins.__getitem__, whole)
        for d, own in enumerate(texts_cores):
            ids: list[np.ndarray] = []
            for j in range(len(own) + 1):
                join = joins[at]
                at += 1
                if join:
                    ids.append(self.repair(data, join, next(repaired)))
                if j < len(own):
                    ids.append(self.cores[data[own[j][0] : own[j][1]]])
            if any(x is None for x in ids):  # no flank agreed: the text is encoded whole
                ids = self.encode_whole([data[bounds[d] : bounds[d + 1]]])
            out.append(np.concatenate(ids) if ids else none)
        return out

    def repair(self, data: bytes, join: tuple, got: np.ndarray) -> np.ndarray | None:
        """Ids of a join without its flanks, once the flanks agree with the cores; None if they never do."""
        lf, mid, rf, left, right = join
        words = 1
        while True:
            a = self.flanks[lf] if lf in self.flanks else self.encode_all([lf])[0] if lf else got[:0]
            b = self.flanks[rf] if rf in self.flanks else self.encode_all([rf])[0] if rf else got[:0]
            n = len(got) - len(b)
            if n >= len(a) and np.array_equal(got[: len(a)], a) and np.array_equal(got[n:], b) and self.stands(data, left, a, True) and self.stands(data, right, b, False):
                return got[len(a) : n]
            self.widened += 1
            words *= 2
            wider = flank_left(data, left, words) if left else b"", flank_right(data, right, words) if right else b""
            if wider == (lf, rf):
                return None
            lf, rf = wider
            got = self.encode_whole([lf + mid + rf])[0]

    def stands(self, data: bytes, core: tuple[int, int] | None, flank: np.ndarray, tail: bool) -> bool:
        """Whether the core's own ids end (or begin) with the flank's."""
        if core is None or not len(flank):
            return True
        own = self.cores[data[core[0] : core[1]]]
        return np.array_equal(own[len(own) - len(flank) :] if tail else own[: len(flank)], flank)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@functools.cache
def worker_encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which serves all of its tasks."""
    return Encoder(path)


def flank_left(data: bytes, core: tuple[int, int], words: int) -> bytes:
    """The last words of a core with the white space around them."""
    return _tail(data[core[0] : core[1]], words)


def flank_right(data: bytes, core: tuple[int, int], words: int) -> bytes:
    """The first words of a core with the white space around them."""
    piece, at = data[core[0] : core[1]], 0
    for _ in range(words):
        while at < len(piece) and _SPACE[piece[at]]:
            at += 1
        while at < len(piece) and not _SPACE[piece[at]]:
            at += 1
    return piece[: at + 1]


def _tail(piece: bytes, words: int) -> bytes:
    at = len(piece)
    for _ in range(words):
        while at > 0 and _SPACE[piece[at - 1]]:
            at -= 1
        while at > 0 and not _SPACE[piece[at - 1]]:
            at -= 1
    return piece[max(at - 1, 0) :]


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each text."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "ids": worker_encoder(path).encode_slice(part.column("text"))}

    return map_slices(texts(docs), run, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of ids and of the decoded text."""

    def run(part: pa.RecordBatch) -> dict:
        encoder = worker_encoder(path)
        ids = encoder.encode_slice(part.column("text"))
        return {
            "doc_id": part.column("doc_id").to_pylist(),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [sha256(x.tobytes()) for x in ids],
            "decoded_sha256": [sha256(encoder.decode(x).encode()) for x in ids],
        }

    return map_slices(texts(docs), run, _SCHEMA, _ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its number of tokens and the digests of ids and decoded text."""
    path = tokenizer_path()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches):
        encoder = worker_encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode_slice(part.column(1))
                more = [[len(x) for x in ids], [sha256(x.tobytes()) for x in ids], [sha256(encoder.decode(x).encode()) for x in ids]]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, t) for v, (_, t) in zip(more, fields, strict=True))], names=[*part.schema.names, *(n for n, _ in fields)])

    schema = plain.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return plain.mapInArrow(run, schema)
