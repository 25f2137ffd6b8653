"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Seeds are the rare word trigrams of the test items. A first pass counts every trigram of the items over all
texts. An item keeps its rarest ones, one more than changed words could spoil in a passage that still has the
score, and of the others those that are no more than COMMON times as frequent: so what is left out are phrases
of everyday language, not a part of the item that was copied often. A second pass finds the
seeds in every text; hits near one diagonal of an item give a window. A window that has too few of the
item's words for the score, in whatever order, is skipped, which loses nothing: an alignment matches no more
words than both sides have in common. Other windows are aligned with the item: match +1, mismatch and gap
-1. The score is the alignment's share of the item's length; a text with a score of LEAST or more holds the
item, verbatim, edited or in part paraphrased. A passage in which no three words of the item follow each
other has no seed and isn't found.

Test items are a stated query set. They are read in blocks of at most BLOCK_ITEMS and BLOCK_BYTES, so what is
sent to the workers and counted on the driver is bounded; the corpus is only ever read in place, without a
shuffle of texts, and results don't depend on the blocks. Null and
empty texts and items give no hits; repeated items are reported each; items of fewer than three words
match where their words stand consecutively. Texts are read whole. Columns besides doc_id and text
(item_id and text) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import local_scores
from .common import map_slices, slices, table, texts
from .textvec import Words, ngrams, words

SEED = 3
LEAST = 0.5
COMMON = 16
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20


@dataclass
class Items:
    """A block of test items: their words, and their seeds by hash as (item, position) runs."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def prepare(rows: list[tuple[int | None, str | None]]) -> Items:
    w = words(pa.array([t for _, t in rows], pa.string()))
    tokens = [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    seeds, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, own in enumerate(tokens):
        h, at = ngrams(own, np.array([0, len(own)]), SEED)
        seeds.append(h)
        owner.append(np.full(len(h), i))
        place.append(at)
    all_seeds = np.concatenate(seeds)
    order = np.argsort(all_seeds, kind="stable")
    return Items([i for i, _ in rows], tokens, all_seeds[order], np.concatenate(owner)[order], np.concatenate(place)[order])


def seed_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each distinct seed of a block stands in all texts; partial sums leave the tasks."""
    distinct = np.unique(items.seeds)
    shared = docs.sparkSession.sparkContext.broadcast(distinct)

    def count(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(hits(words(part.column("text")), shared.value)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

    counts = np.zeros(len(distinct), dtype=np.int64)
    if len(distinct):
        found = texts(docs).select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("seed").to_numpy()] = found.column("n").to_numpy()
    return counts


def rarest(items: Items, counts: np.ndarray) -> Items:
    """The block with the rarest seeds of each item, one more than so many changed words could spoil as leave the score in reach, and others that aren't common."""
    n = counts[np.searchsorted(np.unique(items.seeds), items.seeds)] if len(items.seeds) else counts
    order = np.lexsort((items.place, items.seeds, n, items.owner))
    owner = items.owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    length = np.array([len(t) for t in items.tokens], dtype=np.int64)
    # a changed word is one match less and one mismatch more, and spoils SEED trigrams at most
    spoilt = SEED * np.floor((1 - LEAST) / 2 * length + 1e-9).astype(np.int64)
    if not len(owner):
        return items
    # the middle count of the seeds that an item keeps anyway
    first, have = np.searchsorted(owner, owner), np.bincount(owner, minlength=len(length))
    middle = n[order][first + (np.minimum(have[owner], spoilt[owner] + 1) - 1) // 2]
    kept = np.sort(order[(rank <= spoilt[owner]) | (n[order] <= COMMON * (1 + middle))])
    return Items(items.ids, items.tokens, items.seeds[kept], items.owner[kept], items.place[kept])


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Test items in bounded blocks."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(text or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text or "")
    if block:
        yield block


def hits(w: Words, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a seed starts, and its index among the sorted distinct seeds."""
    h, at = ngrams(w.hash, w.first, SEED)
    if not len(seeds) or not len(h):
        return at[:0], at[:0]
    i = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
    hit = seeds[i] == h
    return at[hit], i[hit]


def common_words(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> int:
    """Words that an item, given by its distinct words and their counts, and a window have in common as multisets."""
    distinct, counts = item
    i = np.minimum(np.searchsorted(distinct, window), len(distinct) - 1)
    found = np.bincount(i[distinct[i] == window], minlength=len(distinct))
    return int(np.minimum(found, counts).sum())


def windows(w: Words, items: Items) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Candidate windows: text, item, first and end word, and number of seeds."""
    distinct, begin = np.unique(items.seeds, return_index=True)
    run = np.diff(np.append(begin, len(items.seeds)))
    at, i = hits(w, distinct)
    out: tuple[list[int], list[int], list[int], list[int], list[int]] = ([], [], [], [], [])
    times = run[i]
    at = np.repeat(at, times)
    entry = np.repeat(begin[i], times) + (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times))
    doc = np.searchsorted(w.first, at, side="right") - 1
    item, place = items.owner[entry], items.place[entry]
    short = [k for k, t in enumerate(items.tokens) if 0 < len(t) < SEED]
    for k in short:
        t = items.tokens[k]
        for pos in np.flatnonzero(w.hash == t[0]).tolist():
            d = int(np.searchsorted(w.first, pos, side="right") - 1)
            if pos + len(t) <= w.first[d + 1] and np.array_equal(w.hash[pos : pos + len(t)], t):
                for column, value in zip(out, (d, k, pos, pos + len(t), 1), strict=True):
                    column.append(value)
    if not len(at):
        return out
    length = np.array([len(t) for t in items.tokens])
    start = at - place
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    # hits whose diagonals lie within the item's length of each other share a window
    split = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[item[1:]] // 2)])
    heads = np.flatnonzero(split)
    ends = np.append(heads[1:], len(doc))
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        d, k = int(doc[a]), int(item[a])
        margin = int(length[k]) // 2 + 1
        lo = max(int(start[a]) - margin, int(w.first[d]))
        hi = min(int(start[b - 1]) + int(length[k]) + margin, int(w.first[d + 1]))
        if k not in bags:
            bags[k] = np.unique(items.tokens[k], return_counts=True)
        if common_words(bags[k], w.hash[lo:hi]) < LEAST * length[k]:
            continue
        for column, value in zip(out, (d, k, lo, hi, b - a), strict=True):
            column.append(value)
    return out


def align(w: Words, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """Leaks of a slice: text, item, score, number of seeds, first and end word in the text."""
    doc, item, lo, hi, n = windows(w, items)
    queries = [items.tokens[k] for k in item]
    found = local_scores(queries, [w.hash[a:b] for a, b in zip(lo, hi, strict=True)])
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    keep = [i for i, (score, _) in enumerate(found) if score >= LEAST * len(queries[i])]
    # the alignment's start: the same alignment from its end backwards
    back = local_scores([queries[i][::-1] for i in keep], [w.hash[lo[i] : lo[i] + found[i][1]][::-1] for i in keep])
    for i, (_, size) in zip(keep, back, strict=True):
        score, end = found[i]
        at = (score / len(queries[i]), n[i], lo[i] + end - size, lo[i] + end)
        if best.get((doc[i], item[i]), (0.0, 0, 0, 0))[0] < at[0]:
            best[doc[i], item[i]] = at
    return [(d, k, *at) for (d, k), at in sorted(best.items())]


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
_SCHEMA = "doc_id long, item_id long, score double, n_seeds long, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that it holds."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark):
        items = prepare(block)
        shared = spark.sparkContext.broadcast(rarest(items, seed_counts(docs, items)))

        def scan(part: pa.RecordBatch, shared=shared) -> dict | None:
            w = words(part.column("text"))
            found = align(w, shared.value)
            if not found:
                return None
            ids = part.column("doc_id").to_pylist()
            return {
                "doc_id": [ids[d] for d, *_ in found],
                "item_id": [shared.value.ids[k] for _, k, *_ in found],
                "score": [x[2] for x in found],
                "n_seeds": [x[3] for x in found],
                "first_word": [x[4] - int(w.first[x[0]]) for x in found],
                "end_word": [x[5] - int(w.first[x[0]]) for x in found],
            }

        part = map_slices(texts(docs), scan, _SCHEMA, _ARROW)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go; all others stay as they are."""
    names, schema, every = docs.columns, docs.schema, docs
    for block in blocks(table(spark, sf_dir, "benchmark")):
        items = prepare(block)
        shared = spark.sparkContext.broadcast(rarest(items, seed_counts(every, items)))

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[d for d, *_ in align(words(part.column(names.index("text"))), shared.value)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
