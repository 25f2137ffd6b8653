"""Removal of long repeated byte strings across a corpus.

Every byte goes that is covered by a string of LENGTH bytes which also starts anywhere else. Start
positions are told apart by refinement of classes, coarse to fine, as a merge of sorted shards refines
its interleaving: a class is a set of starts whose strings agree so far, shards count the members of
their classes, the counts are merged, classes of one are settled (no repeat), and only the rest is
refined. No suffix is sorted again and no shard sees another's text.

1. Anchor: of the LENGTH-byte string at each start, the k-gram of least hash (rightmost of equal
   ones). Equal strings have equal anchors at equal places, so starts fall into runs by anchor, about
   one for each 140 bytes. Runs of an anchor that occurs once are settled.
2. Run: where the whole stretch of a run (all its strings together) recurs, all its starts repeat.
3. Cell: the rest of a run is cut by a grid of CELL starts that is aligned at the anchor. The bytes
   that all strings of a cell have in common must recur, else the cell is settled; where the whole
   stretch of a cell recurs, all its starts repeat.
4. Start: strings of the remaining cells are compared by their own hashes.

Each level is a count by key with partial sums and a join back, so a key with a third of all rows is
summed in place and split by adaptive execution; no group is gathered. Keys are two independent
64-bit hashes (the anchor's, and that of the content with its place). Texts are named by their MD5.

The same refinement over words instead of bytes (anchor, run, start) finds passages of PASSAGE words or more
that recur, whatever stands between their words. They are reported beside the bytes and change nothing there.

Null and empty texts and texts shorter than LENGTH keep all bytes; equal texts lose all of theirs;
overlaps count, in one text too; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, map_slices, pick, sha256, stored, table, texts
from .textvec import hash_between, mix, prefix_hash, prefix_sums, utf8, words

LENGTH = 400
GRAM = 128
CELL = 32
PASSAGE = 51
WORD_GRAM = 12


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of values, in linear time: running minima of blocks from both ends."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor, in bytes."""
    return anchored_runs(prefix_hash(raw), offsets, length, gram)


def anchored_runs(sums: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor: text, anchor's place, first and last start (in the text), hashes of anchor and stretch."""
    total, inverse = sums
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "at", "low", "high", "anchor", "outer")}
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return empty
    q = np.arange(len(total) - gram)
    h = hash_between(total, inverse, q, q + gram)
    place = np.uint64(0xFFFFFFFF)
    keyed = (h & ~place) | (place - q.astype(np.uint64))
    at = (place - (sliding_least(keyed, length - gram + 1) & place)).astype(np.int64)
    long = np.flatnonzero(sizes >= length)
    count = sizes[long] - length + 1
    doc = np.repeat(long, count)
    starts = np.repeat(offsets[long] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    anchors = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    doc, low, high, a = doc[first], starts[first], starts[last], anchors[first]
    base = offsets[doc]
    return {
        "doc": doc, "at": a - base, "low": low - base, "high": high - base, "anchor": h[a].view(np.int64),
        "outer": hash_between(total, inverse, low, high + length).view(np.int64),
    }


_RUNS = pa.schema([("node", pa.binary()), ("anchor", pa.int64()), ("outer", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
_RUNS_SQL = "node binary, anchor long, outer long, at int, low int, high int"


_STARTS = pa.schema([("node", pa.binary()), ("start", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64())])
_STARTS_SQL = "node binary, start int, anchor long, key long"


def run_column(part: pa.RecordBatch) -> dict:
    found = runs_of(*utf8(part.column("text")))
    out = {k: found[k] for k in ("anchor", "outer", "at", "low", "high")}
    return out | {"node": part.column("node").take(pa.array(found["doc"]))}


def context_column(part: pa.RecordBatch) -> dict:
    """Stretches of bytes around the runs that are still open."""
    out: dict[str, list] = {k: [] for k in ("node", "anchor", "at", "low", "high", "context")}
    for node, text, runs in zip(*(part.column(c).to_pylist() for c in ("node", "text", "runs")), strict=True):
        data = text.encode()
        for r in runs:
            for k in ("anchor", "at", "low", "high"):
                out[k].append(r[k])
            out["node"].append(node)
            out["context"].append(data[r["low"] : r["high"] + LENGTH])
    return out


def cell_grid(at: int, low: int, high: int) -> range:
    """Cells of a run: cell j holds the starts at - CELL * j - CELL + 1 .. at - CELL * j."""
    return range((at - high) // CELL, (at - low) // CELL + 1)


def cell_column(part: pa.RecordBatch) -> dict:
    """Hashes of what the starts of each cell share, and of the whole cell if the run holds all of it."""
    raw, offsets = utf8(part.column("context"))
    total, inverse = prefix_hash(raw)
    at, low, high = (np.asarray(part.column(c), dtype=np.int64) for c in ("at", "low", "high"))
    j0, j1 = (at - high) // CELL, (at - low) // CELL
    row = np.repeat(np.arange(len(at)), j1 - j0 + 1)
    j = np.arange(len(row)) - np.repeat(np.cumsum(j1 - j0 + 1) - (j1 - j0 + 1), j1 - j0 + 1) + j0[row]
    x = at[row] - CELL * (j + 1) + 1
    base = offsets[:-1][row] - low[row]
    anchor = np.asarray(part.column("anchor"), dtype=np.int64).view(np.uint64)[row]
    tag = mix(anchor + j.astype(np.uint64))
    inner = mix(hash_between(total, inverse, base + x + CELL - 1, base + x + LENGTH) ^ tag)
    whole = (x >= low[row]) & (x + CELL - 1 <= high[row])
    outer = np.zeros(len(row), dtype=np.uint64)
    outer[whole] = mix(hash_between(total, inverse, (base + x)[whole], (base + x)[whole] + CELL - 1 + LENGTH) + tag[whole])
    return {
        "node": part.column("node").take(pa.array(row)), "anchor": anchor.view(np.int64), "at": at[row], "cell": j, "inner": inner.view(np.int64),
        "outer": pa.array(outer.view(np.int64), pa.int64(), mask=~whole),
    }


def start_column(part: pa.RecordBatch) -> dict:
    """Hashes of the strings at all starts of the cells that are still open."""
    raw, offsets = utf8(part.column("context"))
    total, inverse = prefix_hash(raw)
    node, anchors = part.column("node"), np.asarray(part.column("anchor"), dtype=np.int64).view(np.uint64)
    rows, starts, keys = [], [], []
    # the anchor is a key of its own beside the content at its place
    for i, (at, low, high, cells) in enumerate(zip(*(part.column(c).to_pylist() for c in ("at", "low", "high", "cells")), strict=True)):
        for j in cells:
            p = np.arange(max(at - CELL * (j + 1) + 1, low), min(at - CELL * j, high) + 1)
            b = p + (offsets[i] - low)
            keys.append(mix(hash_between(total, inverse, b, b + LENGTH) ^ mix(anchors[i] + (at - p).astype(np.uint64) * np.uint64(3))))
            rows.append(np.full(len(p), i))
            starts.append(p)
    if not rows:
        return None
    row = np.concatenate(rows)
    return {"node": node.take(pa.array(row)), "start": np.concatenate(starts), "anchor": anchors[row].view(np.int64), "key": np.concatenate(keys).view(np.int64)}


def union_of(intervals: np.ndarray) -> np.ndarray:
    """Disjoint maximal runs of [start, end) intervals."""
    order = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(order[:, 1])
    first = np.flatnonzero(np.concatenate([[True], order[1:, 0] > reach[:-1]]))
    return np.stack([order[first, 0], reach[np.append(first[1:], len(order)) - 1]], axis=1)


_RESULT = pa.schema([("node", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def result_column(part: pa.RecordBatch) -> dict:
    out: dict[str, list] = {f.name: [] for f in _RESULT}
    for node, doc_id, text, low, high in zip(*(part.column(c).to_pylist() for c in ("node", "doc_id", "text", "low", "high")), strict=True):
        data = (text or "").encode()
        spans = union_of(np.stack([low, high], axis=1)).tolist() if low else []
        edges = [0, *(x for s in spans for x in s), len(data)]
        kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        for k, v in zip(_RESULT.names, (node, doc_id, len(data), len(data) - len(kept), len(spans), sha256(kept)), strict=True):
            out[k].append(v)
    return out


def named(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def repeated(rows: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """Keys that more than one row has."""
    return stored(rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))


def shared_runs(runs: DataFrame) -> tuple[DataFrame, str]:
    """Runs whose anchor occurs more than once; copies of a text have one name and one row for each run."""
    every, p_every = stored(runs)
    anchors, p_anchors = repeated(every, "anchor")
    out = stored(every.join(anchors, "anchor").groupBy("node", "anchor", "outer", "at", "low", "high").agg(F.count(F.lit(1)).alias("n")))
    drop(runs.sparkSession, p_every, p_anchors)
    return out


def told_runs(runs: DataFrame) -> tuple[DataFrame, str]:
    """Runs, each marked whether its whole stretch recurs."""
    shape = ["anchor", "outer", (F.col("at") - F.col("low")).alias("before"), (F.col("high") - F.col("low")).alias("width")]
    same = runs.select(*shape, "n").groupBy("anchor", "outer", "before", "width").agg(F.sum("n").alias("all"))
    same, p_same = stored(same.where("all > 1").drop("all"))
    marked = runs.select(*shape, "node", "at", "low", "high").join(same.withColumn("whole", F.lit(True)), ["anchor", "outer", "before", "width"], "left")
    marked, p_marked = stored(marked.select("node", "anchor", "outer", "before", "width", "at", "low", "high", F.coalesce("whole", F.lit(False)).alias("whole")))
    drop(runs.sparkSession, p_same)
    return marked, p_marked


def open_runs(marked: DataFrame) -> tuple[DataFrame, str]:
    """(node, runs, n): open runs (their texts have no copies) and, as their partners, one run of each class with the same anchor that is told already."""
    wanted = marked.where(~F.col("whole")).select("anchor").distinct()
    # classes are made before the join, so that a periodic text, all of whose runs are alike, sends one row for each
    classes = marked.where("whole").groupBy("anchor", "outer", "before", "width").agg(F.min(F.struct("node", "at", "low", "high")).alias("r"))
    told = classes.join(wanted, "anchor", "left_semi").select("r.*", "anchor")
    runs_at = marked.where(~F.col("whole")).select("node", "at", "low", "high", "anchor").union(told)
    return stored(runs_at.groupBy("node").agg(F.collect_list(F.struct("anchor", "at", "low", "high")).alias("runs"), F.count(F.lit(1)).alias("n")))


def word_run_column(part: pa.RecordBatch) -> dict:
    w = words(part.column("text"))
    found = anchored_runs(prefix_sums(w.hash), w.first, PASSAGE, WORD_GRAM)
    return {k: found[k] for k in ("anchor", "outer", "at", "low", "high")} | {"node": part.column("node").take(pa.array(found["doc"]))}


def word_start_column(part: pa.RecordBatch) -> dict | None:
    """Hashes of the strings of words at all starts of the runs that are still open."""
    w = words(part.column("text"))
    total, inverse = prefix_sums(w.hash)
    rows, starts, anchors, keys = [], [], [], []
    for i, runs in enumerate(part.column("runs").to_pylist()):
        for r in runs:
            p = np.arange(r["low"], r["high"] + 1)
            b = p + w.first[i]
            keys.append(mix(hash_between(total, inverse, b, b + PASSAGE) + (r["at"] - p).astype(np.uint64)))
            anchors.append(np.full(len(p), r["anchor"]))
            rows.append(np.full(len(p), i))
            starts.append(p)
    if not rows:
        return None
    return {"node": part.column("node").take(pa.array(np.concatenate(rows))), "start": np.concatenate(starts), "anchor": np.concatenate(anchors), "key": np.concatenate(keys).view(np.int64)}


def passages(docs: DataFrame) -> tuple[DataFrame, str]:
    """(node, n_passages, n_passage_words) of texts with passages of PASSAGE words or more that recur, and the stored table."""
    spark = docs.sparkSession
    long = named(docs).where(F.octet_length("text") >= PASSAGE).select("node", "text")
    runs, p_runs = shared_runs(map_slices(long, word_run_column, _RUNS_SQL, _RUNS))
    marked, p_marked = told_runs(runs)
    drop(spark, p_runs)
    runs_at, p_open = open_runs(marked)
    texts_of = pick(long, runs_at).groupBy("node").agg(F.first("text").alias("text")).join(runs_at, "node").select("node", "text", "runs")
    starts, p_starts = stored(map_slices(texts_of, word_start_column, _STARTS_SQL, _STARTS))
    keys, p_keys = repeated(starts, "anchor", "key")
    full = marked.where("whole").select("node", F.col("low").alias("start"), (F.col("high") + PASSAGE).alias("end"))
    found = full.union(starts.join(keys, ["anchor", "key"]).select("node", "start", (F.col("start") + PASSAGE).alias("end")))
    # starts that follow one another are one stretch; what is left by node is bounded by the text's length
    order = Window.partitionBy("node").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("reach", reach).withColumn("new", F.col("reach").isNull() | (F.col("start") > F.col("reach")))
    covered = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("reach", F.col("start"))), F.lit(0))
    out = stored(fresh.groupBy("node").agg(F.count_if("new").alias("n_passages"), F.sum(covered).cast("long").alias("n_passage_words")))
    drop(spark, p_marked, p_open, p_starts, p_keys)
    return out


def intervals(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, start, end) of strings that recur, and the stored tables that it reads."""
    spark = docs.sparkSession
    long = named(docs).where(F.octet_length("text") >= LENGTH).select("node", "text")
    runs, p_runs = shared_runs(map_slices(long, run_column, _RUNS_SQL, _RUNS))
    marked, p_marked = told_runs(runs)
    drop(spark, p_runs)
    full, p_full = stored(marked.where("whole").select("node", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end")))
    runs_at, p_wanted = open_runs(marked)
    drop(spark, p_marked)
    contexts_arrow = pa.schema([("node", pa.binary()), ("anchor", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary())])
    found = pick(long, runs_at).groupBy("node").agg(F.first("text").alias("text")).join(runs_at, "node").select("node", "text", "runs")
    contexts = map_slices(found, context_column, "node binary, anchor long, at int, low int, high int, context binary", contexts_arrow)
    contexts, p_contexts = stored(contexts)
    drop(spark, p_wanted)
    cells_arrow = pa.schema([("node", pa.binary()), ("anchor", pa.int64()), ("at", pa.int32()), ("cell", pa.int32()), ("inner", pa.int64()), ("outer", pa.int64())])
    cells = map_slices(contexts, cell_column, "node binary, anchor long, at int, cell int, inner long, outer long", cells_arrow, column="context")
    inner, p_inner = repeated(cells, "anchor", "inner")
    live, p_live = stored(cells.join(inner, ["anchor", "inner"]).select("node", "anchor", "at", "cell", "inner", "outer"))
    outer, p_outer = repeated(live, "anchor", "outer")
    told = live.join(outer.withColumn("whole", F.lit(True)), ["anchor", "outer"], "left")
    told, p_told = stored(told.select("node", "anchor", "at", "cell", "inner", "outer", F.coalesce("whole", F.lit(False)).alias("whole")))
    drop(spark, p_inner, p_live, p_outer)
    first = F.col("at") - CELL * (F.col("cell") + 1) + 1
    by_cell = told.where("whole").select("node", first.alias("start"), (first + CELL - 1 + LENGTH).alias("end"))
    # partners of open cells: the open ones themselves and one cell of each class that is told already
    wanted = told.where(~F.col("whole")).select("anchor", "inner").distinct()
    one = told.where("whole").join(wanted, ["anchor", "inner"], "left_semi").groupBy("anchor", "inner", "outer").agg(F.min(F.struct("node", "at", "cell")).alias("r"))
    rest = told.where(~F.col("whole")).select("node", "at", "cell").union(one.select("r.*")).groupBy("node", "at").agg(F.collect_list("cell").alias("cells"))
    starts = map_slices(contexts.join(rest, ["node", "at"]), start_column, _STARTS_SQL, _STARTS, column="context")
    starts, p_starts = stored(starts)
    drop(spark, p_contexts)
    keys, p_keys = repeated(starts, "anchor", "key")
    by_start = starts.join(keys, ["anchor", "key"]).select("node", "start", (F.col("start") + LENGTH).alias("end"))
    return full.union(by_cell).union(by_start), [p_full, p_told, p_starts, p_keys]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs and the digest of what is left; passages that recur, and their words."""
    spark, rows = docs.sparkSession, named(docs)
    text = F.coalesce("text", F.lit(""))
    narrow = rows.select("node", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    # of texts with copies nothing is left, which needs no look at them
    copied, p_copied = stored(narrow.where(F.col("n_bytes") >= LENGTH).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
    found, paths = intervals(docs)
    spans = found.join(copied, "node", "left_anti").groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("s"), F.count(F.lit(1)).alias("n"))
    spans, _ = stored(spans.select("node", "n", F.col("s.start").alias("low"), F.col("s.end").alias("high")))
    drop(spark, *paths)
    cut_rows = pick(rows, spans).join(spans, "node").select("node", "doc_id", "text", "low", "high")
    cut_rows, _ = stored(map_slices(cut_rows, result_column, "node binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _RESULT))
    told = copied.select("node", F.lit(True).alias("copied")).union(spans.select("node", F.lit(False)))
    rest = narrow.join(told, "node", "left").where("copied is null or copied")
    gone = F.when(F.col("copied"), F.col("n_bytes")).otherwise(0).cast("long")
    nothing = F.when(F.col("copied"), sha256(b"")).otherwise(F.col("kept_sha256"))
    every = cut_rows.union(rest.select("node", "doc_id", "n_bytes", gone, F.when(F.col("copied"), 1).otherwise(0).cast("long"), nothing))
    counted = ["n_passages", "n_passage_words"]
    recurring, _ = passages(docs)
    return every.join(recurring, "node", "left").fillna(0, counted).select(*_RESULT.names[1:], *counted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
