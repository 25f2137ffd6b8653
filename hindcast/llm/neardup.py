"""Near-duplicate documents by Order MinHash and banded alignment.

Signature: words are shingled by five; repeats of a shingle are labelled by their occurrence number.
Each of BANDS hash functions picks the SAMPLE least labelled shingles of a document and keeps them in
text order, so equal picks need common content in a common order: the chance follows edit similarity.
Few shingles of a text of some dozen words survive the edits that the similarity allows, so texts of at
most MIDDLE words have picks of shingles of three words too, and texts of at most SHORT words have all
subsequences that leave out a fifth of their words at most, which finds every pair of them. The ranges
overlap so far that similar texts always have a kind of keys in common.

Candidates: documents that share a pick. Equal texts are one node from the start. Links are verified
by banded alignment of the word sequences: similarity 1 - distance / longer length, 0.8 or more.
First every node is held against the least of the least nodes of its buckets, then, if they are still in
different groups, against the least node of each bucket, which joins up groups of copies of any size with
a linear number of pairs. Then nodes that share a bucket and are still in
different groups are held against each other. In buckets of more than SMALL nodes an exact filter names
the pairs: texts that are alike differ in at most a fifth of the longer one's words, so in whatever
common order of words, the first fifth (and one more) of their words have one in common, and the first
fifth and FURTHER more have so many. The order is by rarity among the nodes in question, so that a passage
which many texts share names no pairs. Both are tested as pairs are made. Groups are connected components.

Nothing is gathered in a task by bucket: buckets are join keys, hot ones are split by adaptive
execution. Null and empty texts are copies of each other as equal texts only; texts of fewer than five
words match when their words are equal; repeated rows fall in one class; other columns are ignored.
"""

from __future__ import annotations

import functools
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import edit_distances
from .common import cut, drop, map_slices, pick, slices, stored, table, texts
from .components import components
from .textvec import mix, ngrams, words

SHINGLE, BANDS = 5, 80
SHORT_SHINGLE, SHORT_BANDS = 3, 48
SAMPLE = 2
SIMILARITY = 0.8
SHORT, MIXED = 14, 12
MIDDLE, LONG = 125, 100
SMALL = 24
BINS = 1 << 17
FURTHER, KIN = 12, 8
PASSES = 8  # over the words of large buckets, each with its part of what is shuffled

_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(values: np.ndarray) -> np.ndarray:
    """Hashes of values with repeats told apart by their occurrence number, so that shared elements count as in multisets."""
    n = len(values)
    if not n:
        return values
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = (np.arange(n) - np.repeat(fresh, np.diff(np.append(fresh, n)))).astype(np.uint64)
    return mix(values + occurrence * np.uint64(0xA0761D6478BD642F))


def order_picks(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The picks of all bands for the shingles of one text, in text order."""
    n = len(shingles)
    own = labelled(shingles)
    # an order of the shingles for each band: 32 bits are enough to compare, the key has all 64
    flip = (_SEEDS[:bands] >> np.uint64(32)).astype(np.uint32)
    scale = (_SEEDS[BANDS : BANDS + bands] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    values = ((own >> np.uint64(32)).astype(np.uint32)[None, :] ^ flip[:, None]) * scale[:, None]
    rows, picked = np.arange(bands), []
    for _ in range(min(SAMPLE, n)):
        picked.append(values.argmin(axis=1))
        values[rows, picked[-1]] = np.iinfo(np.uint32).max
    key = _SEEDS[:bands] + np.uint64(bands)
    for at in np.sort(np.stack(picked), axis=0):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + own[at])
    return key


@lru_cache
def left_over(n: int, out: int) -> np.ndarray:
    """Places that are left when `out` of n are taken out, one row for each way."""
    return np.array([[i for i in range(n) if i not in gone] for gone in combinations(range(n), out)], dtype=np.int64)


def short_keys(own: np.ndarray) -> np.ndarray:
    """Subsequences of a short text that leave out a fifth of its words at most."""
    keys = []
    for out in range(len(own) // 5 + 1):
        at = left_over(len(own), out)
        key = np.full(len(at), 0xE7037ED1A0B428DB, dtype=np.uint64)
        for k in range(at.shape[1]):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + own[at[:, k]])
        keys.append(key)
    return np.concatenate(keys)


def text_keys(own: np.ndarray) -> np.ndarray:
    """All keys of the words of one text."""
    n = len(own)
    keys = [short_keys(own)] if 0 < n <= SHORT else []
    for least, most, shingle, bands in ((MIXED, MIDDLE, SHORT_SHINGLE, SHORT_BANDS), (LONG, n, SHINGLE, BANDS)):
        if least <= n <= most:
            keys.append(order_picks(ngrams(own, np.array([0, n]), shingle)[0], bands))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)


def signature_column(part: pa.RecordBatch) -> dict:
    w = words(part.column("text"))
    keys = [text_keys(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    return {"node": part.column("node"), "size": np.diff(w.first), "keys": keys}


def node_column() -> F.Column:
    """The name of a text: its 128-bit digest."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(node, size, keys) for each distinct text."""
    named = docs.select(node_column().alias("node"), "text")
    made = map_slices(named, signature_column, "node binary, size long, keys array<long>", pa.schema([("node", pa.binary()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))]))
    return cut(made.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys")))


def verify_column(part: pa.RecordBatch) -> dict:
    a, b = words(part.column("text_a")), words(part.column("text_b"))
    pairs, limits = [], []
    for i in range(part.num_rows):
        x, y = a.hash[a.first[i] : a.first[i + 1]], b.hash[b.first[i] : b.first[i + 1]]
        pairs.append((x, y))
        limits.append(int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9))
    found = edit_distances(pairs, limits)
    keep = [i for i, (d, limit) in enumerate(zip(found, limits, strict=True)) if d <= limit]
    at = pa.array(keep, pa.int64())
    return {"a": part.column("a").take(at), "b": part.column("b").take(at), "similarity": [1 - found[i] / max(len(pairs[i][0]), len(pairs[i][1]), 1) for i in keep]}


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b, similarity) among candidate pairs (a, b)."""
    sides = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    nodes, p_nodes = stored(sides.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    named = docs.select(node_column().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    text, p_text = stored(pick(named, nodes).groupBy("node").agg(F.first("text").alias("text")))
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                out = verify_column(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    found = cut(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double"))
    drop(docs.sparkSession, p_nodes, p_text)
    return found


def near(size_a: str, size_b: str) -> F.Column:
    """Lengths that allow the similarity."""
    return F.least(size_a, size_b) >= SIMILARITY * F.greatest(size_a, size_b) - 1e-9


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs of nodes with different roots in the same bucket."""
    x = members.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
    y = members.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    every = x.join(y, (x.key == y.key) & (x.a < y.b) & (x.root_a != y.root_b) & near("size_a", "size_b"))
    return cut(every.select("a", "b").distinct())


def fifth(size: str) -> F.Column:
    """Words of so long a text that an edit may have touched at most."""
    return F.floor((1 - SIMILARITY) * F.col(size) + 1e-9).cast("int")


def rare_words(named: DataFrame) -> DataFrame:
    """(node, words): the rarest words of each text, rarest first, a fifth and FURTHER more of them, repeats told apart.

    Rarity is counted in BINS bins of word hashes, which is all that is sent around; the filter is exact in any order.
    """

    def own_words(part: pa.RecordBatch) -> list[np.ndarray]:
        w = words(part.column("text"))
        return [labelled(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]

    def bins(h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(BINS)).astype(np.int64)

    def count(batches):
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                for h in own_words(part):
                    np.add.at(total, bins(h), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    counts = np.zeros(BINS, dtype=np.int64)
    for i, n in named.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n")).toLocalIterator():
        counts[i] = n
    shared = named.sparkSession.sparkContext.broadcast(counts)

    def column(part: pa.RecordBatch) -> dict:
        found = []
        for h in own_words(part):
            order = np.lexsort((h, shared.value[bins(h)]))
            found.append((h[order[: int((1 - SIMILARITY) * len(h) + 1e-9) + FURTHER]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return {"node": part.column("node"), "words": found}

    return map_slices(named, column, "node binary, words array<int>", pa.schema([("node", pa.binary()), ("words", pa.list_(pa.int32()))]))


def split_pairs(members: DataFrame, docs: DataFrame) -> DataFrame | None:
    """As bucket_pairs, for large buckets: pairs that also share so many of their rarest words as they must; None without any such bucket.

    What meets are ends: groups of up to KIN nodes, with the words of all of them, and single nodes of larger
    groups. Ends of larger groups meet those of other groups alone, so that a group of any size is never paired
    with itself. A pair of ends comes out once, at the least word in common; then their nodes are tested.
    """
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    members = cut(members.join(mixed, "key"))
    if members.isEmpty():
        return None
    nodes, p_nodes = stored(members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("root").alias("root"), F.collect_set("key").alias("keys")))
    kin = nodes.groupBy("root").agg((F.count(F.lit(1)) > KIN).alias("large"))
    named = docs.select(node_column().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    text, p_text = stored(pick(named, nodes).groupBy("node").agg(F.first("text").alias("text")))
    # words are compared by 32 bits here, which may take two for one: so one less is asked for
    need = F.greatest(F.least(F.lit(FURTHER - 1), F.col("size") - fifth("size") - 1), F.lit(1))
    rare = rare_words(text).join(nodes.select("node", "root", "size"), "node").join(kin, "root")
    rare, p_rare = stored(rare.select("*", need.alias("need"), F.when(F.col("large"), F.col("node")).otherwise(F.col("root")).alias("end")))
    # at most KIN nodes, or one, stand behind an end
    ends = rare.groupBy("end").agg(F.first("root").alias("root"), F.first("large").alias("large"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("bag"), F.min("need").alias("need"), F.min("size").alias("low"), F.max("size").alias("high"))
    ends, p_ends = stored(ends)
    found = [ends_met(ends.withColumn("bag_of", F.filter("bag", lambda w: F.pmod(w, F.lit(PASSES)) == i))) for i in range(PASSES)]
    met = functools.reduce(DataFrame.union, found)
    side = lambda c: rare.select(F.col("end").alias(f"end_{c}"), F.col("node").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("words", "need", "size")))
    enough = F.size(F.array_intersect("words_a", "words_b")) >= F.least("need_a", "need_b")
    x, y = met.join(side("a"), "end_a"), side("b")
    pairs = cut(x.join(y, (x.end_b == y.end_b) & near("size_a", "size_b") & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    keys = lambda c: nodes.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"))
    out = cut(pairs.join(keys("a"), "a").join(keys("b"), "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b"))
    drop(docs.sparkSession, p_nodes, p_text, p_rare, p_ends)
    return out


def ends_met(ends: DataFrame) -> DataFrame:
    """Pairs of ends (end_a, end_b) whose least word in common is among bag_of, and that have as many in common as they need."""
    # the least words of each tell cheaply, for most of the words in common, that there is a lesser one
    posted = ends.select("*", F.slice("bag", 1, 16).alias("head"), F.explode("bag_of").alias("word")).drop("bag_of")
    several = posted.groupBy("word").agg(F.min("root").alias("least"), F.max("root").alias("greatest")).where("least != greatest").select("word")
    posted = posted.join(several, "word")
    x, y = (posted.select("word", *(F.col(k).alias(f"{k}_{c}") for k in ("end", "root", "large", "bag", "head", "need", "low", "high"))) for c in "ab")
    common = F.array_intersect("bag_a", "bag_b")
    long_enough = (F.col("high_a") >= SIMILARITY * F.col("low_b") - 1e-9) & (F.col("high_b") >= SIMILARITY * F.col("low_a") - 1e-9)
    least = F.coalesce(F.array_min(F.array_intersect("head_a", "head_b")) >= F.col("at"), F.lit(True))
    passes = long_enough & least & (F.size(common) >= F.least("need_a", "need_b")) & (F.col("at") == F.array_min(common))
    x = x.withColumnRenamed("word", "at")
    small = x.where("not large_a").join(y, (F.col("at") == y.word) & F.when(F.col("large_b"), F.col("root_a") != F.col("root_b")).otherwise(F.col("root_a") < F.col("root_b")) & passes)
    # larger groups that share words, then their nodes by those words
    shared = posted.where("large").select("word", "root").distinct()
    both = shared.withColumnRenamed("root", "root_a").join(shared.withColumnRenamed("root", "root_b"), "word").where("root_a < root_b").withColumnRenamed("word", "at")
    large = both.join(x.where("large_a"), ["at", "root_a"]).withColumnRenamed("root_b", "other")
    large = large.join(y, (F.col("at") == y.word) & (F.col("other") == y.root_b) & y.large_b & passes)
    return cut(small.select("end_a", "end_b").union(large.select("end_a", "end_b")))


def groups(docs: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a verified link, one root for each group of near duplicates."""
    docs = texts(docs)
    found = signatures(docs)
    rows = found.select("node", "size", F.explode("keys").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("least")).where("n > 1"))
    members = cut(rows.join(shared, "key"))
    first = cut(members.where((F.col("node") != F.col("least.node")) & near("size", "least.size")).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct())
    roots = components(verify(cut(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), docs))
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    # nodes without a root have no link yet, and their first pair has been held against each other
    apart = first.join(first.groupBy("b").agg(F.min("a").alias("a")), ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
    roots = merged(roots, cut(apart.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")), docs)
    rooted = cut(members.join(roots, "node", "left").select("key", "node", "size", "n", F.coalesce("root", "node").alias("root")))
    rest = bucket_pairs(rooted.where(F.col("n") <= SMALL))
    split = split_pairs(rooted.where(F.col("n") > SMALL).drop("n"), docs)
    if split is not None:
        rest = cut(rest.union(split).distinct())
    # pairs that have been held against each other already
    return merged(roots, cut(rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")), docs)


def merged(roots: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) after the links among candidate pairs, which are drawn between the roots found so far."""
    if pairs.isEmpty():
        return roots
    links = verify(pairs, docs)
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    drawn = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    over = components(drawn).select(F.col("node").alias("root"), F.col("root").alias("next"))
    joined = roots.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    new = over.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("next").alias("root"))
    return cut(joined.union(new))


def classes(docs: DataFrame) -> DataFrame:
    """Each row's doc_id and node with the class's root, class_id (the least doc_id of its class) and class_size."""
    named = texts(docs).select("doc_id", node_column().alias("node"))
    roots = groups(docs)
    per_node = named.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    rooted = cut(per_node.join(roots, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root")))
    totals = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    of = cut(rooted.join(totals, "root").select("node", "root", "class_id", "class_size"))
    return named.join(of, "node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", F.lower(F.hex("node")).alias("text_md5"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, that of the least doc_id (nulls last, then by text)."""
    first = classes(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    first = cut(first.select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__node")))
    kept = docs.join(first, (node_column() == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # rows that repeat both doc_id and text: one of them
    return kept.dropDuplicates(["__id", "__node"]).select(*(f"`{c}`" for c in docs.columns))
