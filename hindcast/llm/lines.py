"""Line dedup by an exact set-similarity join.

A line is what stands between newlines; its tokens are its distinct words (maximal runs of ASCII
letters, digits and non-ASCII characters, A-Z lower-cased). A line goes if an earlier line, by
document and position, has a token set of Jaccard similarity SIMILARITY or more; whether that earlier
line goes itself does not matter. Documents are ordered by doc_id, nulls first, and by a digest of the
text where a doc_id repeats; rows equal in both are one document, so neither line is earlier. Lines
without tokens stay. Null texts stay null, texts without removed lines stay byte for byte.

Plan: lines are tokenised once. Equal token sets meet by key (two 64-bit hashes), which leaves one
line for each set. Its tokens are ordered by rarity: a histogram of tokens over all lines (a fixed
number of BUCKETS) gives each token a class, ties go by hash; the order is total, so the filters are
exact however coarse the histogram is. The rarest tokens, as many as two similar sets must share one
of, are posted; of the smaller set of a pair fewer will do. Length and positional filters cut the
pairs, and so do parity maps of each set: sets that differ in d tokens have maps that differ in at most d
bits. Posted tokens carry maps of 64 bits, of larger sets twice as many; pairs then meet maps of 64 * WIDE bits
before anything else is done with them. Tokens are posted and joined in PASSES parts, so that only one part's
shuffle files stand at a time. Jaccard is verified on the words of the lines themselves.

Only whether an earlier match exists counts, so families of near copies need not meet pair by pair:
first each set is held against the earliest holder of its least and of its greatest token hashes, a
linear number of pairs. Sets that pass the filters there are taken as settled until pairs are verified;
pairs of two such sets are not made. If the verification finds otherwise, what was left out is made up
for. Tokens are join keys; nothing is gathered by key, and adaptive execution splits hot ones.

Empty tables give none; columns besides doc_id and text (for the stage: and n_chars) are ignored or
stay as they are. Only DataFrame functions run.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, pick, stored, table

SIMILARITY = 0.8
OVERLAP = SIMILARITY / (1 + SIMILARITY)  # of the sum of two sizes, which similar sets have in common at least
BUCKETS = 1 << 16
WIDE = 4  # an even number of longs
LARGE = 40  # larger sets have two longs of their parity map posted, others one
PASSES = 3
MAPS = tuple(f"map{k}" for k in range(WIDE))
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
IN_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = (1 << 31) - 1


def line_words(content: F.Column) -> F.Column:
    """Words of a line; where all of it is ASCII, the faster function lowers the same letters."""
    lower = F.when(F.octet_length(content) == F.char_length(content), F.lower(content)).otherwise(F.translate(content, UPPER, LOWER))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def text_key() -> F.Column:
    return F.xxhash64(F.col("text"))


def place() -> F.Column:
    """Order of lines; a struct compares field by field, nulls first."""
    return F.struct("doc_id", "key", "line")


def line_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, name, name2, tokens) of each line with tokens: 31 bits of the hashes of its distinct words, in the order of the whole hashes, and two hashes of all of those."""
    lines = docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    # not a filter of the hashes, which would hash every line once for it and once more for what it keeps
    lines = lines.where(F.col("content").rlike(IN_WORD))
    hashed = F.sort_array(F.array_distinct(F.transform(line_words(F.col("content")), lambda w: F.xxhash64(w))))
    sets = lines.select("doc_id", "key", "line", hashed.alias("hashes"))
    names = F.xxhash64("hashes").alias("name"), F.xxhash64(F.lit(1), "hashes").alias("name2")
    return sets.select("doc_id", "key", "line", *names, F.transform("hashes", lambda h: h.bitwiseAND(REST).cast("int")).alias("tokens"))


def rarity(sets: DataFrame) -> F.Column:
    """Classes of the buckets as a literal array, a small number each: of one size, whatever the corpus."""
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    classes = [0] * BUCKETS
    for b, c in counts.select("b", F.least(F.lit(127), (F.log2("n") * 4).cast("int"))).collect():  # one row for each bucket at most
        classes[b] = c
    return F.from_json(F.lit(str(classes)), "array<bigint>")  # folded to a constant by the optimizer


def prefix_size(size: F.Column, least: F.Column) -> F.Column:
    """Of so many first tokens sets that share `least` tokens have one in common, both being ordered alike."""
    return (size - F.ceil(least - 1e-9) + 1).cast("int")


def described(sets: DataFrame, classes: F.Column) -> DataFrame:
    """One row for each set: name, place of its first line, size, parity map (map0, ...), sketch keys, and prefix, the rarest tokens."""
    ordered = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(classes[t.bitwiseAND(BUCKETS - 1)], 31).bitwiseOR(t)))
    size = F.size("tokens")
    rows = sets.select(
        "name", "name2", "doc_id", "key", "line", size.alias("size"),
        *(wide_map(k).alias(m) for k, m in enumerate(MAPS)),
        F.xxhash64(F.slice("tokens", 1, 2)).alias("low"), F.xxhash64(F.slice("tokens", F.greatest(F.lit(1), size - 1), F.lit(2))).alias("high"),
        F.transform(F.slice(ordered, F.lit(1), prefix_size(size, size * SIMILARITY)), lambda t: t.bitwiseAND(REST).cast("int")).alias("prefix"),
    )
    of = ("size", *MAPS, "low", "high", "prefix")
    return rows.groupBy("name", "name2").agg(F.min(place()).alias("first"), *(F.first(c).alias(c) for c in of)).select("name", "name2", "first.*", *of)


def wide_map(k: int) -> F.Column:
    """Part k of a parity map of 64 * WIDE bits of the column tokens."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63))
    own = lambda t: F.shiftright(t, 6).bitwiseAND(WIDE - 1) == k
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda m, t: F.when(own(t), m.bitwiseXOR(bit(t))).otherwise(m))


def folded() -> list[F.Column]:
    """The maps that posted tokens carry: map of 64 bits, and half, of large sets alone, the part of it that comes of the odd longs."""
    total = lambda names: functools.reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, names))
    return [total(MAPS).alias("map"), F.when(F.col("size") > LARGE, total(MAPS[1::2])).alias("half")]


def alike(a: str, b: str) -> F.Column:
    """Length filter and parity map, for sets that differ in d tokens at most."""
    both = F.col(f"{a}size") + F.col(f"{b}size")
    apart = both - 2 * F.ceil(both * OVERLAP - 1e-9)
    return (F.least(f"{a}size", f"{b}size") >= F.greatest(f"{a}size", f"{b}size") * SIMILARITY - 1e-9) & (differing(a, b) <= apart)


def differing(a: str, b: str) -> F.Column:
    """Bits in which two parity maps differ, in two parts where both sets have them."""
    whole, half = (F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}")) for m in ("map", "half"))
    return F.coalesce(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)), F.bit_count(whole))


def rank() -> F.Column:
    """A number that never falls along the order of lines of distinct documents."""
    within = F.least(F.col("line"), F.lit((1 << 20) - 1)).cast("long")
    return F.shiftleft(F.greatest(F.least(F.coalesce("doc_id", F.lit(-(1 << 42))), F.lit(1 << 42)), F.lit(-(1 << 42))), 20) + within


def family_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b, bits, later): sets b against the earliest set a with one of their sketch keys, where both may be similar."""
    rows = firsts.where("size > 3").select("id", "size", *folded(), rank().alias("rank"), F.explode(F.array("low", "high")).alias("sketch"))
    of = [F.min_by(c, "rank").alias(f"h_{c}") for c in ("id", "size", "map", "half", "rank")]
    heads = rows.groupBy("sketch").agg(F.count(F.lit(1)).alias("n"), *of).where("n > 1").drop("n")
    met = rows.join(heads, "sketch").where((F.col("id") != F.col("h_id")) & alike("", "h_"))
    return met.select(F.col("h_id").alias("a"), F.col("id").alias("b"), differing("", "h_").alias("bits"), (F.col("h_rank") < F.col("rank")).alias("later")).distinct()


def posted_pairs(sets: DataFrame, late: int) -> tuple[DataFrame, list[str]]:
    """(a, b, bits): sets of state `late` with all sets that share a posted token, where both may be similar; and the stored tables that are read."""
    parts = [stored(posted_part(sets, late, i)) for i in range(PASSES)]
    return functools.reduce(DataFrame.union, (part for part, _ in parts)), [path for _, path in parts]


def posted_part(sets: DataFrame, late: int, part: int) -> DataFrame:
    """As posted_pairs, for the tokens of one part.

    The smaller set of a pair needs fewer tokens, which spares a third of the rows; sets of another state don't meet
    each other, so theirs have all tokens on the one side.
    """
    rows = sets.select("id", "size", "map", "half", (F.col("state") != late).alias("other"), F.posexplode("prefix").alias("at", "token"))
    rows = rows.where(F.shiftright("token", 16) % PASSES == part)
    fewer = F.col("at") < prefix_size(F.col("size"), F.col("size") * 2 * OVERLAP)
    side = lambda df, c: df.select("token", *(F.col(x).alias(f"{c}_{x}") for x in ("id", "size", "map", "half", "at", "other")))
    x, y = side(rows.where(F.col("other") | fewer), "l"), side(rows.where(~F.col("other")), "r").drop("r_other")
    rest = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at"))
    filters = (F.col("l_other") | (F.col("l_size") <= F.col("r_size"))) & (F.col("l_id") != F.col("r_id")) & alike("l_", "r_") & (rest >= F.ceil((F.col("l_size") + F.col("r_size")) * OVERLAP - 1e-9))
    met = x.join(y, (x.token == y.token) & filters)
    return met.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), differing("l_", "r_").alias("bits")).distinct()


def similar() -> F.Column:
    """Whether a_text and b_text are similar; a_size and b_size tell their numbers of distinct words.

    Every term stands once, as a filter evaluates it as often as it stands there.
    """
    both = F.size(F.array_intersect(line_words(F.col("a_text")), line_words(F.col("b_text"))))
    return both * (1 + SIMILARITY) >= SIMILARITY * (F.col("a_size") + F.col("b_size")) - 1e-9


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> tuple[DataFrame, str]:
    """Ids of the later sets of candidate pairs (a, b, a_size, b_size) that are similar."""
    spark = docs.sparkSession
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = involved.join(firsts.select("id", "doc_id", "key", "line"), "id").groupBy("doc_id", "key")
    wanted, p_wanted = stored(wanted.agg(F.collect_list(F.struct("line", "id")).alias("lines"), F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "node"))
    own = pick(docs.select("doc_id", F.col("key").alias("node"), "text"), wanted)
    rows = own.alias("d").join(wanted.alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    lines = rows.select("d.doc_id", "d.node", F.split("text", "\n").alias("content"), F.explode("lines").alias("at"))
    lines = lines.select("at.id", F.struct("doc_id", F.col("node").alias("key"), F.col("at.line").alias("line")).alias("place"), F.element_at("content", F.col("at.line") + 1).alias("text"))
    # rows that repeat doc_id and text give one line
    lines, p_lines = stored(lines.groupBy("id").agg(F.min(F.struct("place", "text")).alias("x")).select("id", "x.*"))
    side = lambda c: lines.select(F.col("id").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("place", "text")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(similar())
    found, path = stored(both.select(F.when(F.col("a_place") < F.col("b_place"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    drop(spark, p_wanted, p_lines)
    return found, path


def later_sets(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Ids of sets that are the later ones of a similar pair among candidate pairs (a, b).

    One match settles a set: each is held against the candidate whose map differs least first, and only those
    that this doesn't settle against the others. Pairs of lines of one doc_id, whose order only the lines'
    places tell, are all verified at once.
    """
    both = ("a", "b", "a_size", "b_size")
    pairs, p_pairs = stored(pairs)
    involved, p_involved = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    known, p_known = stored(pick(firsts.select(F.col("id").alias("node"), rank().alias("rank"), "size", *MAPS), involved))
    side = lambda c: known.select(F.col("node").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in known.columns[1:]))
    bits = functools.reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAPS))
    sizes = F.col("a_size") + F.col("b_size")
    # wider maps than the posted ones come first, so that few pairs go any further
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(bits <= sizes - 2 * F.ceil(sizes * OVERLAP - 1e-9))
    first = F.col("a_rank") < F.col("b_rank")
    ordered = close.select(
        *(F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(both, ("b", "a", "b_size", "a_size"), strict=True)),
        bits.alias("bits"), (F.shiftright("a_rank", 20) != F.shiftright("b_rank", 20)).alias("certain"),
    )
    ordered, p_ordered = stored(ordered)
    drop(docs.sparkSession, p_pairs, p_involved, p_known)
    best = ordered.where("certain").groupBy("b").agg(F.min_by(F.struct("a", "a_size", "b_size"), "bits").alias("x")).select("x.a", "b", "x.a_size", "x.b_size")
    best, p_best = stored(best.union(ordered.where("not certain").select(*both)))
    settled, p_settled = verified(best, firsts, docs)
    rest = ordered.where("certain").select(*both).join(settled.select(F.col("id").alias("b")), "b", "left_anti").join(best, ["a", "b"], "left_anti")
    rest, p_rest = stored(rest.select(*both))
    paths = [p_settled]
    if not rest.isEmpty():
        more, p_more = verified(rest, firsts, docs)
        settled, paths = settled.union(more).distinct(), [*paths, p_more]
    drop(docs.sparkSession, p_ordered, p_best, p_rest)
    return settled, paths


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, key, line) of all lines with an earlier match, and the stored tables it reads. docs has doc_id, key and text."""
    spark = docs.sparkSession
    sets, p_sets = stored(line_sets(docs))
    firsts, p_firsts = stored(described(sets, rarity(sets)).withColumn("id", F.monotonically_increasing_id()))
    names, p_names = stored(sets.drop("tokens"))
    drop(spark, p_sets)
    family, p_family = stored(family_pairs(firsts))
    held = family.where("later").select(F.col("b").alias("id")).distinct().withColumn("state", F.lit(1))
    # what is posted is joined with its state once, not in each pass
    open_or_held = firsts.where("size > 3").select("id", "size", *folded(), "prefix").join(held, "id", "left").withColumn("state", F.coalesce("state", F.lit(0)))
    open_or_held, p_open = stored(open_or_held)
    # pairs of two sets that are held as settled are left out
    posted, p_posted = posted_pairs(open_or_held, 0)
    drop(spark, p_open)
    made = posted.union(family.select(F.least("a", "b"), F.greatest("a", "b"), "bits"))
    gone, p_gone = later_sets(made.select("a", "b").distinct(), firsts, docs)
    wrong, p_wrong = stored(held.join(gone, "id", "left_anti").select("id", F.lit(2).alias("state")))
    drop(spark, *p_posted)
    paths = [p_names, p_firsts, *p_gone]
    if not wrong.isEmpty():
        states = held.join(wrong.select("id", F.lit(2).alias("is")), "id", "left").select("id", F.coalesce("is", "state").alias("state"))
        left_out, p_left = stored(firsts.where("size > 3").select("id", "size", *folded(), "prefix").join(states, "id"))
        posted, p_posted = posted_pairs(left_out, 2)
        drop(spark, p_left)
        more, p_more = later_sets(posted.select("a", "b").distinct(), firsts, docs)
        drop(spark, *p_posted)
        gone, paths = gone.union(more).distinct(), [*paths, *p_more]
    drop(spark, p_family, p_wrong)
    # a set with an earlier match loses all its lines, any other all but its first
    told = firsts.select("id", "name", "name2", place().alias("first")).join(gone.withColumn("gone", F.lit(True)), "id", "left")
    rows = names.join(told, ["name", "name2"]).where(F.col("gone") | (F.col("first") < place())).select("doc_id", "key", "line")
    return rows, paths


def marked(docs: DataFrame) -> DataFrame:
    """Every row with `__removed`, the numbers of its lines that go (null: none)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key())
    rows, paths = repeated_lines(narrow)
    lines = rows.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set("line").alias("__removed"))
    lines, _ = stored(lines)
    drop(docs.sparkSession, *paths)
    same = (text_key() == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    return docs.join(lines, same, "left").drop("__id", "__key")


def kept_text() -> F.Column:
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i))
    return F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated lines, number of lines and of removed lines."""
    return marked(docs.select("doc_id", "text")).select(
        "doc_id", kept_text().alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def keep_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; documents stay, with n_chars of what is left."""
    found = marked(docs).withColumn("text", kept_text()).withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return found.select(*docs.columns)


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), lines AS (
  SELECT doc_id, line, content, list_distinct(list_filter(string_split_regex(
    translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '')) AS toks
  FROM split
), tok AS (SELECT doc_id, line, len(toks) AS size, unnest(toks) AS t FROM lines WHERE len(toks) > 0),
df AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
ranked AS (SELECT doc_id, line, size, t, row_number() OVER (PARTITION BY doc_id, line ORDER BY n, t) AS r FROM tok JOIN df USING (t)),
pre AS (SELECT * FROM ranked WHERE r <= size - ceil(size * 0.8 - 1e-9) + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS d1, a.line AS l1, b.doc_id AS d2, b.line AS l2 FROM pre a JOIN pre b ON a.t = b.t
  AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.line < b.line) AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) - 1e-9
), gone AS (
  SELECT DISTINCT d2 AS doc_id, l2 AS line FROM cand JOIN lines x ON x.doc_id = d1 AND x.line = l1 JOIN lines y ON y.doc_id = d2 AND y.line = l2
  WHERE len(list_intersect(x.toks, y.toks)) >= 0.8 * (len(x.toks) + len(y.toks) - len(list_intersect(x.toks, y.toks))) - 1e-9
), told AS (SELECT s.doc_id, s.line, s.content, g.doc_id IS NOT NULL AS g FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.line = g.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g) AS n_removed,
       md5(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT g), '')) AS kept_md5
FROM told GROUP BY doc_id
"""
