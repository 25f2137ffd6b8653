"""Toxicity by maximum-scoring segments over token log-odds.

Fit: labelled rows outside the held-out fold, at most MAX_LABELLED of them and MAX_BYTES of their texts (the
smallest by a hash of doc_id, a third of them toxic if there are enough; documented bounds). The
logistic map weights the classes by their counts among all usable labels, so the cut is alike at every size.
Copies and near copies of a text within a class count once.
Document counts of tokens by class give each token a log-odds ratio with a Dirichlet prior (PRIOR
pseudo-counts in proportion to the pooled counts, and FLAT for every token); tokens whose likelihood
ratio is significant keep it, all others get a drift that makes the expected score of clean text
negative. Calibration is cross-fitted: each third of the rows is scored with the counts of the other
two. Best segment scores of clean documents are regressed on log length, the usual correction for
local alignment scores, and the rest follows a Gumbel law, fitted by moments.

Tokens of a word are the word itself and its first four, five and six bytes, so that wording that takes
many endings is learnt by its beginning; a word scores as its strongest token.

Score: a linear-time scan (all maximal scoring segments, a stack of candidate segments with
cumulative sums) finds every significant passage of a whole text. Each passage is turned into an
extreme-value tail probability; the significant passages of a document are aggregated by the
sum of their evidence, and a one-variable logistic map that is fitted on the calibration half gives a score in 0..1.

Only text is an input of a score. Null and empty texts have no passages and get the lowest score;
repeated rows give repeated results; further columns are ignored; without labels of both classes
every document scores the base rate. The fit is one task of a worker; what the driver holds and broadcasts is the
model: at most MAX_TOKENS tokens.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, slices, table, texts
from .textvec import Words, mix, ngrams, words

FOLDS = 5
MAX_LABELLED = 6000
MAX_BYTES = 64 << 20
MAX_TOKENS = 50_000
PRIOR, FLAT = 500.0, 0.5
LEAST_RATIO = 18.0
THIRDS = 3
SIGNIFICANT = -math.log(0.05)
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    """Sorted token hashes with scores, the score of all other tokens, Gumbel parameters and the logistic map."""

    tokens: np.ndarray
    weights: np.ndarray
    other: float
    location: float
    growth: float
    scale: float
    slope: float
    offset: float
    rate: float

    def word_scores(self, tokens: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The strongest token of each of n words."""
        best = np.full(n, self.other)
        if len(self.tokens):
            for hashes, of in tokens:
                at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
                hit = np.flatnonzero(self.tokens[at] == hashes)
                best[of[hit]] = np.maximum(best[of[hit]], self.weights[at[hit]])
        return best

    def evidence(self, best: float, length: int) -> float:
        """Minus the log of the tail probability of a segment score in a text of this length."""
        z = (best - self.location - self.growth * math.log(max(length, 1))) / self.scale
        if z > 30:
            return z
        return -math.log(max(-math.expm1(-math.exp(-max(z, -6.0))), 1e-300))

    def score(self, evidence: float) -> float:
        if not len(self.tokens):
            return self.rate
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0 if doc_id is not None else False


def word_tokens(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """By kind: token hashes and the words they belong to."""
    found = [(w.hash, np.arange(len(w), dtype=np.int32))]
    size = w.end - w.start
    for n in PREFIXES:
        of = np.flatnonzero(size > n).astype(np.int32)
        found.append((mix(w.span_hash(w.start[of], w.start[of] + n) + np.uint64(n)), of))
    return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Candidates are kept with the cumulative sums at their left and right ends. Runs of negative scores
    between positive tokens are summed beforehand, so that the loop visits positive tokens alone.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    cumulative = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, start, end = [], [], [], []
    for i in positive.tolist():
        new_left, new_right, first = cumulative[i], cumulative[i + 1], i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= new_left:
                j -= 1
            if j < 0 or right[j] >= new_right:
                break
            new_left, first = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:]
        left.append(new_left)
        right.append(new_right)
        start.append(first)
        end.append(i + 1)
    return [(a, b, float(r - x)) for a, b, x, r in zip(start, end, left, right, strict=True)]


def log_odds(toxic: Counter, clean: Counter, n1: int, n0: int) -> tuple[dict[int, float], float]:
    """Scores of tokens and of all other tokens; the drift keeps the clean mean negative."""
    t1, t0 = sum(toxic.values()), sum(clean.values())
    scores = {}
    for token, y1 in toxic.items():
        y0 = clean.get(token, 0)
        e1, e0 = (y1 + y0) * n1 / (n1 + n0), (y1 + y0) * n0 / (n1 + n0)
        if y1 <= e1 or 2 * (y1 * math.log(y1 / e1) + (y0 * math.log(y0 / e0) if y0 else 0.0)) < LEAST_RATIO:
            continue
        a = PRIOR * (y1 + y0) / (t1 + t0) + FLAT
        mass1, mass0 = t1 + PRIOR + FLAT * len(toxic), t0 + PRIOR + FLAT * len(clean)
        ratio = math.log((y1 + a) / (mass1 - y1 - a)) - math.log((y0 + a) / (mass0 - y0 - a))
        if ratio > 0:
            scores[token] = ratio
    mean = sum(scores[t] * clean.get(t, 0) for t in scores) / max(t0, 1)
    other = -max(0.02, 2 * mean, 0.01 * max(scores.values(), default=0.0))
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:MAX_TOKENS]), other


SKETCH, COPY = 8, 6


def distinct(rows: list[tuple[int, str | None, int]]) -> list[tuple[list, int, int]]:
    """Tokens, numbers of words and labels of rows without near copies: a row goes if COPY of SKETCH least word triples are those of one earlier row of its class.

    Rows that share a passage, but not most of their triples, stay.
    """
    seen: dict[tuple[int, int, int], list[int]] = {}
    out = []
    for i, (_, text, label) in enumerate(rows):
        w = words(pa.array([text], pa.string()))
        h, _ = ngrams(w.hash, w.first, min(3, max(len(w), 1)))
        keys = [(label, s, int(mix(h ^ np.uint64(s + 1)).min()) if len(h) else 0) for s in range(SKETCH)]
        shared = Counter(j for k in keys for j in seen.get(k, ()))
        if not shared or max(shared.values()) < COPY:
            out.append((word_tokens(w), len(w), label))
            for k in keys:
                seen.setdefault(k, []).append(i)
    return out


def token_model(tokens: list[np.ndarray], labels: list[int], rate: float) -> Model:
    counts = (Counter(), Counter())
    for found, label in zip(tokens, labels, strict=True):
        counts[label].update(found.tolist())
    weights, other = log_odds(counts[1], counts[0], sum(labels), len(labels) - sum(labels)) if 0 < sum(labels) < len(labels) else ({}, -1.0)
    keys = np.array(sorted(weights), dtype=np.uint64)
    return Model(keys, np.array([weights[t] for t in keys.tolist()]), other, 0.0, 0.0, 1.0, 1.0, 0.0, rate)


def best_segments(w: Words, model: Model) -> list[list[tuple[int, int, float]]]:
    scores = model.word_scores(word_tokens(w), len(w))
    return [maximal_segments(scores[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def document_evidence(segments: list[tuple[int, int, float]], length: int, model: Model) -> float:
    found = [model.evidence(s, length) for _, _, s in segments]
    return max(sum(e for e in found if e > SIGNIFICANT), max(found, default=0.0))


def fit(rows: list[tuple[int, str | None, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on (doc_id, text, label) rows, which the caller bounds; a row of a class stands for so many as its weight."""
    empty = np.zeros(0, np.uint64)
    rate = sum(weights[1] * r[2] for r in rows) / sum(weights[r[2]] for r in rows) if rows else 0.0
    if rate in (0.0, 1.0):
        return Model(empty, np.zeros(0), -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, rate)
    rows = sorted(rows, key=lambda r: (zlib.crc32(f"order {r[0]}".encode()), r[0]))
    kept = distinct(rows)
    tokens = [np.unique(np.concatenate([h for h, _ in kinds])) for kinds, _, _ in kept]
    labels = [label for *_, label in kept]
    model = token_model(tokens, labels, rate)
    if not len(model.tokens):
        return model
    found = []
    for third in range(THIRDS):
        rest = [i for i in range(len(kept)) if i % THIRDS != third]
        other = token_model([tokens[i] for i in rest], [labels[i] for i in rest], rate)
        for kinds, n, label in kept[third::THIRDS]:
            found.append((maximal_segments(other.word_scores(kinds, n)), n, label))
    # best scores of clean documents: regression on log length, then a Gumbel law of the rest by moments
    clean = [(max((s for _, _, s in seg), default=0.0), math.log(max(n, 1))) for seg, n, label in found if label == 0]
    best, logs = np.array(clean or [(0.0, 0.0)]).T
    spread = float(((logs - logs.mean()) ** 2).sum())
    model.growth = max(float(((logs - logs.mean()) * best).sum()) / spread, 0.0) if spread else 0.0
    rest = best - model.growth * logs
    model.scale = max(float(np.std(rest)) * math.sqrt(6) / math.pi, 0.25 * float(np.min(model.weights)))
    model.location = float(np.mean(rest)) - 0.5772156649 * model.scale
    x = np.array([document_evidence(seg, n, model) for seg, n, _ in found])
    y = np.array([label for _, _, label in found], dtype=float)
    model.slope, model.offset = logistic(np.log1p(x), y, np.where(y == 1, weights[1], weights[0]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """One-variable weighted logistic regression by Newton steps with a small ridge.

    A step is halved until the loss falls, so the fit also ends where the classes lie far apart and whole steps swing.
    """
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(weight @ (np.logaddexp(0, z) - y * z)) + 0.005 * float(beta @ beta)

    beta = np.array([1.0, -1.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - 0.01 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(beta)
        # a quarter of the fall that the slope promises is asked for
        while np.abs(step).max() >= 1e-9 and loss(beta + step) > now - 0.25 * float(gradient @ step):
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        beta = beta + step
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit on at most `most` labelled rows outside the held-out fold, up to a third of them toxic."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    )
    picked = []
    for label, share in ((0, most - most // 3), (1, most // 3)):
        picked += [tuple(r) for r in usable.where(F.col("toxic") == label).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share).collect()]
    both = Counter(i for i, _ in picked)
    ids = spark.createDataFrame([(i, y) for i, y in picked if both[i] == 1], "doc_id long, toxic int")
    rows = texts(docs).join(F.broadcast(ids), "doc_id")  # at most `most` ids
    # one text for each labelled id, so that the sample stays bounded however often an id repeats
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # the sample's shares of the classes are bounded apart; weights restore those of all usable labels
    totals = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}

    def learn(batches):
        sample = bounded(batches)
        taken = Counter(y for *_, y in sample)
        weights = tuple(totals.get(y, 0) / taken[y] * len(sample) / sum(totals.values()) if taken[y] else 1.0 for y in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample, weights))], pa.binary())], names=["model"])

    # one task of a worker fits, so that the driver never holds the texts and their tokens
    ordered = rows.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    models = ordered.mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0].model) if models else fit([])


def bounded(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, str | None, int]]:
    """The first rows (doc_id, text, label) of the batches, MAX_BYTES of their texts."""
    sample, size = [], 0
    for batch in batches:
        for part in slices(batch):
            for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                size += len(row[1] or "")
                if sample and size > MAX_BYTES:
                    return sample
                sample.append(row)
    return sample


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64()), ("passages", pa.string())])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: score, decision and significant passages (first word:end word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(part: pa.RecordBatch) -> dict:
        model = shared.value
        w = words(part.column("text"))
        ids = part.column("doc_id").to_pylist()
        sizes = np.diff(w.first).tolist()
        out: dict[str, list] = {f.name: [] for f in _ARROW}
        for doc_id, segments, size in zip(ids, best_segments(w, model), sizes, strict=True):
            score = model.score(math.log1p(document_evidence(segments, size, model)))
            strong = [(a, b) for a, b, s in segments if model.evidence(s, size) > SIGNIFICANT]
            out["doc_id"].append(doc_id)
            out["held_out"].append(held_out(doc_id))
            out["score"].append(score)
            out["predicted"].append(int(score >= 0.5))
            out["n_passages"].append(len(strong))
            out["passages"].append(",".join(f"{a}:{b}" for a, b in strong))
        return out

    return map_slices(texts(docs), scan, _SCHEMA, _ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are predicted toxic go; all others stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    names = docs.columns

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                w = words(part.column(names.index("text")))
                found = zip(best_segments(w, model), np.diff(w.first).tolist(), strict=True)
                keep = [model.score(math.log1p(document_evidence(segments, size, model))) < 0.5 for segments, size in found]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
