"""Batch scoring: sequences for task rows, a pluggable scorer over Arrow batches, prediction tables.

A scorer is a function of a pandas frame (codes, numeric_values, time_deltas, duration_days) that
returns two arrays of probabilities, censored and occurring, and perhaps a matrix of embeddings.
Identifiers travel inside each batch, so row order is of no matter.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..schemas import PREDICTION, align
from ..sources import files, logs

Scorer = Callable[[pd.DataFrame], tuple]
_IDS = ["subject_id", "prediction_time", "boolean_value", "query", "duration_days"]


def logistic_scorer(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A deterministic stand-in: longer windows and histories raise the odds."""
    size = batch["codes"].map(len).to_numpy(dtype=float)
    days = batch["duration_days"].to_numpy(dtype=float)
    occurs = 1 / (1 + np.exp(-(0.02 * size + np.log1p(days) - 2)))
    censor = 1 / (1 + np.exp(-(np.log1p(days) - math.log(30))))
    return censor, occurs


def check_batch(batch: pd.DataFrame, longest: int | None = None, n_codes: int | None = None, mode: str = "SM") -> None:
    """Codes, values and deltas of a row must be of one length and no longer than asked for, codes must be known, and a row can't be padding alone."""
    if mode not in sq.MODES:
        raise ValueError(f"mode must be one of {sq.MODES}, got {mode!r}")
    sizes = [batch[c].map(len) for c in ("codes", "numeric_values", "time_deltas")]
    if not (sizes[0].eq(sizes[1]).all() and sizes[0].eq(sizes[2]).all()):
        raise ValueError("codes, numeric_values and time_deltas differ in length")
    if longest is not None and (sizes[0] > longest).any():
        raise ValueError(f"a sequence is longer than {longest}")
    codes = np.concatenate([np.asarray(c, dtype=np.int64) for c in batch["codes"]]) if len(batch) else np.zeros(0, np.int64)
    if n_codes is not None and len(codes) and (codes.min() < 0 or codes.max() >= n_codes):
        raise ValueError(f"a code is outside 0..{n_codes - 1}")
    if len(batch) and not batch["codes"].map(lambda c: bool(np.any(np.asarray(c) != sq.PAD))).all():
        raise ValueError("a sequence is padding alone")


def collate(batch: pd.DataFrame, split: bool = True) -> dict[str, np.ndarray]:
    """A batch as matrices: codes, values and deltas padded at the end, the mask of what isn't padding, and vectors.

    With `split` the label comes as two flags, censored and occurs. `durations` are in years of 365 days, which is
    what a scorer puts at position 1, behind the query token; `with_duration` makes room for it.
    """
    n, width = len(batch), max((len(c) for c in batch["codes"]), default=0)
    out = {"code": np.full((n, width), sq.PAD, dtype=np.int64), "numeric_value": np.full((n, width), np.nan), "time_delta_days": np.zeros((n, width))}
    for name, column in (("code", "codes"), ("numeric_value", "numeric_values"), ("time_delta_days", "time_deltas")):
        for i, own in enumerate(batch[column]):
            out[name][i, : len(own)] = own
    out["numeric_value_mask"] = ~np.isnan(out["numeric_value"])
    out["numeric_value"] = np.nan_to_num(out["numeric_value"])
    out["mask"] = out["code"] != sq.PAD
    out["query"] = out["code"][:, 0] if width else np.zeros(n, np.int64)
    out["durations"] = batch["duration_days"].to_numpy(dtype=np.float32) / np.float32(365)
    if split and "boolean_value" in batch:
        label = batch["boolean_value"]
        out["censored"] = label.isna().to_numpy()
        out["occurs"] = (label == True).to_numpy(dtype=bool)  # noqa: E712 - null compares as false
    return out


def with_duration(embedded: np.ndarray, mask: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded tokens (rows, length, width) and their mask with the duration's embedding (rows, width) put in at position 1."""
    return np.insert(embedded, 1, duration, axis=1), np.insert(mask, 1, True, axis=1)


def assemble(tasks: DataFrame, log: DataFrame, vocabulary: DataFrame, longest: int) -> DataFrame:
    """Task rows with their token sequences, query first."""
    tokens = sq.subject_tokens(sq.encode(log, vocabulary))
    return sq.with_query(sq.history(tasks, tokens, longest - 1), vocabulary, longest)


def score(sequences: DataFrame, scorer: Scorer = logistic_scorer, embedding: int | None = None) -> DataFrame:
    """Prediction rows, with `embedding` as array<float> of that width if asked for."""
    schema = "subject_id long, prediction_time timestamp_ntz, boolean_value boolean, query string, duration_days float, censor_prob float, occurs_prob float" + (", embedding array<float>" if embedding else "")

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            check_batch(frame)
            made = scorer(frame)
            if any(len(x) != len(frame) for x in made):
                raise ValueError("the scorer returned another number of rows")
            out = frame[_IDS].assign(censor_prob=np.asarray(made[0], dtype=np.float32), occurs_prob=np.asarray(made[1], dtype=np.float32))
            if embedding:
                if np.shape(made[2])[1] != embedding:
                    raise ValueError(f"embeddings are {np.shape(made[2])[1]} wide, not {embedding}")
                out["embedding"] = list(np.asarray(made[2], dtype=np.float32))
            yield out

    if "boolean_value" not in sequences.columns:
        sequences = sequences.withColumn("boolean_value", F.lit(None).cast("boolean"))
    return sequences.select(*_IDS, "codes", "numeric_values", "time_deltas").mapInPandas(run, schema)


def check_codes(tasks: DataFrame, vocabulary: DataFrame) -> None:
    """Raise with a sample of task codes that the vocabulary lacks."""
    missing = [r.code for r in sq.unknown_codes(tasks, vocabulary).orderBy("code").limit(5).collect()]
    if missing:
        raise ValueError(f"task codes without vocabulary entry: {missing}")


def run(spark: SparkSession, tasks_dir: str, log: DataFrame, vocabulary: DataFrame, output: str, scorer: Scorer = logistic_scorer, longest: int = 512, embedding: int | None = None, overwrite: bool = False) -> dict:
    """Write predictions, timing and embeddings; all or nothing, and as many rows as tasks with a history.

    Rows are scored once, into a temporary table. The tables are made beside their targets, their rows
    counted there, and renamed last, the predictions after all others.
    """
    timing_path, embedding_path = files.sibling(output, "timing"), files.sibling(output, "embeddings")
    paths = [output, timing_path, *([embedding_path] if embedding else [])]
    if not overwrite:
        files.refuse_existing(spark, *paths)
    files.clean_temps(spark, output.rpartition("/")[0] or ".")
    began = time.time()
    tasks = logs.read_tasks(spark, tasks_dir)
    check_codes(tasks, vocabulary)
    scored = f"{output}.{uuid.uuid4().hex}{files.TEMP}"
    try:
        score(assemble(tasks, log, vocabulary, longest), scorer, embedding).write.parquet(scored)
        table = spark.read.parquet(scored)
        n, n_tasks = table.count(), tasks.select("query", "duration_days").distinct().count()
        wanted = tasks.join(log.select("subject_id").distinct(), "subject_id", "left_semi").count()
        if n != wanted:
            raise ValueError(f"{n} predictions for {wanted} task rows")
        total = time.time() - began
        timing = {"total_seconds": total, "n_rows": n, "n_tasks": n_tasks, "seconds_per_row": total / n if n else None, "seconds_per_task": total / n_tasks if n_tasks else None}
        schema = "total_seconds double, n_rows long, n_tasks long, seconds_per_row double, seconds_per_task double"
        tables = {timing_path: spark.createDataFrame([tuple(timing.values())], schema)}
        if embedding:
            width = F.assert_true(F.size("embedding") == embedding)
            tables[embedding_path] = table.select(*_IDS[:2], "query", "duration_days", "embedding").where(width.isNull())
        tables[output] = align(table.drop("embedding"), PREDICTION)

        def check(temps: dict[str, str]) -> None:
            for path in (output, embedding_path) if embedding else (output,):
                if (found := spark.read.parquet(temps[path]).count()) != n:
                    raise ValueError(f"{found} rows of {n} in {path}")

        files.write_all(tables, check)
    finally:
        files.delete(spark, scored)
    return timing
