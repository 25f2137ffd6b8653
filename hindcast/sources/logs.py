"""Readers: sharded event logs, query universes, labels, vocabularies, predictions.

Paths go to Spark's readers and to the Hadoop file system API, so any store that Spark knows will do.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TASK_QUERY, align
from . import files


def shard_names(spark: SparkSession, root: str, split: str) -> list[str]:
    """Sorted stems of the split's Parquet files; none raise FileNotFoundError."""
    found = sorted(name[:-8] for name, is_dir in files.entries(spark, f"{root}/data/{split}") if name.endswith(".parquet"))
    if not found:
        raise FileNotFoundError(f"no Parquet shards in {root}/data/{split}")
    return found


def read_log(spark: SparkSession, root: str, split: str) -> DataFrame:
    """All shards of a split with the shard's name as a column; pruned columns and filters reach the scan."""
    shard_names(spark, root, split)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return spark.read.parquet(f"{root}/data/{split}/*.parquet").withColumn("shard", stem)


def event_table_as_log(events: DataFrame) -> DataFrame:
    """An application's event table (user_id, ts, event_type, value) as an event log."""
    return events.select(
        F.col("user_id").cast("bigint").alias("subject_id"), F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_type").alias("code"), F.col("value").cast("double").alias("numeric_value")
    )


_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0"}


def _scalar(text: str, at: int, stops: str) -> tuple[str, int]:
    """The scalar that begins at a place, and the place behind it: quoted, or plain up to a stop or a comment."""
    quote = text[at]
    if quote not in "'\"":
        end = at
        while end < len(text) and text[end] not in stops and not (text[end] == "#" and text[end - 1] in " \t\n"):
            end += 1
        return text[at:end].strip(), end
    out, at = [], at + 1
    while at < len(text):
        if text[at] == quote == "'" and text[at : at + 2] == "''":
            out.append("'")
            at += 2
        elif text[at] == quote:
            return "".join(out), at + 1
        elif text[at] == "\\" and quote == '"':
            out.append(_ESCAPES.get(text[at + 1 : at + 2], text[at + 1 : at + 2]))
            at += 2
        else:
            out.append(text[at])
            at += 1
    raise ValueError(f"a quoted code doesn't end: {text[:80]!r}")


def _skip(text: str, at: int) -> int:
    """The next place that is neither white space nor part of a comment."""
    while at < len(text):
        if text[at] == "#" and (at == 0 or text[at - 1] in " \t\n"):
            at = text.find("\n", at) if "\n" in text[at:] else len(text)
        elif text[at].isspace():
            at += 1
        else:
            break
    return at


def parse_codes(text: str) -> list[str]:
    """Codes of a YAML list, or of the list under `codes`: plain or quoted scalars, a line each or in brackets."""
    wrong = ValueError("expected a list of codes, or a list under `codes`")
    at = _skip(text, 0)
    if text.startswith("---", at):
        at = _skip(text, at + 3)
    if m := re.compile(r"codes[ \t]*:").match(text, at):
        at = _skip(text, m.end())
    items: list[str] = []
    if text[at : at + 1] == "[":
        at = _skip(text, at + 1)
        while text[at : at + 1] != "]":
            if at >= len(text):
                raise wrong
            item, at = _scalar(text, at, ",]\n")
            items.append(item)
            at = _skip(text, at)
            if text[at : at + 1] == ",":
                at = _skip(text, at + 1)
            elif text[at : at + 1] != "]":
                raise wrong
        at = _skip(text, at + 1)
    else:
        while m := re.compile(r"-[ \t]+(?=\S)").match(text, at):
            item, at = _scalar(text, m.end(), "\n")
            items.append(item)
            at = _skip(text, at)
        if not items:
            raise wrong
    if at < len(text):
        raise wrong
    return items


def read_codes(spark: SparkSession, source: list[str] | str | None) -> list[str]:
    """A query universe: a list, a YAML file, a Parquet file with `code`, or a directory with metadata/codes.parquet."""
    if not source:
        raise ValueError("no query codes are configured")
    if not isinstance(source, str):
        codes = list(source)
        if not all(isinstance(c, str) for c in codes):
            raise ValueError("query codes must be strings")
    elif source.endswith((".yaml", ".yml")):
        codes = parse_codes(files.read_text(spark, source))
    else:
        path = source if source.endswith(".parquet") else f"{source}/metadata/codes.parquet"
        # a vocabulary: bounded by the number of codes, which the driver holds anyway
        codes = [r.code for r in spark.read.parquet(path).select("code").where("code is not null").distinct().orderBy("code").collect()]
    if not codes:
        raise ValueError(f"no query codes in {source}")
    return list(dict.fromkeys(codes))


LABEL_COLUMNS = ("subject_id", "prediction_time", "boolean_value", "occurs", "query", "duration_days")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """All label files of a directory, each cut to the known columns that it has; files that have other ones of them than the first raise.

    Files that lack no column in common are read in one scan; the schema of each comes from its footer.
    """
    named = [f"{path}/{n}" for n, _ in files.entries(spark, path) if n.endswith(".parquet")] if files.is_dir(spark, path) else []
    shapes: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(named) or [path]:
        columns = spark.read.parquet(file).columns
        shapes.setdefault(tuple(c for c in LABEL_COLUMNS if c in columns), []).append(file)
    if len(shapes) > 1:
        raise ValueError(f"label files differ in columns: { {v[0]: list(k) for k, v in shapes.items()} }")
    (columns, parts), = shapes.items()
    return spark.read.parquet(*parts).select(*columns)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(code, vocab_index); a vocabulary that can't be read is empty, with a warning."""
    try:
        return spark.read.parquet(path).select("code", F.col("`code/vocab_index`").cast("bigint").alias("vocab_index"))
    except Exception as e:  # noqa: BLE001 - whatever the store raises
        warnings.warn(f"no vocabulary at {path}: {e}", stacklevel=2)
        return spark.createDataFrame([], "code string, vocab_index bigint")


def read_predictions_csv(spark: SparkSession, path: str, code: str = "code", prob: str = "occurs_probs") -> DataFrame:
    """Predictions of a CSV file with epoch microseconds, under this library's column names."""
    from ..functions.columns import micros_to_time

    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("subject_id").cast("bigint").alias("subject_id"), micros_to_time(F.col("prediction_time")).alias("prediction_time"), F.col(code).alias("query"), F.col(prob).cast("double").alias("occurs_prob"))


def validate_task_dir(spark: SparkSession, path: str) -> list[str]:
    """Task files of a directory: only Parquet files or directories of shards, at least one; more than one file is worth a warning."""
    if not files.is_dir(spark, path):
        raise NotADirectoryError(f"{path} is no directory")
    found = [(n, is_dir) for n, is_dir in files.entries(spark, path) if not n.startswith(("_", "."))]
    if other := [n for n, is_dir in found if not n.endswith(".parquet") and not (is_dir and n.startswith("shard="))]:
        raise ValueError(f"{path} holds files that aren't Parquet: {sorted(other)[:5]}")
    if not found:
        raise FileNotFoundError(f"{path} holds no Parquet file")
    if sum(n.endswith(".parquet") for n, _ in found) > 1:
        warnings.warn(f"{path} holds {len(found)} files; all are read", stacklevel=2)
    return sorted(n for n, _ in found)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    validate_task_dir(spark, path)
    return align(read_labels(spark, path), TASK_QUERY)
