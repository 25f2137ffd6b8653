"""Tasks and scores that come from outside: label tables with a wide table of code flags, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import code_slug, slug
from ..operators.label import split_label
from ..operators.metrics import composite_auroc, composite_probabilities, per_code_auroc
from ..schemas import TASK_QUERY, align
from ..sources import files, logs


def per_code_tasks(wide: DataFrame, labels: DataFrame, codes: list[str], duration_days: float) -> DataFrame:
    """Task rows of each code for labelled times: null where censored, which goes before the code's flag.

    wide has (subject_id, prediction_time, censored, a flag for each code); a labelled time that it lacks
    raises when its row is read. The outside label is kept as task_label, the code's slug as slug.
    """
    named = labels.select("subject_id", "prediction_time", F.col("boolean_value").alias("task_label"))
    joined = named.join(wide.select("subject_id", "prediction_time", "censored", *(F.col(f"`{c}`") for c in codes)), ["subject_id", "prediction_time"], "left")
    flags = F.array(*(F.struct(F.lit(c).alias("query"), F.col(f"`{c}`").cast("boolean").alias("flag")) for c in codes))
    lost = F.raise_error(F.lit("a labelled time has no row in the wide table")).cast("boolean")
    censored = F.when(F.col("censored").isNull(), lost).otherwise(F.col("censored"))
    long = joined.select("subject_id", "prediction_time", "task_label", censored.alias("censored"), F.inline(flags))
    value = F.when(F.col("censored"), F.lit(None).cast("boolean")).otherwise(F.col("flag"))
    tasks = long.select("subject_id", "prediction_time", value.alias("boolean_value"), "query", F.lit(duration_days).cast("float").alias("duration_days"), "task_label")
    return align(tasks, TASK_QUERY).withColumn("slug", code_slug(F.col("query")))


def write_per_code(tasks: DataFrame, output: str) -> None:
    """One directory for each code, by slug."""
    files.write_parquet_partitioned(tasks, output, ["slug"])


def run_per_code(spark: SparkSession, wide: str, labels: str, codes: list[str] | str, output: str, duration_days: float, overwrite: bool = False) -> str:
    """Task tables of each code from directories of wide flags and of outside labels, written by slug.

    Shards need no pairing: rows of both sides meet by subject and time.
    """
    if not overwrite:
        files.refuse_existing(spark, output)
    tasks = per_code_tasks(spark.read.parquet(wide), spark.read.parquet(labels), logs.read_codes(spark, codes), duration_days)
    write_per_code(split_label(tasks), output)
    return output


def read_per_code(spark: SparkSession, path: str) -> DataFrame:
    """(slug, subject_id, prediction_time, occurs) of a directory with one table for each code, named by slug: a file, or a directory with or without `slug=`."""
    parts = []
    for name, is_dir in files.entries(spark, path):
        if name.startswith(("_", ".")):
            continue
        stem = name.removeprefix("slug=") if is_dir else name.removesuffix(".parquet")
        parts.append(spark.read.parquet(f"{path}/{name}").select(F.lit(stem).alias("slug"), "subject_id", "prediction_time", "occurs"))
    if not parts:
        raise FileNotFoundError(f"{path} holds no tables of codes")
    while len(parts) > 1:  # a balanced tree, so that the plan of many codes stays shallow
        parts = [a.unionByName(b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]


def run_per_code_auroc(spark: SparkSession, predictions_csv: str, labels: str, output: str, code: str = "code", prob: str = "occurs_probs") -> DataFrame:
    """(query, auroc) of each code of a predictions CSV against its own table, written as CSV under a name with the time."""
    found = per_code_auroc(logs.read_predictions_csv(spark, predictions_csv, code, prob), read_per_code(spark, labels))
    # one row for each code
    files.write_csv(found.coalesce(1), files.stamped(output))
    return found


def composites(spark: SparkSession, predictions_csv: str, labels: str, output: str, kinds: list[str], code: str = "code", prob: str = "occurs_probs") -> DataFrame:
    """Composite AUROCs of a predictions CSV, written as CSV under a name with the time."""
    found = composite_auroc(logs.read_predictions_csv(spark, predictions_csv, code, prob), spark.read.parquet(labels), kinds)
    files.write_csv(found.coalesce(1), files.stamped(output))
    return found


__all__ = ["composite_auroc", "composite_probabilities", "composites", "per_code_auroc", "per_code_tasks", "read_per_code", "run_per_code", "run_per_code_auroc", "slug", "write_per_code"]
