"""Evaluation tasks: sampled times, dense grid, labels without censored rows, unique times; and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeds import derive_seed
from ..operators import events as ev
from ..operators.label import label_index, uncensored
from ..operators.metrics import compute_metrics
from ..schemas import DEATH, PREDICTION, TASK_QUERY, align
from ..sources import files, logs


def whole_days(durations: list[float]) -> list[int]:
    """Durations of evaluation grids are whole positive days."""
    if bad := [d for d in durations if isinstance(d, bool) or d != int(d) or d <= 0]:
        raise ValueError(f"durations must be whole positive days, got {bad}")
    return [int(d) for d in durations]


def shard_seeds(seed: int, what: str, split: str, shards: list[str]) -> Column:
    """The seed of a row's shard: a constant map, one entry for each shard file."""
    pairs = [F.lit(x) for shard in shards for x in (shard, derive_seed(seed, what, split, shard))]
    return F.element_at(F.create_map(*pairs), F.col("shard"))


def evaluation_tasks(log: DataFrame, codes: list[str], durations: list[float], k: int, least: int, seed: int = 0, fraction: float | None = None, terminal: str = DEATH, split: str | None = None, shards: list[str] | None = None) -> DataFrame:
    """Uncensored labels of a dense grid over up to k sampled times of each subject.

    With `shards` (and rows that carry their shard) every shard draws from seeds of its own, so that a shard
    gives the same rows whichever others are worked on.
    """
    if shards is None:
        log = ev.subsample_subjects(ev.normalise(log), fraction, derive_seed(seed, "subject_subsample"))
        times = ev.sample_times(log, k, least, derive_seed(seed, "prediction_times"))
    else:
        of = log.select("subject_id", "shard").distinct().withColumn("seed", shard_seeds(seed, "prediction_times", split, shards))
        log = ev.normalise(ev.subsample_subjects(log, fraction, shard_seeds(seed, "subject_subsample", split, shards)))
        times = ev.sample_times(log, k, least, F.col("seed"), of.select("subject_id", "seed"))
    return align(uncensored(label_index(ev.dense_grid(times, codes, durations), log, terminal)), TASK_QUERY)


def unique_times(tasks: DataFrame) -> DataFrame:
    return tasks.select("subject_id", "prediction_time").distinct()


def run_tasks(spark: SparkSession, data_dir: str, output_dir: str, split: str, codes: list[str] | str, durations: list[float], k: int, least: int, seed: int = 0, fraction: float | None = None, overwrite: bool = False) -> str | None:
    """Write tasks and unique times of a split by shard; shards whose outputs exist are skipped, None if all do.

    The shards that are left are worked on in one job and published one by one.
    """
    out, times = f"{output_dir}/{split}", f"{output_dir}/unique_prediction_times/{split}"
    for path in (out, times):
        files.clean_temps(spark, path)
    shards = logs.shard_names(spark, data_dir, split)
    done = {p: {n for n, _ in files.entries(spark, p)} for p in (out, times)}
    todo = shards if overwrite else [s for s in shards if any(f"shard={s}" not in done[p] for p in (out, times))]
    if not todo:
        return None
    log = logs.read_log(spark, data_dir, split).where(F.col("shard").isin(todo))
    spanning = ev.spanning_subjects(log).limit(5).collect()
    if spanning:
        raise ValueError(f"subjects in several shards: {[(r.subject_id, r.shards) for r in spanning]}")
    tasks = evaluation_tasks(log, logs.read_codes(spark, codes), whole_days(durations), k, least, seed, fraction, split=split, shards=todo)
    temp = f"{output_dir}/{split}.{uuid.uuid4().hex}{files.TEMP}"
    try:
        tasks.join(log.select("subject_id", "shard").distinct(), "subject_id").repartition("shard").write.partitionBy("shard").parquet(temp)
        empty = TASK_QUERY.empty(spark)
        made = {n for n, _ in files.entries(spark, temp)}
        for shard in todo:
            if f"shard={shard}" not in made:
                empty.write.parquet(f"{temp}/shard={shard}")
            rows = spark.read.schema(empty.schema).parquet(f"{temp}/shard={shard}")
            files.write_parquet(unique_times(rows).orderBy("subject_id", "prediction_time"), f"{times}/shard={shard}")
            files.rename(spark, f"{temp}/shard={shard}", f"{out}/shard={shard}")
    finally:
        files.delete(spark, temp)
    return out


def evaluate(spark: SparkSession, predictions: str, output: str) -> DataFrame:
    """Metrics of a prediction table, written as one small table."""
    found = compute_metrics(align(spark.read.parquet(predictions), PREDICTION))
    # one row for each (query, duration)
    files.write_parquet(found.orderBy("query", "duration_days").coalesce(1), output)
    return spark.read.parquet(output)


def label_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("query", "duration_days").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("boolean_value").alias("n_true"))
