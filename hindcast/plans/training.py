"""Training tasks: prediction-time index, drawn queries and contexts, resolved index, labels by shard.

Outputs, under the output directory and its `_artifacts` sibling: the prediction-time map and the
counts with a sidecar that is written last (its presence means a complete run for that minimum), the
resolved index, and labels by shard with a fingerprint of the index they were made from. A rerun
reuses the map for the same minimum, and relabels only the shards whose index has changed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeds import derive_seed
from ..operators import events as ev
from ..operators.label import fingerprint, label_index, summary
from ..operators.sampling import QueryDistribution, queries_frame, resolve_index, sample_contexts, sample_contexts_by_row
from ..schemas import DEATH, TASK_QUERY, align
from ..sources import files, logs


@dataclass(frozen=True)
class TrainingConfig:
    data_dir: str
    output_dir: str
    codes: list[str] | str
    split: str = "train"
    n_queries: int = 1000
    contexts_per_query: int = 1
    least_times: int = 50
    shortest: float = 1.0
    longest: float = 365.0
    law: str = "log-uniform"
    seed: int = 1
    overwrite: bool = False
    terminal: str = DEATH
    by_row: bool = False

    def __post_init__(self):
        for name in ("data_dir", "output_dir"):
            if not getattr(self, name):
                raise ValueError(f"{name} must be set")
        for name in ("n_queries", "contexts_per_query", "least_times"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def artifacts(self) -> str:
        return f"{files.artifacts_root(self.output_dir)}/{self.split}"


def cache_valid(spark: SparkSession, cfg: TrainingConfig) -> bool:
    """Whether a complete prediction-time map for this minimum is there."""
    meta = files.read_json(spark, f"{cfg.artifacts}/prediction_times.json")
    tables = (f"{cfg.artifacts}/prediction_times", f"{cfg.artifacts}/counts")
    return bool(meta) and meta.get("least_times") == cfg.least_times and meta.get("terminal") == cfg.terminal and all(files.exists(spark, t) for t in tables)


def build_prediction_times(spark: SparkSession, cfg: TrainingConfig) -> tuple[DataFrame, DataFrame]:
    """The map and the counts of eligible subjects, from the cache if it is valid."""
    at = cfg.artifacts
    if cfg.overwrite or not cache_valid(spark, cfg):
        files.delete(spark, f"{at}/prediction_times.json")
        log = logs.read_log(spark, cfg.data_dir, cfg.split)
        spanning = ev.spanning_subjects(log).limit(5).collect()
        if spanning:
            raise ValueError(f"subjects in several shards: {[(r.subject_id, r.shards) for r in spanning]}")
        seen = ev.truncate_at_terminal(log.select("subject_id", "shard", F.col("time").cast("timestamp_ntz").alias("time"), "code").where("time is not null"), cfg.terminal)
        times = ev.prediction_times(seen, ("shard",))
        counts = ev.time_counts(times, cfg.least_times)
        files.write_parquet(counts, f"{at}/counts")
        counts = spark.read.parquet(f"{at}/counts")
        files.write_by_shard(ev.eligible_times(times, counts), f"{at}/prediction_times")
        files.write_json(spark, f"{at}/prediction_times.json", {"least_times": cfg.least_times, "terminal": cfg.terminal, "n_subjects": counts.count()})
    times = spark.read.parquet(f"{at}/prediction_times")
    return times.withColumn("shard", F.col("shard").cast("string")), spark.read.parquet(f"{at}/counts")


def draw_index(spark: SparkSession, cfg: TrainingConfig, times: DataFrame, counts: DataFrame) -> DataFrame:
    """The resolved index; queries and contexts come from seeds of their own."""
    law = QueryDistribution(tuple(logs.read_codes(spark, cfg.codes)), cfg.shortest, cfg.longest, cfg.law)
    n = cfg.n_queries * cfg.contexts_per_query
    seeds = derive_seed(cfg.seed, "queries"), derive_seed(cfg.seed, "contexts")
    if cfg.by_row:
        queries = law.sample_rows(spark, cfg.n_queries, seeds[0]).withColumnRenamed("row_id", "query_id")
        contexts = sample_contexts_by_row(counts, n, cfg.least_times, seeds[1])
    else:
        queries = queries_frame(spark, law.sample(cfg.n_queries, np.random.default_rng(seeds[0])))
        contexts = sample_contexts(counts, n, cfg.least_times, np.random.default_rng(seeds[1]))
    return resolve_index(queries, contexts, times, cfg.contexts_per_query)


def label_shards(spark: SparkSession, cfg: TrainingConfig) -> dict[str, str]:
    """Label the shards whose index has changed since they were labelled, drop those that the index lacks; returns each shard's status.

    The shards to do are labelled in one job, into a temporary directory, and published one by one, each with
    its fingerprint after it, so that a broken run goes on where it stopped.
    """
    at, out = cfg.artifacts, f"{cfg.output_dir}/{cfg.split}"
    files.clean_temps(spark, out)
    index = spark.read.parquet(f"{at}/index").withColumn("shard", F.col("shard").cast("string"))
    # one row for each shard file
    wanted = {r.shard: r.fingerprint for r in fingerprint(index, ["shard"]).collect()}
    done = {} if cfg.overwrite else files.read_json(spark, f"{at}/labeled.json") or {}
    status = {s: "kept" for s in wanted if done.get(s) == wanted[s] and files.exists(spark, f"{out}/shard={s}")}
    for name, _ in files.entries(spark, out):
        if name.startswith("shard=") and name[6:] not in wanted:
            files.delete(spark, f"{out}/{name}")
    done = {s: done[s] for s in status}
    todo = sorted(set(wanted) - set(status))
    if todo:
        some = index.where(F.col("shard").isin(todo))
        log = ev.normalise(logs.read_log(spark, cfg.data_dir, cfg.split).where(F.col("shard").isin(todo)))
        labels = align(label_index(some.drop("shard"), log, cfg.terminal), TASK_QUERY).join(some.select("subject_id", "shard").distinct(), "subject_id")
        temp = f"{out}.{uuid.uuid4().hex}{files.TEMP}"
        try:
            labels.repartition("shard").write.partitionBy("shard").parquet(temp)
            made = {r.shard: r.n for r in spark.read.parquet(temp).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
            if wrong := {s: (made.get(s, 0), wanted[s]) for s in todo if str(made.get(s, 0)) != wanted[s].partition(":")[0]}:
                raise ValueError(f"labels and index rows differ in number by shard: {wrong}")
            for s in todo:
                files.rename(spark, f"{temp}/shard={s}", f"{out}/shard={s}")
                done[s], status[s] = wanted[s], "labeled"
                files.write_json(spark, f"{at}/labeled.json", done)
        finally:
            files.delete(spark, temp)
    files.write_json(spark, f"{at}/labeled.json", done)
    return status


def run(spark: SparkSession, cfg: TrainingConfig) -> dict:
    """All stages; returns the coverage summary."""
    times, counts = build_prediction_times(spark, cfg)
    files.write_by_shard(draw_index(spark, cfg, times, counts), f"{cfg.artifacts}/index")
    budget = cfg.n_queries * cfg.contexts_per_query
    if (n := spark.read.parquet(f"{cfg.artifacts}/index").count()) != budget:
        raise ValueError(f"{n} index rows, but {budget} were drawn")
    label_shards(spark, cfg)
    return summary(spark.read.parquet(f"{cfg.output_dir}/{cfg.split}")).first().asDict()
