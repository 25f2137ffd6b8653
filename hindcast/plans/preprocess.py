"""Preprocessing end to end: reshard, timeline tokens, filters, bins, vocabulary; stages with markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preprocess as pp
from ..operators.sequences import encode
from ..sources import files


@dataclass(frozen=True)
class PreprocessConfig:
    least_subjects: int = 1000
    least_times: int = 10
    per_shard: int = 10_000
    quantile_accuracy: int | None = None


def stages(events: DataFrame, cfg: PreprocessConfig) -> tuple[DataFrame, DataFrame]:
    """Cleaned, binned events and the vocabulary. Timeline tokens are protected by their code."""
    columns = ["subject_id", "time", "code", "numeric_value"]
    full = events.select(*columns).unionByName(pp.timeline_tokens(events).select(*columns))
    kept = pp.filter_short_subjects(pp.filter_rare_codes(full, pp.count_codes(full), cfg.least_subjects), cfg.least_times)
    binned = pp.bin_values(kept, pp.fit_quantiles(kept, accuracy=cfg.quantile_accuracy))
    return binned, pp.vocabulary(binned)


PHASES = ("data", "normalization", "tokens")


def write_data(spark: SparkSession, events: DataFrame, splits: DataFrame, output: str, cfg: PreprocessConfig) -> None:
    binned, _ = stages(events, cfg)
    files.write_parquet_partitioned(pp.reshard(binned, splits, cfg.per_shard), f"{output}/events", ["split", "shard"])
    written = spark.read.parquet(f"{output}/events")
    files.write_parquet(pp.vocabulary(written.select("subject_id", "code")), f"{output}/metadata/codes.parquet")


def write_normalised(spark: SparkSession, output: str) -> None:
    """Codes as indices and values in standard deviations, by split and shard; the sums come from the train split alone."""
    events = spark.read.parquet(f"{output}/events")
    if "numeric_value" not in events.columns:  # binned values are part of their codes
        events = events.withColumn("numeric_value", F.lit(None).cast("double"))
    files.write_parquet(pp.fit_normalisation(events.where("split = 'train'")), f"{output}/fit_normalization/codes.parquet")
    sums = spark.read.parquet(f"{output}/fit_normalization/codes.parquet")
    shards = events.select("subject_id", "split", "shard").distinct()
    made = pp.normalise_values(events, spark.read.parquet(f"{output}/metadata/codes.parquet"), sums).join(shards, "subject_id")
    files.write_parquet_partitioned(made, f"{output}/normalization", ["split", "shard"])


def write_tokens(spark: SparkSession, output: str) -> None:
    """Flat tokens, nested event sequences and subject schemas, each by split and shard."""
    vocabulary = spark.read.parquet(f"{output}/metadata/codes.parquet").selectExpr("code", "`code/vocab_index` as vocab_index")
    files.write_parquet_partitioned(encode(spark.read.parquet(f"{output}/events"), vocabulary), f"{output}/tokens", ["split", "shard"])
    normalised = spark.read.parquet(f"{output}/normalization")
    shards = normalised.select("subject_id", "split", "shard").distinct()
    for name, made in (("event_seqs", pp.event_sequences(normalised)), ("schemas", pp.subject_schemas(normalised))):
        files.write_parquet_partitioned(made.join(shards, "subject_id"), f"{output}/tokenization/{name}", ["split", "shard"])


def run(spark: SparkSession, events: DataFrame, splits: DataFrame, output: str, cfg: PreprocessConfig = PreprocessConfig(), overwrite: bool = False) -> str:
    """Write data by split and shard, the vocabulary, normalised values and tokens; finished phases are skipped, a failing one is named."""
    markers = {phase: f"{output}/{phase}.done" for phase in PHASES}
    work = {"data": lambda: write_data(spark, events, splits, output, cfg), "normalization": lambda: write_normalised(spark, output), "tokens": lambda: write_tokens(spark, output)}
    stale = overwrite
    for phase in PHASES:
        stale = stale or not files.exists(spark, markers[phase])
        if not stale:
            continue
        files.delete(spark, markers[phase])  # what follows a phase that is done anew is done anew
        try:
            work[phase]()
        except Exception as e:
            raise RuntimeError(f"preprocessing failed in phase {phase}") from e
        files.write_text(spark, markers[phase], "")
    return output
