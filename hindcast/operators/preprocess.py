"""Preprocessing stages: resharding, timeline tokens, code counts, filters, quantile bins, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIMELINE_CODE = "TIMELINE//DELTA//years"
YEAR_MICROS = 365.25 * 86_400_000_000
# Codes that are never filtered.
PROTECTED = "^(MEDS_DEATH.*|MEDS_BIRTH.*|.*ADMISSION.*|.*DISCHARGE.*|.*REGISTRATION.*|.*TIME.*)$"
QUANTILES = tuple(q / 10 for q in range(1, 10))
# Edges of time deltas in years.
TIMELINE_BINS = {
    "1_minute": 0.00000190258, "5_minutes": 0.00000951293, "10_minutes": 0.00001902587, "30_minutes": 0.00005707762, "1_hour": 0.00011415525,
    "3_hours": 0.00034246575, "6_hours": 0.0006849315, "12_hours": 0.00136986301, "1_day": 0.00273972602, "2_days": 0.00547945205, "4_days": 0.0109589041,
    "7_days": 0.01917808219, "14_days": 0.03835616438, "30_days": 0.08219178082, "60_days": 0.16438356164, "120_days": 0.32876712328,
    "1_year": 1.0, "2_years": 2.0, "5_years": 5.0, "10_years": 10.0, "20_years": 20.0, "40_years": 40.0,
}


def reshard(events: DataFrame, splits: DataFrame, per_shard: int = 10_000) -> DataFrame:
    """Events with (split, shard): subjects of a split, in order of id, go to shards of `per_shard` each.

    Subjects are numbered by range partitions and their totals, so no split is sorted in one task.
    """
    subjects = events.select("subject_id").distinct().join(splits.select("subject_id", "split"), "subject_id")
    ranged = subjects.repartitionByRange("split", "subject_id").withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("split", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("split", "_part").orderBy("subject_id")) - 1
    placed = ranged.withColumn("_i", inside).join(offsets, ["split", "_part"])
    shard = F.floor((F.col("_before") + F.col("_i")) / per_shard).cast("string")
    return events.join(placed.select("subject_id", "split", shard.alias("shard")), "subject_id")


def timeline_tokens(events: DataFrame) -> DataFrame:
    """A token for each time of a subject but the first: years since the time before."""
    times = events.where(F.col("time").isNotNull()).select("subject_id", "time").distinct()
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    delta = (micros - F.lag(micros).over(Window.partitionBy("subject_id").orderBy("time"))) / F.lit(YEAR_MICROS)
    return times.withColumn("numeric_value", delta).where(F.col("numeric_value").isNotNull()).select("subject_id", "time", F.lit(TIMELINE_CODE).alias("code"), "numeric_value")


def count_codes(events: DataFrame) -> DataFrame:
    return events.groupBy("code").agg(F.count(F.lit(1)).alias("code/n_occurrences"), F.count_distinct("subject_id").alias("code/n_subjects"))


def filter_rare_codes(events: DataFrame, counts: DataFrame, least: int = 1000, protected: str = PROTECTED) -> DataFrame:
    """Static rows and protected codes stay; other codes need `least` subjects."""
    common = counts.where(F.col("`code/n_subjects`") >= least).select(F.col("code").alias("_common"))
    joined = events.join(common, F.col("code") == F.col("_common"), "left")
    return joined.where(F.col("time").isNull() | F.col("code").rlike(protected) | F.col("_common").isNotNull()).drop("_common")


def filter_short_subjects(events: DataFrame, least: int = 10) -> DataFrame:
    """Subjects need `least` distinct times."""
    enough = events.groupBy("subject_id").agg(F.count_distinct("time").alias("_n")).where(F.col("_n") >= least).select("subject_id")
    return events.join(enough, "subject_id", "left_semi")


def fit_quantiles(events: DataFrame, quantiles: tuple[float, ...] = QUANTILES, accuracy: int | None = None) -> DataFrame:
    """(code, quantiles) of numeric values: exact, or approximate to 1 / accuracy for very large codes."""
    at = F.array(*map(F.lit, quantiles))
    made = F.percentile("numeric_value", at) if accuracy is None else F.percentile_approx("numeric_value", list(quantiles), accuracy)
    return events.where(F.col("numeric_value").isNotNull()).groupBy("code").agg(made.alias("quantiles"))


def _bin(value: Column, edges: Column) -> Column:
    """Number of edges below the value."""
    return F.size(F.filter(edges, lambda e: e < value))


def bin_values(events: DataFrame, quantiles: DataFrame, custom: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Codes extended by the bin of their value, the value itself dropped; codes with named bins use those."""
    custom = {TIMELINE_CODE: TIMELINE_BINS} if custom is None else custom
    joined = events.join(quantiles, "code", "left")
    v = F.col("numeric_value")
    binned = F.when(v.isNull() | F.isnan(v), F.col("code"))
    for code, bins in custom.items():
        edges = sorted(bins.items(), key=lambda x: x[1])
        names = F.array(*(F.lit(n) for n, _ in edges), F.lit(f"over_{edges[-1][0]}"))
        at = _bin(v, F.array(*(F.lit(float(e)) for _, e in edges)))
        binned = binned.when(F.col("code") == code, F.concat(F.lit(f"{code}//"), F.element_at(names, at + 1)))
    distinct = F.array_distinct("quantiles")
    binned = binned.when(F.col("quantiles").isNull(), F.col("code")).otherwise(F.concat(F.col("code"), F.lit("//Q"), (_bin(v, distinct) + 1).cast("string")))
    return joined.withColumn("code", binned).drop("quantiles", "numeric_value")


def vocabulary(events: DataFrame) -> DataFrame:
    """(code, code/n_occurrences, code/n_subjects, code/vocab_index): indices 1..N in code order, 0 is padding."""
    # one row for each code: small beside the log, so one sorted partition is fine
    return count_codes(events).withColumn("code/vocab_index", F.row_number().over(Window.orderBy("code")).cast("bigint"))


def fit_normalisation(events: DataFrame) -> DataFrame:
    """(code, values/n_occurrences, values/sum, values/sum_sqd) of numeric values; NaN counts as none."""
    v = F.when(~F.isnan("numeric_value"), F.col("numeric_value").cast("double"))
    sums = F.count(v).alias("values/n_occurrences"), F.sum(v).alias("values/sum"), F.sum(v * v).alias("values/sum_sqd")
    return events.groupBy("code").agg(*sums)


def normalise_values(events: DataFrame, vocabulary: DataFrame, sums: DataFrame) -> DataFrame:
    """(subject_id, time, code as its index, numeric_value in standard deviations from its code's mean).

    A code whose values don't vary has zeros, a code without values nulls; codes that the vocabulary lacks drop out.
    """
    n = F.col("values/n_occurrences")
    mean = F.col("values/sum") / n
    spread = F.sqrt(F.greatest(F.col("values/sum_sqd") / n - mean * mean, F.lit(0.0)))
    # one row for each code, whose size the optimizer checks before it broadcasts
    fitted = vocabulary.select("code", F.col("`code/vocab_index`").alias("_index")).join(sums.select("code", mean.alias("_mean"), spread.alias("_spread")), "code", "left")
    value = F.when(~F.isnan("numeric_value"), F.col("numeric_value").cast("double"))
    scaled = F.when(F.col("_spread") > 0, (value - F.col("_mean")) / F.col("_spread")).when(value.isNotNull(), F.lit(0.0))
    return events.join(fitted, "code").select("subject_id", "time", F.col("_index").alias("code"), scaled.alias("numeric_value"))


def event_sequences(normalised: DataFrame) -> DataFrame:
    """(subject_id, code, numeric_value, time_delta_days): codes and values nested by time, in order; the first delta is null.

    Codes of one time are ordered by index and value. Static rows are no events.
    """
    event = F.sort_array(F.collect_list(F.struct("code", F.col("numeric_value").alias("value"))))
    events = normalised.where(F.col("time").isNotNull()).groupBy("subject_id", "time").agg(event.alias("tokens"))
    delta = (F.unix_micros(F.col("time").cast("timestamp")) - F.lag(F.unix_micros(F.col("time").cast("timestamp"))).over(Window.partitionBy("subject_id").orderBy("time"))) / F.lit(86_400_000_000.0)
    ordered = events.withColumn("delta", delta).groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("time", "delta", "tokens"))).alias("e"))
    nested = lambda c: F.transform("e", lambda x: F.transform(x["tokens"], lambda t: t[c]))
    return ordered.select("subject_id", nested("code").alias("code"), nested("value").alias("numeric_value"), F.transform("e", lambda x: x["delta"]).alias("time_delta_days"))


def subject_schemas(normalised: DataFrame) -> DataFrame:
    """(subject_id, code, numeric_value, start_time, time): static codes with their values, the first time, and all times in order."""
    static = F.sort_array(F.collect_list(F.when(F.col("time").isNull(), F.struct("code", F.col("numeric_value").alias("value")))))
    found = normalised.groupBy("subject_id").agg(static.alias("s"), F.min("time").alias("start_time"), F.sort_array(F.collect_set("time")).alias("time"))
    return found.select("subject_id", F.transform("s", lambda x: x["code"]).alias("code"), F.transform("s", lambda x: x["value"]).alias("numeric_value"), "start_time", "time")
