"""Three-valued outcome labels: true, false, null for censored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sample_key, window_end
from ..schemas import DEATH
from .asof import next_event
from .events import last_times, truncate_at_terminal


def label_index(index: DataFrame, events: DataFrame, terminal: str = DEATH) -> DataFrame:
    """Label each (subject_id, prediction_time, query, duration_days) row.

    True if the code occurs after the prediction time and up to the end of the window, both to the
    microsecond; else null if the window ends after the subject's last event; else false. Events after a
    terminal event don't count. A subject without events raises when its row is read.
    """
    seen = truncate_at_terminal(events.where(F.col("time").isNotNull()).select("subject_id", "time", "code"), terminal)
    found = next_event(index, seen.withColumnRenamed("code", "query"), ["subject_id", "query"])
    found = found.join(last_times(seen), "subject_id", "left")
    known = F.when(F.col("max_time").isNull(), F.raise_error(F.concat(F.lit("index row of a subject without events: "), F.col("subject_id").cast("string"))).cast("boolean"))
    end = window_end(F.col("prediction_time"), F.col("duration_days"))
    value = known.when(F.col("next_time").isNotNull() & (F.col("next_time") <= end), F.lit(True)).when(end > F.col("max_time"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return found.select("subject_id", "prediction_time", value.alias("boolean_value"), "query", "duration_days")


def split_label(df: DataFrame) -> DataFrame:
    """boolean_value as two flags: boolean_value (censored) and occurs; a frame with its own occurs passes through."""
    if "occurs" in df.columns:
        return df
    return df.withColumns({"occurs": F.coalesce("boolean_value", F.lit(False)), "boolean_value": F.col("boolean_value").isNull()})


def merge_label(censored: Column, occurs: Column) -> Column:
    """The inverse: null where censored, else the flag."""
    return F.when(censored, F.lit(None).cast("boolean")).otherwise(occurs)


def uncensored(df: DataFrame) -> DataFrame:
    return df.where(F.col("boolean_value").isNotNull())


def summary(df: DataFrame) -> DataFrame:
    """Rows, subjects, (query, duration) pairs and the three label counts, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_distinct("query", "duration_days").alias("n_tasks"),
        F.count_if(F.col("boolean_value").isNull()).alias("n_censored"),
        F.count_if(~F.col("boolean_value")).alias("n_false"),
        F.count_if(F.col("boolean_value")).alias("n_true"),
    )


def fingerprint(df: DataFrame, by: list[str] | None = None, portable: bool = False) -> DataFrame:
    """A digest of the multiset of rows: their count and the sum of row hashes mod 2^64, whatever order or file layout.

    The portable form takes the start of the MD5 of the values, joined by bars, which any engine can compute;
    timestamps count as microseconds there. With `by`, one digest for each group.
    """
    names = sorted(set(df.columns) - set(by or []))
    if portable:
        kinds = dict(df.dtypes)
        value = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(f"`{c}`")
        key = sample_key(*(F.coalesce(value(c).cast("string"), F.lit("null")) for c in names))
    else:
        key = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    total = F.pmod(F.coalesce(F.sum(key.cast("decimal(38,0)")), F.lit(0)), F.lit(str(1 << 64)).cast("decimal(38,0)"))
    return df.groupBy(*(by or [])).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), total.cast("decimal(20,0)").cast("string")).alias("fingerprint"))
