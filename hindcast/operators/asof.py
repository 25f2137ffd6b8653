"""As-of lookups by union and a running window, one sort per group, spillable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_event(index: DataFrame, events: DataFrame, by: list[str], at: str = "prediction_time", time: str = "time", out: str = "next_time") -> DataFrame:
    """Each index row with the earliest event time strictly after `at` within its group, else null.

    Rows of both sides are scanned backwards in time; at equal times index rows come before events, so
    an event at the prediction time itself is not seen.
    """
    return _running(index, events, by, at, time, out, later=True, strict=True)


def previous_event(index: DataFrame, events: DataFrame, by: list[str], at: str = "prediction_time", time: str = "time", out: str = "previous_time", strict: bool = False) -> DataFrame:
    """Each index row with the latest event time up to `at` (before it, if strict)."""
    return _running(index, events, by, at, time, out, later=False, strict=strict)


def _running(index: DataFrame, events: DataFrame, by: list[str], at: str, time: str, out: str, later: bool, strict: bool) -> DataFrame:
    columns = index.columns
    left = index.withColumns({"_at": F.col(at), "_event": F.lit(None).cast("timestamp_ntz"), "_is_index": F.lit(True)})
    right = events.select(*by, F.col(time).alias("_at"), F.col(time).alias("_event")).where(F.col("_at").isNotNull()).withColumn("_is_index", F.lit(False))
    both = left.unionByName(right, allowMissingColumns=True)
    first = F.desc("_is_index") if strict else F.asc("_is_index")
    window = Window.partitionBy(*by).orderBy(F.desc("_at") if later else F.asc("_at"), first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn(out, F.last("_event", ignorenulls=True).over(window))
    return seen.where("_is_index").select(*columns, out)
