"""Outcome labels over a stream of events, for task rows that are known beforehand.

The stream gives true labels as soon as the event is seen. False and null need the subject's last
time, which a stream can't know before the record closes; `close` derives them from the batch rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import window_end


def first_hits(tasks: DataFrame, stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Task rows with an event of their code inside their window: a stream-static join.

    Repeats within the watermark are dropped; a later event of the same row may give it again, so `close` takes rows once.
    """
    keyed = stream.select("subject_id", F.col("code").alias("query"), F.col("time").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    joined = keyed.join(tasks, ["subject_id", "query"])
    at = F.col("event_time").cast("timestamp_ntz")
    hit = joined.where((at > F.col("prediction_time")) & (at <= window_end(F.col("prediction_time"), F.col("duration_days"))))
    return hit.dropDuplicatesWithinWatermark(["subject_id", "query", "prediction_time", "duration_days"]).select("subject_id", "prediction_time", "query", "duration_days", "event_time")


def event_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by code in tumbling windows, late ones up to the delay."""
    timed = stream.select("code", F.col("time").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window), "code").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "code", "n")


def close(tasks: DataFrame, hits: DataFrame, last: DataFrame) -> DataFrame:
    """Final labels once records are closed: true for hits, else null or false by the subject's last time."""
    keys = ["subject_id", "prediction_time", "query", "duration_days"]
    joined = tasks.join(hits.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left").join(last, "subject_id", "left")
    late = window_end(F.col("prediction_time"), F.col("duration_days")) > F.col("max_time")
    value = F.when(F.col("_hit"), F.lit(True)).when(late, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.select("subject_id", "prediction_time", value.alias("boolean_value"), "query", "duration_days")
