"""Token sequences: encoding, history up to a prediction time, tails, query tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAD = 0


def encode(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Events with vocab_index; codes the vocabulary lacks get padding."""
    return events.join(vocabulary, "code", "left").withColumn("vocab_index", F.coalesce("vocab_index", F.lit(PAD)))


def unknown_codes(tasks: DataFrame, vocabulary: DataFrame, column: str = "query") -> DataFrame:
    """Distinct codes of tasks that the vocabulary lacks."""
    return tasks.select(F.col(column).alias("code")).distinct().join(vocabulary.select("code"), "code", "left_anti")


def subject_tokens(encoded: DataFrame) -> DataFrame:
    """(subject_id, tokens): a subject's tokens in time order, static ones first."""
    value = F.col("numeric_value").cast("double") if "numeric_value" in encoded.columns else F.lit(None).cast("double")
    token = F.struct("time", F.col("vocab_index").alias("code"), value.alias("numeric_value"))
    return encoded.groupBy("subject_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def history(tasks: DataFrame, tokens: DataFrame, longest: int | None = None) -> DataFrame:
    """Task rows with their tokens up to their prediction time, the last `longest` of them; subjects without tokens drop out.

    Tokens are in time order, static ones first, so a history is a leading part of them: its end is counted
    by the times alone, and what is kept is one slice.
    """
    times = F.transform("tokens", lambda t: t["time"])
    joined = tasks.join(tokens.withColumn("_times", times), "subject_id")
    end = F.size(F.filter("_times", lambda t: t.isNull() | (t <= F.col("prediction_time"))))
    size = end if longest is None else F.least(end, F.lit(longest))
    return joined.withColumn("_end", end).withColumn("tokens", F.slice("tokens", F.greatest(F.col("_end") - size + 1, F.lit(1)), size)).drop("_times", "_end")


def surviving(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among `kept`, numbered as they stood: (row, ...), so that results can be put side by side again."""
    numbered = rows.withColumn("row", F.row_number().over(Window.orderBy(*keys)) - 1) if "row" not in rows.columns else rows
    return numbered.join(kept.select(*keys).distinct(), keys, "left_semi")


def tail(column: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(column, F.greatest(F.size(column) - F.lit(n) + 1, F.lit(1)), F.lit(n))


def with_query(df: DataFrame, vocabulary: DataFrame, longest: int) -> DataFrame:
    """(codes, numeric_values, time_deltas): the query's token in front of the last tokens, `longest` in all.

    Deltas are days since the token before; the query token and the first have 0, static ones too.
    """
    named = vocabulary.select(F.col("code").alias("query"), F.col("vocab_index").alias("query_index"))
    df = df.join(named, "query", "left").withColumn("query_index", F.coalesce("query_index", F.lit(PAD)))
    df = df.withColumn("tokens", tail(F.col("tokens"), longest - 1))
    micros = lambda t: F.unix_micros(t["time"].cast("timestamp"))
    before = F.concat(F.slice("tokens", 1, 1), F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))))
    delta = F.zip_with("tokens", before, lambda t, b: F.coalesce((micros(t) - micros(b)) / F.lit(86_400_000_000.0), F.lit(0.0)))
    return df.withColumns({
        "codes": F.array_prepend(F.transform("tokens", lambda t: t["code"]), F.col("query_index")),
        "numeric_values": F.array_prepend(F.transform("tokens", lambda t: F.coalesce(t["numeric_value"], F.lit(float("nan")))), F.lit(float("nan"))),
        "time_deltas": F.array_prepend(delta, F.lit(0.0)),
    }).drop("tokens")


def by_event(tokens: Column) -> Column:
    """Tokens nested by event: one array for each distinct time, in order."""
    times = F.array_distinct(F.transform(tokens, lambda t: t["time"]))
    return F.transform(times, lambda at: F.filter(tokens, lambda t: t["time"].eqNullSafe(at)))


MODES = ("SM", "SEM")  # a token for each measurement, or tokens nested by event


def query_record(mode: str = "SM") -> Column:
    """The column query_index as a record in the shape of a history: a token whose value and delta are NaN; in mode SEM an event that holds it."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    code = F.array("query_index")
    nothing = F.array(F.lit(float("nan")))
    return F.struct((F.array(code) if mode == "SEM" else code).alias("code"), nothing.alias("numeric_value"), nothing.alias("time_delta_days"))
