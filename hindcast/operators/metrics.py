"""Ranking metrics by group, exact with ties, as windows and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS


def auroc_by(df: DataFrame, by: list[str], label: Column, score: Column, out: str) -> DataFrame:
    """Area under the ROC curve by group, ties counted half; null where one class is missing.

    Scores are counted by value first, so the window sees each distinct score once and a group that
    repeats a few scores many times stays small.
    """
    from pyspark.sql.window import Window

    counted = df.select(*by, label.cast("boolean").alias("_y"), score.cast("double").alias("_s")).where("_y is not null")
    counted = counted.groupBy(*by, "_s").agg(F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counted.withColumn("_w", F.col("_p").cast("double") * (below + F.col("_n") / 2.0))
    p, n = F.sum("_p"), F.sum("_n")
    return won.groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum("_w") / (p.cast("double") * n.cast("double"))).alias(out))


def both_curves(predictions: DataFrame, by: list[str]) -> DataFrame:
    """By group: rows, labelled rows, positive ones, and both AUROCs, from one count by score.

    Occurrence is judged on rows that aren't censored, censoring on all.
    """
    from pyspark.sql.window import Window

    needed = {*by, "boolean_value", "censor_prob", "occurs_prob"}
    if lacking := sorted(needed - set(predictions.columns)):
        raise ValueError(f"predictions lack columns {lacking}")
    curve = lambda name, label, score: F.struct(F.lit(name).alias("_k"), label.alias("_y"), F.col(score).cast("double").alias("_s"))
    label = F.col("boolean_value")
    long = predictions.select(*by, F.inline(F.array(curve("occurs", label, "occurs_prob"), curve("censor", label.isNull(), "censor_prob"))))
    counted = long.groupBy(*by, "_k", "_s").agg(F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counted.withColumn("_w", F.col("_p").cast("double") * (below + F.col("_n") / 2.0))
    total = lambda k, c: F.sum(F.when(F.col("_k") == k, F.col(c)))
    area = lambda k: F.when((total(k, "_p") > 0) & (total(k, "_n") > 0), total(k, "_w") / (total(k, "_p").cast("double") * total(k, "_n").cast("double")))
    return won.groupBy(*by).agg(
        (total("censor", "_p") + total("censor", "_n")).alias("n_rows"), (total("occurs", "_p") + total("occurs", "_n")).alias("n_occurs_labeled"),
        total("occurs", "_p").alias("n_positive"), area("occurs").alias("occurs_auroc"), area("censor").alias("censor_auroc"),
    )


def compute_metrics(predictions: DataFrame) -> DataFrame:
    """Counts, both AUROCs and prevalence for each (query, duration_days)."""
    prevalence = F.when(F.col("n_occurs_labeled") > 0, F.col("n_positive") / F.col("n_occurs_labeled"))
    return both_curves(predictions, ["query", "duration_days"]).withColumn("prevalence", prevalence).select(*METRICS.columns)


def epoch_metrics(predictions: DataFrame, split: str = "split") -> DataFrame:
    """(split, metric, value) of a whole split; a curve that lacks one class is left out."""
    found = both_curves(predictions, [split])
    return found.unpivot([split], ["occurs_auroc", "censor_auroc"], "metric", "value").where("value is not null")


def logit_loss(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    x = logit.cast("double")
    return F.greatest(x, F.lit(0.0)) - x * label.cast("double") + F.log1p(F.exp(-F.abs(x)))


def losses(scored: DataFrame, occurs_weight: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Mean losses of censor_logit and occurs_logit and their weighted sum; occurrence counts where boolean_value isn't censored, 0 where none is."""
    label = F.col("boolean_value")
    occurs = F.coalesce(F.avg(F.when(label.isNotNull(), logit_loss(F.col("occurs_logit"), label))), F.lit(0.0))
    censor = F.coalesce(F.avg(logit_loss(F.col("censor_logit"), label.isNull())), F.lit(0.0))
    means = scored.groupBy(*(by or [])).agg(occurs.alias("occurs_loss"), censor.alias("censor_loss"))
    return means.withColumn("loss", occurs_weight * F.col("occurs_loss") + (1 - occurs_weight) * F.col("censor_loss"))


KINDS = ("max", "or", "sum")


def composite_probabilities(predictions: DataFrame, kinds: list[str] = list(KINDS), prob: str = "occurs_prob") -> DataFrame:
    """One probability for each (subject_id, prediction_time) across its queries: max, noisy-or or sum."""
    wanted = {k.lower() for k in kinds}
    if unknown := sorted(wanted - set(KINDS)):
        raise ValueError(f"unknown kinds {unknown}; known are {sorted(KINDS)}")
    p = F.col(prob).cast("double")
    made = {"max": F.max(p), "or": 1.0 - F.product(1.0 - p), "sum": F.sum(p)}
    return predictions.groupBy("subject_id", "prediction_time").agg(*(made[k].alias(f"prob_{k}") for k in KINDS if k in wanted))


def composite_auroc(predictions: DataFrame, labels: DataFrame, kinds: list[str] = list(KINDS), prob: str = "occurs_prob", label: str = "boolean_value", digits: int | None = None) -> DataFrame:
    """(aggregate, auroc) of composite probabilities against labels; NaN where one class is missing.

    Sums of floats depend on their order in the last digit: `digits` rounds, so that ties are the same everywhere.
    """
    made = composite_probabilities(predictions, kinds, prob)
    if digits is not None:
        made = made.withColumns({c: F.round(c, digits) for c in made.columns if c.startswith("prob_")})
    joined = made.join(labels.select("subject_id", "prediction_time", F.col(label).alias("_label")), ["subject_id", "prediction_time"])
    names = [c for c in joined.columns if c.startswith("prob_")]
    long = joined.unpivot(["_label"], names, "aggregate", "p")
    found = auroc_by(long, ["aggregate"], F.col("_label"), F.col("p"), "auroc")
    return found.withColumn("auroc", F.coalesce("auroc", F.lit(float("nan"))))


def per_code_auroc(predictions: DataFrame, labels: DataFrame, code: str = "query", prob: str = "occurs_prob", label: str = "occurs") -> DataFrame:
    """(code, auroc) of each code's predictions against that code's labels, which come by slug."""
    from ..functions.columns import code_slug

    slugged = predictions.withColumn("slug", code_slug(F.col(code)))
    joined = slugged.join(labels.select("slug", "subject_id", "prediction_time", F.col(label).alias("_label")), ["slug", "subject_id", "prediction_time"], "left")
    return auroc_by(joined, [code], F.col("_label"), F.col(prob), "auroc")
