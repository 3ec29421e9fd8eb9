"""Evaluation of step judges: predictions with p_positive against labels -1, 0 (neutral) and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import rewards as M


def class_indices(num_labels: int, reward_class_index: int | None) -> tuple[int, int]:
    """(negative, positive) places of a two-class model."""
    if num_labels != 2 or reward_class_index not in (0, 1):
        raise ValueError(f"two labels and a reward class are needed: {num_labels}, {reward_class_index}")
    return 1 - reward_class_index, reward_class_index


def predictions(examples: DataFrame, threshold: float = 0.0) -> DataFrame:
    """examples (p_positive, compatibility_label, ...) with p_negative, margin, prediction, neutral and correct (null for neutral ones)."""
    p, neutral = F.col("p_positive"), F.col("compatibility_label") == 0
    rows = examples.withColumns({"p_negative": 1.0 - p, "probability_margin": p - (1.0 - p), "predicted_label": M.margin_prediction(p, threshold), "is_neutral": neutral})
    return rows.withColumn("correct", F.when(~neutral, F.col("predicted_label") == F.col("compatibility_label")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts() -> list[Column]:
    """Aggregates over predictions()."""
    on = ~F.col("is_neutral")
    hit = lambda t, p: F.count_if(on & (F.col("compatibility_label") == t) & (F.col("predicted_label") == p))
    return [hit(1, 1).alias("tp"), hit(-1, 1).alias("fp"), hit(1, -1).alias("fn"), hit(-1, -1).alias("tn"), F.count("*").alias("total_steps"), F.count_if(on).alias("evaluated_steps")]


def with_metrics(counted: DataFrame) -> DataFrame:
    """counts() with accuracy, precision, recall, f1 of both classes, and macro_f1; a ratio over nothing is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = counted.withColumns({
        "neutral_steps": F.col("total_steps") - F.col("evaluated_steps"),
        "accuracy": _ratio(tp + tn, F.col("evaluated_steps")),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_positive": _ratio(2 * tp, 2 * tp + fp + fn),
        "f1_negative": _ratio(2 * tn, 2 * tn + fp + fn),
    })
    return rows.withColumn("macro_f1", (F.col("f1_positive") + F.col("f1_negative")) / 2.0)


def grouped_metrics(predicted: DataFrame, keys: list[str]) -> DataFrame:
    return with_metrics(predicted.groupBy(*keys).agg(*counts()))


def metrics_by_dimension(predicted: DataFrame, dimensions: list[str]) -> DataFrame:
    """grouped_metrics for each dimension alone and for all rows, in one pass: dimension, value and the metrics."""
    grouped = predicted.groupingSets([*[[F.col(d)] for d in dimensions], []], *dimensions).agg(F.grouping_id().alias("_g"), *counts())
    full = (1 << len(dimensions)) - 1
    name = F.lit("all")
    value = F.lit("")
    for i, d in enumerate(dimensions):
        here = F.col("_g") == full - (1 << (len(dimensions) - 1 - i))
        name, value = F.when(here, F.lit(d)).otherwise(name), F.when(here, F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN"))).otherwise(value)
    return with_metrics(grouped.withColumns({"dimension": name, "value": value}).drop("_g", *dimensions))


def auc(predicted: DataFrame, keys: list[str], ranges: int = 4096) -> DataFrame:
    """Area under the ROC curve by average ranks, null with one class only.

    Equal scores are counted first. Counts of ranges of scores are cumulated by group, and within a range its
    scores, so a task sorts the scores of one range; scores are probabilities, and those outside [0, 1] fall in the ranges at the ends.
    """
    rows = predicted.where(~F.col("is_neutral"))
    place = F.least(F.greatest(F.floor(F.col("p_positive") * ranges), F.lit(-1)), F.lit(ranges)).cast("int")
    scores = rows.groupBy(*keys, place.alias("_range"), "p_positive").agg(F.count_if(F.col("compatibility_label") == 1).alias("_p"), F.count_if(F.col("compatibility_label") != 1).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, place.alias("_range")).agg(F.count_if(F.col("compatibility_label") != 1).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy("p_positive").rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [*keys, "_range"])
    wins = F.sum(F.col("_p") * (F.col("_before") + F.col("_inside") + 0.5 * F.col("_n")))
    return scores.groupBy(*keys).agg(F.try_divide(wins, (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc"))


def overall(predicted: DataFrame, source: str = "data_source") -> DataFrame:
    """One row: pooled metrics, clipped log loss, and macro-F1 of sources weighted by their evaluated steps."""
    loss = F.when(~F.col("is_neutral"), M.log_loss(F.col("p_positive"), F.col("compatibility_label")))
    by_source = with_metrics(predicted.groupBy(source).agg(*counts(), F.sum(loss).alias("loss")))
    sums = by_source.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "total_steps", "evaluated_steps")], F.sum("loss").alias("loss"), F.sum(F.col("macro_f1") * F.col("evaluated_steps")).alias("weighted"))
    rows = sums.withColumns({"evaluation_loss": _ratio(F.col("loss"), F.col("evaluated_steps")), "weighted_macro_f1": _ratio(F.col("weighted"), F.col("evaluated_steps"))})
    return with_metrics(rows.drop("loss", "weighted"))
