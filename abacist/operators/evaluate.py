"""Detection and value metrics, summaries, and A/B gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Whether more is better, by metric.
DIRECTION = {"precision": 1, "recall": 1, "f1": 1, "avg_iou": 1, "relaxed_accuracy": 1, "mae": -1, "relative_error": -1}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def detection_metrics(counts: DataFrame) -> DataFrame:
    """``tp, n_gt, n_det, sum_iou`` to precision, recall, f1 and mean IoU; a zero divisor gives 0."""
    p, r = ratio(F.col("tp"), F.col("n_det")), ratio(F.col("tp"), F.col("n_gt"))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "avg_iou": ratio(F.col("sum_iou"), F.col("tp"))})


def value_metrics(pairs: DataFrame, key: list[str], truth: str, predicted: str) -> DataFrame:
    error = F.abs(F.col(predicted) - F.col(truth))
    relative = error / (F.abs(F.col(truth)) + 1e-10)
    return pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.avg(relative).alias("relative_error"),
        F.avg((relative <= 0.05).cast("double")).alias("relaxed_accuracy"),
    )


def summary(per_chart: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """Macro means of the finite metrics by type and over all (null type), with the share of hard failures (f1 of 0)."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    failed = F.avg((F.coalesce("f1", F.lit(0.0)) <= 0).cast("double"))
    return per_chart.groupingSets([[], [kind]], kind).agg(
        F.count(F.lit(1)).alias("charts"), *[F.avg(finite(m)).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_samp(finite(m)).alias(f"std_{m}") for m in metrics], failed.alias("hard_failure_rate"),
    )


def weak_types(summaries: DataFrame, kind: str, least: float = 0.8) -> DataFrame:
    return summaries.where(F.col(kind).isNotNull() & (F.col("mean_f1") < least)).orderBy("mean_f1", kind)


def handler_report(per_chart: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """Count, and mean and sample deviation of the finite metrics by type, the worst mean f1 first."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    found = per_chart.groupBy(kind).agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(finite(m)).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(finite(m)).alias(f"{m}_std") for m in metrics]
    )
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("f1_mean"), kind))).orderBy("place")  # a row per type


def best_threshold(counts: DataFrame) -> DataFrame:
    """F1 by threshold from ``threshold, tp, n_det, n_gt`` of charts, the first best marked."""
    summed = counts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "n_det", "n_gt")])
    p, r = ratio(F.col("tp"), F.col("n_det")), ratio(F.col("tp"), F.col("n_gt"))
    scored = summed.withColumn("f1", ratio(2 * p * r, p + r))
    order = Window.orderBy(F.desc(F.round("f1", 9)), "threshold")  # a row per threshold
    return scored.withColumn("best", F.row_number().over(order) == 1)


def deltas(summaries: DataFrame, arm: str, base: str, new: str, metrics: list[str]) -> DataFrame:
    """A row per metric: both arms' values, the difference and whether it is an improvement."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = summaries.select(arm, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(arm) == base, F.col("value"))).alias("base"), F.max(F.when(F.col(arm) == new, F.col("value"))).alias("new"))
    sign = reduce(lambda out, m: F.when(F.col("metric") == m, DIRECTION.get(m, 1)).otherwise(out), metrics, F.lit(1))
    gain = (F.col("new") - F.col("base")) * sign
    return wide.withColumn("delta", F.col("new") - F.col("base")).withColumn("improved", gain > 0)


def gates(changes: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Per limited metric whether its gain (by direction) is at least the limit; a missing value passes."""
    limited = changes.where(F.col("metric").isin(*limits))
    least = reduce(lambda out, m: F.when(F.col("metric") == m, limits[m]).otherwise(out), limits, F.lit(0.0))
    sign = reduce(lambda out, m: F.when(F.col("metric") == m, DIRECTION.get(m, 1)).otherwise(out), limits, F.lit(1))
    return limited.withColumn("passed", F.coalesce(F.col("delta") * sign >= least, F.lit(True)))


def threshold_sweep(scored: DataFrame, score: str, correct: str, n_truth: Column, thresholds: list[float]) -> DataFrame:
    """F1 at each confidence threshold; the first best is marked. Scores are counted per step before anything is summed up."""
    step = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(score)))
    counted = scored.groupBy(step.alias("reached")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("tp"))
    at = F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))).alias("step")
    expanded = counted.select("*", at).where(F.col("step") <= F.col("reached")).groupBy("step").agg(F.sum("n").alias("n_det"), F.sum("tp").alias("tp"))
    named = expanded.withColumn("threshold", F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("step")))
    p, r = ratio(F.col("tp"), F.col("n_det")), ratio(F.col("tp"), n_truth)
    return named.select("threshold", "n_det", "tp", ratio(2 * p * r, p + r).alias("f1"))
