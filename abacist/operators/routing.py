"""Routing of charts between strategies, fallbacks and stage outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_class(scored: DataFrame, key: list[str], name: str, score: str, ignored: str = "chart", default: str = "bar") -> DataFrame:
    """The class with the highest score of each chart, other than ``ignored``; ``default`` without one."""
    usable = F.when(F.col(name) != ignored, F.col(name))
    best = F.max_by(usable, F.when(usable.isNotNull(), F.struct(F.col(score), usable)))
    return scored.groupBy(*key).agg(F.coalesce(best, F.lit(default)).alias("chart_type"))


def adaptive_confidence(rows: DataFrame, key: list[str], score: str, least: int, start: float = 0.8, step: float = 0.1) -> DataFrame:
    """Rows at the highest threshold (``start`` down to 0) that leaves a chart at least ``least`` rows; a missing score always passes."""
    level = F.when(F.col(score).isNull(), start).otherwise(F.least(F.floor(F.round(F.col(score) / step, 9)) * step, F.lit(start)))
    counted = rows.withColumn("_level", F.round(level, 6)).groupBy(*key, "_level").agg(F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*key).orderBy(F.desc("_level"))
    reached = counted.withColumn("_sum", F.sum("_n").over(down)).where(F.col("_sum") >= least)
    chosen = reached.groupBy(*key).agg(F.max("_level").alias("threshold"))
    joined = rows.join(chosen, key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    return joined.where(F.col(score).isNull() | (F.col(score) >= F.col("threshold") - 1e-9))


def with_fallback(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``first``; those of ``second`` for charts that ``first`` has none of."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def histogram_fallback(first: DataFrame, lower: DataFrame, borrowed: DataFrame, key: list[str], name: str = "class_name", wanted: str = "bar") -> DataFrame:
    """Detections of histograms: those of ``first`` for images with a bar; else those of ``lower`` (at a lower threshold) if they have one; else
    ``first`` with the bars of another detector.
    """
    with_bars = lambda rows: rows.where(F.col(name) == wanted).select(*key).distinct()
    settled = with_bars(first)
    second = lower.join(settled, key, "left_anti").join(with_bars(lower), key, "left_semi")
    kept = first.join(second.select(*key).distinct(), key, "left_anti")
    third = borrowed.where(F.col(name) == wanted).join(settled, key, "left_anti").join(with_bars(lower), key, "left_anti")
    return kept.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


def survives(errors: Column, result: Column) -> Column:
    """A chart without a result goes on only if every error is about calibration."""
    return result.isNotNull() | F.coalesce(F.forall(errors, lambda e: F.lower(e).contains("calibration")), F.lit(False))


def content_dedup(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Each row with the first of the rows of equal content, by its hash; only hashes are grouped."""
    keyed = rows.select(order, F.sha2(F.col(content), 256).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(firsts, "digest").select(order, "first", "copies")
