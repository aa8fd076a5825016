"""Conformal intervals: binned quantiles of nonconformity scores, and their lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Cells of a group's range of scores; only the cell that holds the quantile is sorted.
CELLS = 4_096


def quantiles(scores: DataFrame, key: list[str], score: str, alpha: float, least: int = 2) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each group, at most the largest; groups under ``least`` go.

    Scores are counted in even cells of their group's range before the shuffle, and only those in the cell that the quantile falls into are ranked, so
    a few groups of many scores don't sort them all in a few tasks. ``scores`` is read three times.
    """
    known = scores.where(F.col(score).isNotNull()).select(*key, F.col(score).cast("double").alias("_s"))
    sized = known.groupBy(*key).agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"), F.count(F.lit(1)).alias("n_cal")).where(F.col("n_cal") >= least)
    same = reduce(lambda c, k: c & F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")), key, F.lit(True))
    joined = known.alias("s").join(sized.alias("g"), same).select(*[F.col(f"s.{k}").alias(k) for k in key], "_s", "_low", "_high", "n_cal")
    cell = F.least(F.floor((F.col("_s") - F.col("_low")) / (F.col("_high") - F.col("_low")) * CELLS), F.lit(CELLS - 1))
    celled = joined.withColumn("_cell", F.coalesce(F.when(F.col("_high") > F.col("_low"), cell), F.lit(0)))
    counted = celled.groupBy(*key, "_cell").agg(F.count(F.lit(1)).alias("_m"), F.first("n_cal").alias("n_cal"))
    up = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    k = F.least(F.ceil((F.col("n_cal") + 1) * (1 - alpha)), F.col("n_cal"))
    held = counted.withColumn("_upto", F.sum("_m").over(up)).where((F.col("_upto") >= k) & (F.col("_upto") - F.col("_m") < k))
    held = held.select(*key, "_cell", "n_cal", (k - F.col("_upto") + F.col("_m")).alias("_k"))
    both = [*key, "_cell"]
    within = reduce(lambda c, x: c & F.col(f"s.{x}").eqNullSafe(F.col(f"g.{x}")), both, F.lit(True))
    inside = celled.alias("s").join(held.alias("g"), within).select(*[F.col(f"s.{x}").alias(x) for x in key], "_s", "g.n_cal", "_k")
    copies = inside.groupBy(*key, "_s", "n_cal", "_k").agg(F.count(F.lit(1)).alias("_m"))
    ranked = copies.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("_upto") >= F.col("_k")).groupBy(*key).agg(F.min("_s").alias("q_alpha"), F.first("n_cal").alias("n_cal"))


def bins(rows: DataFrame, family: str, feature: str, n: int) -> DataFrame:
    """``family, bin, lo, hi``: edges at even percentiles, open at both ends; one bin for under 2 n rows."""
    inner = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = rows.groupBy(family).agg(F.count(feature).alias("n"), F.percentile(feature, inner).alias("e"))
    e = F.when(F.col("n") >= 2 * n, F.array_distinct("e")).otherwise(F.array().cast("array<double>"))
    full = F.concat(F.array(F.lit(float("-inf"))), e, F.array(F.lit(float("inf"))))
    dealt = edges.select(family, full.alias("e")).select(family, "e", F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("bin", "lo"))
    return dealt.select(family, "bin", "lo", F.col("e")[F.col("bin") + 1].alias("hi"))


def binned(rows: DataFrame, edges: DataFrame, family: str, feature: str) -> DataFrame:
    """Rows with their ``bin``: lo <= feature < hi. A family's few edges are gathered in an array, so rows aren't multiplied."""
    arrays = edges.groupBy(family).agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi"))).alias("_bins"))
    joined = rows.join(arrays, family, "left")
    inside = F.get(F.filter("_bins", lambda b: (F.col(feature) >= b["lo"]) & (F.col(feature) < b["hi"])), F.lit(0))
    return joined.withColumn("bin", F.coalesce(inside["bin"], F.element_at("_bins", -1)["bin"])).drop("_bins")


def intervals(rows: DataFrame, table: DataFrame, family: str, value: str, relative: bool, tau: float) -> DataFrame:
    """``low`` and ``high`` around ``value`` from the quantile of the row's family and bin; null without one."""
    scale = F.greatest(F.abs(F.col(value)), F.lit(tau)) if relative else F.lit(1.0)
    joined = rows.join(table.select(family, "bin", "q_alpha"), [family, "bin"], "left")
    half = F.col("q_alpha") * scale
    return joined.withColumn("low", F.col(value) - half).withColumn("high", F.col(value) + half)
