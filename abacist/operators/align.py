"""Bag alignment of two relations and the agreement statistics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bag_align(gold: DataFrame, pred: DataFrame, key: list[str], order: list[str], gold_cols: list[str], pred_cols: list[str]) -> DataFrame:
    """Full outer pairing of two bags: the i-th row of a key in one with the i-th in the other."""
    numbered = lambda rows: rows.withColumn("pair_no", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    g = numbered(gold).select(*key, "pair_no", *[F.col(c).alias(f"gold_{c}") for c in gold_cols], F.lit(True).alias("in_gold"))
    p = numbered(pred).select(*key, "pair_no", *[F.col(c).alias(f"pred_{c}") for c in pred_cols], F.lit(True).alias("in_pred"))
    found = g.join(p, [*key, "pair_no"], "full_outer")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_gold", "in_pred")})


def rank_merge(left: DataFrame, right: DataFrame, key: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Pairs the rows of a key by their ranks; the shorter side ends the pairing."""
    a = left.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)))
    b = right.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)))
    return a.join(b, [*key, "rank"])


def concordance(x: str, y: str) -> Column:
    """Lin's coefficient over pairs with both values; null with fewer than two or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    gap = F.avg(a) - F.avg(b)
    usable = (F.count(a) >= 2) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return F.when(usable, 2 * F.covar_pop(a, b) / (F.var_pop(a) + F.var_pop(b) + gap * gap))


def success_rate(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.avg((F.col("in_gold") & F.col("in_pred")).cast("double")).alias("success_rate"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from the grouped contingency table; null with under two rows or classes."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    of_a = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    of_b = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    margins = of_a.join(of_b, "label", "full_outer").agg(
        F.sum(F.coalesce("na", F.lit(0)).cast("double") * F.coalesce("nb", F.lit(0))).alias("products"), F.count(F.lit(1)).alias("classes")
    )
    whole = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    one_row = whole.withColumn("one", F.lit(1)).join(margins.withColumn("one", F.lit(1)), "one")
    return one_row.select(F.when((F.col("n") >= 2) & (F.col("classes") >= 2) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def report(aligned: DataFrame, gold_value: str, pred_value: str, gold_mark: str, pred_mark: str, require_ccc: bool = True, require_kappa: bool = True) -> DataFrame:
    """One row of counts, metrics and gates. Accuracy is the share of equal marks in all rows, matched or not; kappa is over all rows, unmatched
    ones with marks of their own. A missing coefficient fails its gate where it is required. Empty relations have the rates 1.
    """
    both, only = F.col("in_gold") & F.col("in_pred"), F.col("in_gold") & ~F.col("in_pred")
    one = F.lit(1).alias("one")
    counts = aligned.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(both).alias("matched"), F.count_if(only).alias("unmatched_gold"),
        F.count_if(both & F.col(gold_mark).eqNullSafe(F.col(pred_mark))).alias("equal"), concordance(gold_value, pred_value).alias("ccc"),
    )
    mark = lambda c, a, b: F.when(both, F.coalesce(c, F.lit(""))).when(only, a).otherwise(b)
    marked = aligned.select(mark(gold_mark, "__UNMATCHED_GOLD__", "__UNMATCHED_PRED__").alias("a"), mark(pred_mark, "__UNMATCHED_PRED__", "__UNMATCHED_GOLD__").alias("b"))
    found = counts.select("*", one).join(kappa(marked, "a", "b").select("kappa", one), "one")  # one row each
    rate = lambda c: F.when(F.col("total") == 0, 1.0).otherwise(F.col(c) / F.col("total"))
    found = found.withColumns({"success_rate": rate("matched"), "accuracy": rate("equal"), "unmatched_pred": F.col("total") - F.col("matched") - F.col("unmatched_gold")})
    gate = lambda c, least, required=True: F.coalesce(F.col(c) >= least, F.lit(not required))
    passed = gate("success_rate", 0.99) & gate("accuracy", 0.95) & gate("ccc", 0.90, require_ccc) & gate("kappa", 0.81, require_kappa)
    return found.select("matched", "unmatched_gold", "unmatched_pred", "total", "success_rate", "accuracy", "ccc", "kappa", passed.alias("passed"))


def by_type(aligned: DataFrame, kind: str, gold_value: str, pred_value: str, same: Column) -> DataFrame:
    """Count, accuracy and concordance of the matched rows of each type."""
    return aligned.where("in_gold AND in_pred").groupBy(kind).agg(
        F.count(F.lit(1)).alias("count"), F.avg(same.cast("double")).alias("accuracy"), concordance(gold_value, pred_value).alias("ccc")
    )


def runtime_comparison(base: Column, new: Column) -> Column:
    """Struct (ratio, savings in percent); null unless both are positive."""
    usable = (base > 0) & (new > 0)
    return F.struct(F.when(usable, new / base).alias("ratio"), F.when(usable, 100 * (base - new) / base).alias("savings"))
