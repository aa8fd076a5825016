"""Calibration fits per group, as sums; robust fits as an exhaustive search over pairs of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    d = n * sxx - sx * sx
    slope = F.when(F.abs(d) > 1e-12, (n * sxy - sx * sy) / d)
    return slope, (sy - slope * sx) / n


def line_fit(rows: DataFrame, key: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """(Weighted) least squares ``n, slope, intercept, r2`` per group of at least two points; a constant y has r2 0.

    Sums are taken around the group's means, so large coordinates lose no digits.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = F.least(F.greatest(F.col(weight), F.lit(1e-6)), F.lit(1.0)) if weight else F.lit(1.0)
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    if weight is None:
        got = both.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.avg(vx).alias("mx"), F.avg(vy).alias("my"),
            F.covar_pop(vx, vy).alias("cxy"), F.var_pop(vx).alias("vxx"), F.var_pop(vy).alias("vyy"),
        )
    else:
        s = lambda e: F.sum(w * e)
        sums = both.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), s(vx).alias("sx"), s(vy).alias("sy"),
            s(vx * vx).alias("sxx"), s(vx * vy).alias("sxy"), s(vy * vy).alias("syy"),
        )
        mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
        got = sums.select(
            *key, "n", mx.alias("mx"), my.alias("my"), (F.col("sxy") / F.col("sw") - mx * my).alias("cxy"),
            (F.col("sxx") / F.col("sw") - mx * mx).alias("vxx"), (F.col("syy") / F.col("sw") - my * my).alias("vyy"),
        )
    slope = F.when(F.col("vxx") > 1e-12, F.col("cxy") / F.col("vxx"))
    r2 = F.when(F.col("vyy") > 1e-12, F.col("cxy") * F.col("cxy") / (F.col("vxx") * F.col("vyy"))).otherwise(0.0)
    fitted = got.where("n >= 2").select(*key, "n", slope.alias("slope"), "mx", "my", r2.alias("r2"))
    return fitted.where("slope IS NOT NULL").select(*key, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2")


def log_fit(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Least squares of log10(y) over positive y."""
    positive = rows.where(F.col(y) > 0).withColumn("_log", F.log10(F.col(y).cast("double")))
    return line_fit(positive, key, x, "_log")


def mad_threshold(rows: DataFrame, key: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    """2.5 robust deviations (median absolute deviation x 1.4826); the plain deviation where that is 0."""
    whole = Window.partitionBy(*key)
    away = rows.withColumn("_away", F.abs(F.col(value) - F.median(value).over(whole)))
    got = away.groupBy(*key).agg(F.median("_away").alias("mad"), F.stddev_pop(value).alias("deviation"))
    robust = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("deviation"))
    return got.select(*key, "mad", F.greatest(2.5 * robust, F.lit(floor)).alias("threshold"))


def residual_threshold(rows: DataFrame, key: list[str], x: str, y: str, base: float) -> DataFrame:
    """2.5 robust deviations of the residuals from each group's line, at least ``base``; the plain deviation where the robust one is 0; ``base`` for under three points."""
    whole = Window.partitionBy(*key)
    fitted = rows.join(line_fit(rows, key, x, y).select(*key, "slope", "intercept"), key, "left")
    off = fitted.withColumn("_r", F.round(F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))), 9))
    away = off.withColumn("_away", F.abs(F.col("_r") - F.median("_r").over(whole)))
    got = away.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.median("_away").alias("mad"), F.stddev_pop("_r").alias("deviation"))
    robust = F.when(F.col("mad") > 1e-9, 1.4826 * F.col("mad")).otherwise(F.col("deviation"))
    limit = F.when(F.col("n") >= 3, F.greatest(F.coalesce(2.5 * robust, F.lit(base)), F.lit(base))).otherwise(base)
    return got.select(*key, "n", limit.alias("threshold"))


def consensus_fit(rows: DataFrame, key: list[str], x: str, y: str, order: str, threshold: float) -> DataFrame:
    """Per group the line through two of its points with the best truncated squared error, refitted to its inliers.

    Groups are the labels of one axis, so all pairs of a group are few; every hypothesis is tried, which
    makes the result independent of a random seed. Ties go to more inliers, then to the earlier pair.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    grouped = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key).agg(points.alias("p"))
    pairs = grouped.select(*key, "p", F.posexplode("p").alias("i", "a")).select(*key, "p", "i", "a", F.posexplode("p").alias("j", "b"))
    pairs = pairs.where((F.col("i") < F.col("j")) & (F.abs(F.col("b.x") - F.col("a.x")) > 1e-12))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    tried = pairs.withColumn("m", slope).withColumn("c", F.col("a.y") - F.col("m") * F.col("a.x"))
    error = lambda q: F.pow(q["y"] - (F.col("m") * q["x"] + F.col("c")), F.lit(2.0))
    limit = threshold * threshold
    cost = F.aggregate("p", F.lit(0.0), lambda s, q: s + F.least(error(q), F.lit(limit)))
    inside = F.filter("p", lambda q: error(q) <= limit)
    scored = tried.withColumn("inliers", inside).withColumn("score", F.round(0.5 * F.size("inliers") - cost, 5))
    best = scored.groupBy(*key).agg(F.max_by("inliers", F.struct("score", F.size("inliers"), -F.col("i"), -F.col("j"))).alias("inliers"), F.max("score").alias("score"))
    kept = best.select(*key, "score", F.explode("inliers").alias("q")).select(*key, "score", F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    fit = line_fit(kept, [*key, "score"], "x", "y")
    return fit.select(*key, F.col("n").alias("n_inliers"), "slope", "intercept", "r2")


def refined_fit(rows: DataFrame, key: list[str], x: str, y: str, weight: str, threshold: float, rounds: int = 2) -> DataFrame:
    """``slope, intercept, score, n_inliers`` of the weighted consensus line of each group.

    Every pair of points is a hypothesis; it scores half a point per inlier less the weighted squared errors, cut at ``threshold``. The best one is refitted (by
    weighted least squares) to its inliers, then ``rounds`` times to those within 0.9 of the threshold, and the best score on the way stands. Groups are
    the labels of one axis.
    """
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.least(F.greatest(F.col(weight).cast("double"), F.lit(1e-6)), F.lit(1.0)).alias("w"))
    grouped = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("p"))
    off = lambda q, line: F.abs(q["y"] - (line["m"] * q["x"] + line["c"]))
    inside = lambda line, limit: F.filter("p", lambda q: off(q, line) <= limit)

    def score(line: Column) -> Column:
        cost = F.aggregate("p", F.lit(0.0), lambda s, q: s + q["w"] * F.least(off(q, line) * off(q, line), F.lit(threshold * threshold)))
        return F.round(0.5 * F.size(inside(line, threshold)) - cost, 6)

    def refit(some: Column, before: Column) -> Column:
        total = lambda e: F.aggregate(some, F.lit(0.0), lambda s, q: s + q["w"] * e(q))
        sw, mx, my = total(lambda q: F.lit(1.0)), total(lambda q: q["x"]), total(lambda q: q["y"])
        sxy = total(lambda q: (q["x"] - mx / sw) * (q["y"] - my / sw))
        sxx = total(lambda q: (q["x"] - mx / sw) * (q["x"] - mx / sw))
        usable = (F.size(some) >= 2) & (sxx > 1e-12)
        return F.when(usable, F.struct((sxy / sxx).alias("m"), (my / sw - sxy / sxx * mx / sw).alias("c"))).otherwise(before)

    pairs = grouped.select(*key, "p", F.posexplode("p").alias("i", "a")).select(*key, "p", "i", "a", F.posexplode("p").alias("j", "b"))
    pairs = pairs.where((F.col("i") < F.col("j")) & (F.abs(F.col("b.x") - F.col("a.x")) > 1e-12))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    tried = pairs.withColumn("line", F.struct(slope.alias("m"), (F.col("a.y") - slope * F.col("a.x")).alias("c"))).withColumn("score", score(F.col("line")))
    best = tried.groupBy(*key).agg(F.max_by(F.struct("line", "p"), F.struct("score", -F.col("i"), -F.col("j"))).alias("b")).select(*key, "b.line", "b.p")
    best = best.withColumn("line", refit(inside(F.col("line"), threshold), F.col("line"))).withColumn("score", score(F.col("line"))).withColumn("at", F.col("line"))
    for _ in range(rounds):
        best = best.withColumn("at", refit(inside(F.col("at"), 0.9 * threshold), F.col("at"))).withColumn("_s", score(F.col("at")))
        better = F.col("_s") > F.col("score")
        best = best.withColumn("line", F.when(better, F.col("at")).otherwise(F.col("line"))).withColumn("score", F.greatest("score", "_s")).drop("_s")
    return best.select(*key, F.col("line.m").alias("slope"), F.col("line.c").alias("intercept"), "score", F.size(inside(F.col("line"), threshold)).alias("n_inliers"))


def axis_scale(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``linear`` where differences of the sorted labels vary little, ``log`` where ratios of the positive ones do, else ``linear`` below a variation
    of a half, ``unknown`` above it; ``confidence`` follows. Under three labels: ``unknown``.
    """
    w = Window.partitionBy(*key).orderBy(value)
    before = F.lag(value).over(w)
    steps = rows.where(F.col(value).isNotNull()).withColumn("d", F.col(value) - before).withColumn("q", F.when(before > 0, F.col(value) / before))
    vary = lambda c: F.when(F.avg(c) != 0, F.stddev_pop(c) / F.abs(F.avg(c))).otherwise(float("inf"))
    positive = F.count_if(F.col(value) > 0)
    got = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), vary("d").alias("cv_difference"), F.when(positive >= 3, vary("q")).otherwise(float("inf")).alias("cv_ratio")
    )
    d, q = F.col("cv_difference"), F.col("cv_ratio")
    kind = F.when(F.col("n") < 3, "unknown").when(d < 0.15, "linear").when((q < 0.15) & (d > q), "log").when(d < 0.5, "linear").otherwise("unknown")
    sure = F.when(F.col("n") < 3, 0.0).when(d < 0.15, 1 - d).when((q < 0.15) & (d > q), 1 - q).otherwise(F.greatest(F.lit(0.3), 1 - F.least(d, q)))
    return got.withColumn("scale", kind).withColumn("confidence", sure)


def consistent_labels(rows: DataFrame, key: list[str], x: str, y: str, share: float = 0.1) -> DataFrame:
    """Rows whose residual from their group's line is at most ``share`` of its range; groups left with under two rows stay whole."""
    fit = line_fit(rows, key, x, y)
    span = rows.groupBy(*key).agg((F.max(y) - F.min(y)).alias("span"))
    joined = rows.join(fit.select(*key, "slope", "intercept"), key, "left").join(span, key)
    near = F.coalesce(F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))) <= share * F.col("span"), F.lit(True))
    marked = joined.withColumn("_near", near).withColumn("_left", F.sum(near.cast("int")).over(Window.partitionBy(*key)))
    return marked.where(F.col("_near") | (F.col("_left") < 2)).select(*rows.columns)
