"""Values of chart elements from their boxes, the axis calibrations and the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions import geometry as G
from abacist.functions.scalars import scaled, uncertainty


def bar_values(bars: DataFrame, fits: DataFrame, vertical: Column, baseline: Column, key: list[str], label: Column | None = None) -> DataFrame:
    """The bar's far end from the baseline through the scale, less the baseline's value; a data label overrides it.

    Without a calibration the value is the bar's length in pixels. ``fits``: key, ``scale, slope, intercept, r2``.
    """
    b = G.box()
    low, high = F.when(vertical, b.y1).otherwise(b.x1), F.when(vertical, b.y2).otherwise(b.x2)
    end = F.when(F.abs(low - baseline) > F.abs(high - baseline), low).otherwise(high)
    through = lambda at: scaled(F.col("scale"), F.col("slope"), F.col("intercept"), at)
    joined = bars.join(fits, key, "left")
    read = F.when(F.col("slope").isNotNull(), through(end) - through(baseline)).otherwise(F.abs(high - low))
    value = F.coalesce(label, read) if label is not None else read
    spread = uncertainty(F.col("value"), F.col("slope"), F.col("r2"), F.col("confidence"))
    return joined.withColumn("value", value).withColumn("uncertainty", F.when(F.col("slope").isNotNull(), spread))


def point_values(points: DataFrame, x_fits: DataFrame, y_fits: DataFrame, key: list[str]) -> DataFrame:
    """Centres through both axes' calibrations."""
    renamed = lambda fits, p: fits.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("scale", "slope", "intercept")])
    joined = points.join(renamed(x_fits, "x"), key, "left").join(renamed(y_fits, "y"), key, "left")
    cx, cy = G.center(G.box())
    through = lambda p, at: scaled(F.col(f"{p}_scale"), F.col(f"{p}_slope"), F.col(f"{p}_intercept"), at)
    return joined.withColumn("x", through("x", cx)).withColumn("y", through("y", cy))


def point_statistics(points: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    both = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(x).alias("std_x"),
        F.stddev_pop(y).alias("std_y"), F.when(both, F.corr(x, y)).alias("r"),
    )


def five_numbers(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers at the last values inside the fences, and the number outside."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quartiles = rows.groupBy(*key).agg(q.alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    fenced = rows.join(quartiles, key).withColumn("_in", F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach))
    return fenced.groupBy(*key).agg(
        F.min(F.when(F.col("_in"), F.col(value))).alias("whisker_low"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"),
        F.first(F.col("q")[2]).alias("q3"), F.max(F.when(F.col("_in"), F.col(value))).alias("whisker_high"),
        F.sum((~F.col("_in")).cast("int")).cast("long").alias("outliers"),
    )


def ordered_five(numbers: Column) -> Column:
    """Five numbers in order; as they are if one is missing."""
    return F.when(F.exists(numbers, lambda v: v.isNull()), numbers).otherwise(F.array_sort(numbers))


def box_checked(low: Column, q1: Column, median: Column, q3: Column, high: Column, outliers: Column) -> Column:
    """Quartiles in order, the median within them, whiskers outside them, outliers outside the whiskers.

    If over half of the outliers are inside the whiskers, these are suspect and all outliers stay. As they are if one number is missing.
    """
    a, b = F.least(q1, q3), F.greatest(q1, q3)
    new_low, new_high = F.least(low, a), F.greatest(high, b)
    outside = F.filter(outliers, lambda o: (o < new_low) | (o > new_high))
    suspect = 2 * (F.size(outliers) - F.size(outside)) > F.size(outliers)
    whole = low.isNotNull() & q1.isNotNull() & median.isNotNull() & q3.isNotNull() & high.isNotNull()
    checked = {
        "whisker_low": (new_low, low), "q1": (a, q1), "median": (F.least(F.greatest(median, a), b), median), "q3": (b, q3), "whisker_high": (new_high, high),
        "outliers": (F.when(suspect, outliers).otherwise(outside), outliers), "suspect": (suspect, F.lit(False)),
    }
    return F.struct(*[F.when(whole, new).otherwise(old).alias(name) for name, (new, old) in checked.items()])


def shares(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each value's share of its group's sum; unchanged where the sum isn't positive."""
    total = F.sum(value).over(Window.partitionBy(*key))
    return rows.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))


def color_value(anchors: Column, at: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Piecewise linear value at a place of a colour bar; ``anchors``: sorted (position, value), extended at both ends.

    One anchor gives its value; none, the place between ``low`` and ``high``.
    """
    n = F.size(anchors)
    above = F.size(F.filter(anchors, lambda a: a["position"] < at))
    i = F.least(F.greatest(above, F.lit(1)), n - 1)
    a, b = F.get(anchors, i - 1), F.get(anchors, i)
    wide = b["position"] - a["position"]
    between = F.when(F.abs(wide) < 1e-6, F.when(at > b["position"], b["value"]).otherwise(a["value"])).otherwise(a["value"] + (at - a["position"]) * (b["value"] - a["value"]) / wide)
    bare = low + at * (high - low) if low is not None and high is not None else F.lit(None).cast("double")
    return F.when(n >= 2, between).when(n == 1, F.get(anchors, F.lit(0))["value"]).otherwise(bare)
