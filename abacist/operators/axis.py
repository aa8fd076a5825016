"""Chart-level decisions: orientation, second axis, baselines, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def orientation(rows: DataFrame, key: list[str], width: str, height: str, x: str, y: str, extent: tuple[float, float]) -> DataFrame:
    """``orientation, confidence, method`` of each chart's bars.

    Bars vary along the value axis: the side that varies twice as much, else the ratio of the median sides if enough bars agree, else
    the spread of centres (against the image's ``extent``), else the majority, else vertical. A single bar goes by its sides. Spreads that are exactly
    a limit or twice another don't exceed it, whatever the last bits of their sums.
    """
    vary = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    upright, lying = F.col(height) > 1.5 * F.col(width), F.col(width) > 1.5 * F.col(height)
    got = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), vary(height).alias("cv_h"), vary(width).alias("cv_w"), F.median(height).alias("mh"), F.median(width).alias("mw"),
        (F.var_pop(x) / extent[0] ** 2).alias("vx"), (F.var_pop(y) / extent[1] ** 2).alias("vy"), F.count_if(upright).alias("up"), F.count_if(lying).alias("flat"),
    )
    got = got.withColumn("aspect", F.when(F.col("mw") > 0, F.col("mh") / F.col("mw")).otherwise(float("inf")))
    n, h, w, vx, vy, aspect, up, flat = (F.col(c) for c in ("n", "cv_h", "cv_w", "vx", "vy", "aspect", "up", "flat"))
    agree = F.greatest(up, flat) / n
    one = F.lit(1.0)
    choice = lambda what, sure, how: F.struct(F.lit(what).alias("orientation"), F.least(one, sure).alias("confidence"), F.lit(how).alias("method"))
    spread = lambda a, b: a / (b + 1e-6) / 2
    above = lambda a, b: a > b * (1 + 1e-12)
    decided = (
        F.when((n == 1) & (aspect > 1), choice("vertical", F.abs(aspect - 1), "single_element"))
        .when(n == 1, choice("horizontal", F.abs(aspect - 1), "single_element"))
        .when(above(h, 0.15) & above(h, 2 * w), choice("vertical", spread(h, w), "variance"))
        .when(above(w, 0.15) & above(w, 2 * h), choice("horizontal", spread(w, h), "variance"))
        .when((aspect > 1.5) & (agree > 0.6), choice("vertical", agree * (aspect - 1.5) / 1.5, "aspect_ratio"))
        .when((aspect < 1 / 1.5) & (agree > 0.6), choice("horizontal", agree * (1 / aspect - 1.5) / 1.5, "aspect_ratio"))
        .when(above(vx, 2 * vy) & (spread(vx, vy) > 0.6), choice("vertical", spread(vx, vy), "spatial_distribution"))
        .when(above(vy, 2 * vx) & (spread(vy, vx) > 0.6), choice("horizontal", spread(vy, vx), "spatial_distribution"))
        .when(up > flat, choice("vertical", up / n, "majority_vote"))
        .when(flat > up, choice("horizontal", flat / n, "majority_vote"))
        .otherwise(choice("vertical", F.lit(0.5), "default_fallback"))
    )
    return got.select(*key, "n", decided.alias("d")).select(*key, "n", "d.*")


def second_axis(rows: DataFrame, key: list[str], x: str, extent: float) -> DataFrame:
    """Labels spread over more than 0.6 of the extent have two axes, parted in the middle."""
    span = (F.max(x) - F.min(x)) / extent
    return rows.groupBy(*key).agg((span > 0.6).alias("has_dual"), ((F.max(x) + F.min(x)) / 2).alias("threshold"))


def stack_ends(rows: DataFrame, key: list[str], center: str, end: str, band: float) -> DataFrame:
    """Far end of each stack: bars whose centres fall into one band."""
    return rows.groupBy(*key, F.floor(F.col(center) / band).alias("band")).agg(F.max(end).alias("far_end"), F.min(end).alias("near_end"))


def baseline(ends: DataFrame, key: list[str], end: str, zero: str | None = None, snap: float = 10.0) -> DataFrame:
    """The 95th percentile of the stacks' ends, taken to the zero label where that is within ``snap``."""
    got = ends.groupBy(*key).agg(F.percentile(end, F.lit(0.95)).alias("baseline"), *([F.first(zero).alias("zero")] if zero else []))
    if zero:
        near = F.abs(F.col("baseline") - F.col("zero")) <= snap
        return got.select(*key, F.when(near, F.col("zero")).otherwise(F.col("baseline")).alias("baseline"))
    return got


def ends(rows: DataFrame, key: list[str], one: Column, other: Column, vertical: Column) -> DataFrame:
    """Least, largest and mean near and far ends of a chart's bars; near is the lower side of vertical ones, the left one of others."""
    low, high = F.least(one, other), F.greatest(one, other)
    both = {"near": F.when(vertical, high).otherwise(low), "far": F.when(vertical, low).otherwise(high)}
    return rows.groupBy(*key).agg(*[f(c).alias(f"{n}_{s}") for n, c in both.items() for s, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def detected_baseline(rows: DataFrame, key: list[str], center: str, near: str, band: float, vertical: Column, inverted: Column, zero: Column) -> DataFrame:
    """``baseline, bands, method`` from near ends by stack (bars whose centres share a band: the outermost end).

    Two bands or more: the 95th percentile of vertical charts, the 5th of horizontal ones, swapped for inverted axes; fewer: the median of all ends. A zero
    of the scale replaces it in horizontal charts, and in vertical ones where it is within 10 pixels. ``vertical, inverted, zero`` are of the chart.
    """
    marked = rows.withColumns({"_v": vertical, "_up": vertical != inverted, "_z": zero, "_band": F.floor(F.col(center) / band)})
    outer = marked.groupBy(*key, "_band").agg(F.when(F.first("_up"), F.max(near)).otherwise(F.min(near)).alias("_end"), F.first("_up").alias("_up"))
    high, low = F.percentile("_end", F.lit(0.95)), F.percentile("_end", F.lit(0.05))
    stacked = outer.groupBy(*key).agg(F.count(F.lit(1)).alias("bands"), F.when(F.first("_up"), high).otherwise(low).alias("_stacked"))
    plain = marked.groupBy(*key).agg(F.median(near).alias("_median"), F.first("_v").alias("_v"), F.first("_z").alias("_z"))
    found = plain.join(stacked, key).withColumn("_single", F.when(F.col("bands") >= 2, F.col("_stacked")).otherwise(F.col("_median")))
    use_zero = F.coalesce(~F.col("_v") | (F.abs(F.col("_single") - F.col("_z")) <= 10), F.lit(False)) & F.col("_z").isNotNull()
    method = F.when(use_zero, "zero").when(F.col("bands") >= 2, "stacks").otherwise("median")
    return found.select(*key, F.when(use_zero, F.col("_z")).otherwise(F.col("_single")).alias("baseline"), "bands", method.alias("method"))


def zero_crossing(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Where the values first change sign along ``order``: a zero value's place, or between two neighbours."""
    w = Window.partitionBy(*key).orderBy(order)
    after, place = F.lead(value).over(w), F.col(order).cast("double")
    at = F.when(F.col(value) == 0, place).when(
        F.col(value) * after < 0, place + (F.lead(order).over(w) - F.col(order)) * F.col(value) / (F.col(value) - after)
    )
    found = rows.withColumn("zero_at", at).where("zero_at IS NOT NULL")
    return found.groupBy(*key).agg(F.min_by("zero_at", order).alias("zero_at"))


def trapezoid(rows: DataFrame, key: list[str], x: Column, y: str, tie: str) -> DataFrame:
    """Area under the points, sorted by x."""
    points = rows.withColumn("_x", x)
    w = Window.partitionBy(*key).orderBy("_x", tie)
    piece = (F.col("_x") - F.lag("_x").over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("_a", piece).groupBy(*key).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"), F.count(F.lit(1)).alias("points"))


def contiguity(rows: DataFrame, key: list[str], start: str, end: str, slack: float = 0.15) -> DataFrame:
    """Histogram bins in the order of their centres: ``ok``, ``gaps``, ``overlaps`` or ``gaps_and_overlaps``, against the median bin width.

    Under two bins, or bins of under a pixel, are ``ok``.
    """
    w = Window.partitionBy(*key).orderBy(F.col(start) + F.col(end), start)
    gaps = rows.withColumn("_gap", F.lead(start).over(w) - F.col(end)).withColumn("_width", F.col(end) - F.col(start))
    width = gaps.withColumn("_median", F.median("_width").over(Window.partitionBy(*key)))
    share = F.when(F.col("_median") >= 1, F.col("_gap") / F.col("_median"))
    got = width.groupBy(*key).agg(F.count(F.lit(1)).alias("bins"), F.count_if(share > slack).alias("g"), F.count_if(share < -slack).alias("o"))
    state = F.when((F.col("g") > 0) & (F.col("o") > 0), "gaps_and_overlaps").when(F.col("g") > 0, "gaps").when(F.col("o") > 0, "overlaps").otherwise("ok")
    return got.select(*key, "bins", state.alias("contiguity"))


def layout(rows: DataFrame, key: list[str], center: str, width: str, tie: str) -> DataFrame:
    """``grouped``, ``stacked``, ``mixed`` or ``simple``, by the gaps between neighbouring centres.

    Grouped: of three gaps or more the largest is over 2.5 of the smallest. Stacked: a gap is under 0.3 of the median width. Mixed: of two
    gaps or more, gaps or widths deviate by over half of their median.
    """
    w = Window.partitionBy(*key).orderBy(center, tie)
    gaps = rows.withColumn("_gap", F.col(center) - F.lag(center).over(w))
    vary = lambda c: F.round(F.stddev_pop(c) / (F.median(c) + 1e-6), 9)
    got = gaps.groupBy(*key).agg(
        F.count("_gap").alias("n"), F.min("_gap").alias("least"), F.max("_gap").alias("most"), F.median(width).alias("w"),
        vary("_gap").alias("cv_gap"), vary(width).alias("cv_width"),
    )
    kind = (
        F.when((F.col("n") >= 3) & (F.col("most") > 2.5 * F.col("least")), "grouped")
        .when(F.col("least") < 0.3 * F.col("w"), "stacked")
        .when((F.col("n") > 1) & ((F.col("cv_gap") > 0.5) | (F.col("cv_width") > 0.5)), "mixed")
        .otherwise("simple")
    )
    return got.select(*key, kind.alias("layout"))


def circular_spans(rows: DataFrame, key: list[str], angle: str, tie: str) -> DataFrame:
    """The angle from each slice to the next one around the circle, in degrees."""
    w = Window.partitionBy(*key).orderBy(angle, tie)
    first = F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("span", F.coalesce(F.lead(angle).over(w), first + 360) - F.col(angle))


def circle_fit(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Kasa's algebraic circle through the points of each group, in closed form from centred sums."""
    whole = Window.partitionBy(*key)
    c = rows.withColumn("u", F.col(x) - F.avg(x).over(whole)).withColumn("v", F.col(y) - F.avg(y).over(whole))
    s = lambda e: F.sum(F.expr(e))
    got = c.groupBy(*key).agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"), s("u*u").alias("uu"), s("v*v").alias("vv"),
        s("u*v").alias("uv"), s("u*u*u + u*v*v").alias("a"), s("v*v*v + v*u*u").alias("b"),
    )
    d = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    uc = (F.col("a") * F.col("vv") - F.col("b") * F.col("uv")) / (2 * d)
    vc = (F.col("b") * F.col("uu") - F.col("a") * F.col("uv")) / (2 * d)
    radius = F.sqrt(uc * uc + vc * vc + (F.col("uu") + F.col("vv")) / F.col("n"))
    return got.where(F.abs(d) > 1e-12).select(*key, (uc + F.col("mx")).alias("cx"), (vc + F.col("my")).alias("cy"), radius.alias("radius"))


def trimmed_center(rows: DataFrame, key: list[str], value: str, rounds: int = 3) -> DataFrame:
    """Mean of the values within median + 3 deviations, trimmed ``rounds`` times."""
    whole = Window.partitionBy(*key)
    left = rows
    for _ in range(rounds):
        away = left.withColumn("_away", F.abs(F.col(value) - F.median(value).over(whole)))
        left = away.withColumn("_mad", F.median("_away").over(whole)).where((F.col("_mad") == 0) | (F.col("_away") <= 3 * F.col("_mad"))).drop("_away", "_mad")
    return left.groupBy(*key).agg(F.avg(value).alias("center"), F.count(F.lit(1)).alias("kept"))
