"""Value rules of single chart types: histograms, lines, areas, boxes, pies, heatmaps; zero lines and calibration gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions.scalars import scaled

TURN = 2 * math.pi


# --- bars with bins, lines, areas ----------------------------------------------------------------


def histogram_bins(bars: DataFrame, key: list[str], low: Column, high: Column, value: str) -> DataFrame:
    """Bins in the order of their centres: ``bin_index, low, high, width, center, value``."""
    placed = bars.select(*key, low.alias("low"), high.alias("high"), F.col(value).alias("value"))
    placed = placed.withColumns({"width": F.col("high") - F.col("low"), "center": (F.col("low") + F.col("high")) / 2})
    order = Window.partitionBy(*key).orderBy("center", "low", "value")
    return placed.withColumn("bin_index", F.row_number().over(order) - 1)


def height_values(points: DataFrame, fits: DataFrame, key: list[str], at: Column, baseline: Column) -> DataFrame:
    """Lines and areas: the distance of a point's value from the baseline's through the scale, in pixels without a calibration or
    baseline (0 without a baseline). ``fits``: key, ``scale, slope, intercept``.
    """
    through = lambda c: scaled(F.col("scale"), F.col("slope"), F.col("intercept"), c)
    pixels = F.coalesce(F.abs(baseline - at), F.lit(0.0))
    value = F.when(F.col("slope").isNotNull() & baseline.isNotNull(), F.abs(through(baseline) - through(at))).otherwise(pixels)
    joined = points.join(fits.select(*key, "scale", "slope", "intercept"), key, "left")
    return joined.withColumn("pixel_distance", pixels).withColumn("value", value)


def indexed(points: DataFrame, key: list[str], at: Column, tie: str) -> DataFrame:
    """Points numbered along an axis."""
    return points.withColumn("index", F.row_number().over(Window.partitionBy(*key).orderBy(at, tie)) - 1)


def area_summary(points: DataFrame, key: list[str], x: Column, tie: str, baseline: Column) -> DataFrame:
    """Points, the baseline's value and the trapezoid area under ``value``; null areas without a calibration or with one point."""
    placed = points.withColumn("_x", x)
    w = Window.partitionBy(*key).orderBy("_x", tie)
    piece = (F.col("_x") - F.lag("_x").over(w)) * (F.col("value") + F.lag("value").over(w)) / 2
    base = scaled(F.col("scale"), F.col("slope"), F.col("intercept"), baseline)
    got = placed.withColumn("_a", piece).withColumn("_b", base).groupBy(*key).agg(F.sum("_a").alias("a"), F.first("_b").alias("baseline_value"), F.count(F.lit(1)).alias("num_points"))
    return got.select(*key, "num_points", "baseline_value", F.when(F.col("baseline_value").isNotNull(), F.col("a")).alias("total_auc"))


# --- boxes -----------------------------------------------------------------------------------------


def whiskers_of_indicator(one: Column, other: Column, q1: Column, q3: Column) -> Column:
    """Whiskers from the ends of a range indicator: outside the box as they are, an end inside it at the quartile, both inside 1.5 box heights away."""
    low, high, reach = F.least(one, other), F.greatest(one, other), 1.5 * (q3 - q1)
    inside = (low >= q1) & (high <= q3)
    return F.struct(
        F.when(inside, q1 - reach).otherwise(F.least(low, q1)).alias("whisker_low"), F.when(inside, q3 + reach).otherwise(F.greatest(high, q3)).alias("whisker_high"),
        F.when(inside, "iqr_fallback").otherwise("indicator").alias("method"),
    )


def median_by_neighbours(boxes: DataFrame, key: list[str], box: str) -> DataFrame:
    """Missing medians from the median place of the other boxes' medians within their quartiles, else the middle of the box.

    ``boxes``: ``q1, q3, median`` (null if undetected). A chart has few boxes: its places are gathered per chart.
    """
    iqr = F.col("q3") - F.col("q1")
    place = F.when((iqr > 0) & F.col("median").isNotNull(), (F.col("median") - F.col("q1")) / iqr)
    held = boxes.withColumn("_all", F.collect_list(F.when(place.isNotNull(), place)).over(Window.partitionBy(*key)))
    sorted_all = F.array_sort("_all")
    n = F.size("_all")
    middle = (F.get(sorted_all, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_all, F.floor(n / 2).cast("int"))) / 2
    found = F.when(F.col("median").isNotNull(), F.col("median")).when(n > 0, F.col("q1") + middle * iqr).otherwise((F.col("q1") + F.col("q3")) / 2)
    method = F.when(F.col("median").isNotNull(), "detected_line").when(n > 0, "neighbor_based").otherwise("geometric_center")
    sure = F.when(F.col("median").isNotNull(), 1.0).when(n > 0, 0.7).otherwise(0.3)
    return held.withColumn("_found", found).withColumn("median_method", method).withColumn("median_confidence", sure).withColumn("median", F.col("_found")).drop("_all", "_found")


def estimated_whiskers(boxes: DataFrame, key: list[str]) -> DataFrame:
    """``low, high, method`` for boxes without detected whiskers.

    By outliers (``outliers``): the nearest beyond a quartile, at most 1.5 box heights away. Else by the other boxes of the chart with known
    whiskers (``whisker_low, whisker_high, whisker_confidence`` of at least 0.5): their mean reaches in box heights, weighted by confidence,
    as window sums less the box's own part. Else 1.5 box heights.
    """
    q1, q3 = F.col("q1"), F.col("q3")
    iqr = q3 - q1
    below, above = F.array_max(F.filter("outliers", lambda o: o < q1)), F.array_min(F.filter("outliers", lambda o: o > q3))
    sure = F.coalesce("whisker_confidence", F.lit(0.5))
    counts = F.col("whisker_low").isNotNull() & F.col("whisker_high").isNotNull() & (sure >= 0.5) & (iqr > 0)
    parts = {"_w": F.when(counts, sure), "_l": F.when(counts, sure * (q1 - F.col("whisker_low")) / iqr), "_h": F.when(counts, sure * (F.col("whisker_high") - q3) / iqr)}
    rows = boxes.withColumns({c: F.coalesce(e, F.lit(0.0)) for c, e in parts.items()})
    whole = Window.partitionBy(*key)
    others = {c: F.sum(c).over(whole) - F.col(c) for c in parts}
    rows = rows.withColumns({f"{c}_others": e for c, e in others.items()})
    weight = F.col("_w_others")
    known, near = F.size(F.coalesce("outliers", F.array().cast("array<double>"))) > 0, weight > 1e-9
    low = F.when(known, F.greatest(q1 - 1.5 * iqr, below)).when(near, q1 - F.col("_l_others") / weight * iqr).otherwise(q1 - 1.5 * iqr)
    high = F.when(known, F.least(q3 + 1.5 * iqr, above)).when(near, q3 + F.col("_h_others") / weight * iqr).otherwise(q3 + 1.5 * iqr)
    method = F.when(known, "outliers").when(near, "neighbors").otherwise("iqr")
    return rows.withColumns({"low": low, "high": high, "method": method}).drop(*parts, *[f"{c}_others" for c in parts])


def running_threshold(rows: DataFrame, key: list[str], order: str, confidence: str, base: float) -> DataFrame:
    """``threshold`` from the rows before: mean less deviation of their confidences, between ``base`` and 0.6; ``base`` for under two."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    adaptive = F.greatest(F.lit(base), F.least(F.lit(0.6), F.avg(confidence).over(before) - F.stddev_pop(confidence).over(before)))
    return rows.withColumn("threshold", F.when(F.count(confidence).over(before) >= 2, adaptive).otherwise(base))


def five_checked(numbers: Column) -> Column:
    """Struct of five ``numbers`` in order, whether that changed them, and whether it moved one by over a tenth of their range; as they are if one is missing."""
    missing = F.exists(numbers, lambda v: v.isNull())
    in_order = F.array_sort(numbers)
    span = F.array_max(numbers) - F.array_min(numbers)
    moves = F.zip_with(numbers, in_order, lambda a, b: F.abs(a - b))
    most = F.coalesce(F.array_max(moves), F.lit(0.0))
    severe = most > 0.1 * F.when(span == 0, 1.0).otherwise(span)
    return F.struct(F.when(missing, numbers).otherwise(in_order).alias("numbers"), (~missing & (most > 0)).alias("corrected"), (~missing & severe).alias("severe"))


# --- pies --------------------------------------------------------------------------------------------


def mid_angle(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Degrees of a slice's centre around the pie's, from 0 up to 360."""
    angle = F.degrees(F.atan2(y - cy, x - cx))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def neighbour_spans(rows: DataFrame, key: list[str], angle: str, tie: str) -> DataFrame:
    """``span``: half the way from the slice before to the slice after, around the circle, in degrees."""
    w = Window.partitionBy(*key).orderBy(angle, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.col(angle) - F.coalesce(F.lag(angle).over(w), F.last(angle).over(whole))
    on = F.coalesce(F.lead(angle).over(w), F.first(angle).over(whole)) - F.col(angle)
    back, on = F.when(back < 0, back + 360).otherwise(back), F.when(on <= 0, on + 360).otherwise(on)
    return rows.withColumn("span", (back + on) / 2)


def keypoint_span(points: Column, cx: Column, cy: Column) -> Column:
    """Radians that a slice spans: a full turn less the largest gap between its boundary points' angles; null for under two.

    ``points``: structs ``x, y``; the first is the slice's centre, the next four its boundary, of which those at or below 0 in both are undetected.
    """
    seen = F.filter(F.slice(points, 2, 4), lambda p: ~((p["x"] <= 0) & (p["y"] <= 0)))
    turned = F.transform(seen, lambda p: F.atan2(p["y"] - cy, p["x"] - cx))
    angles = F.array_sort(F.transform(turned, lambda a: F.when(a < 0, a + TURN).otherwise(a)))
    after = F.concat(F.slice(angles, 2, F.greatest(F.size(angles) - 1, F.lit(0))), F.array(F.get(angles, F.lit(0)) + TURN))
    gaps = F.zip_with(after, angles, lambda b, a: b - a)
    return F.when(F.size(angles) >= 2, F.greatest(F.lit(0.0), F.least(F.lit(TURN), TURN - F.array_max(gaps))))


def pie_values(rows: DataFrame, key: list[str], span: str, label: str) -> DataFrame:
    """``value, source``: the slices' shares from parsed labels and spans.

    Labels in (0, 1] count. None: shares of the spans. Their sum at most 1: labels as they are, and the rest by span. A larger sum: the labels'
    shares if all slices have one, else the spans'.
    """
    whole = Window.partitionBy(*key)
    n, total = F.count(F.lit(1)).over(whole), F.sum(span).over(whole)
    usable = F.when((F.col(label) > 0) & (F.col(label) <= 1), F.col(label))
    rows = rows.withColumn("_g", F.when(total > 0, F.col(span) / total).otherwise(1 / n)).withColumn("_l", usable)
    labelled, sum_l = F.count("_l").over(whole), F.sum("_l").over(whole)
    left = F.sum(F.when(F.col("_l").isNull(), F.col("_g"))).over(whole)
    rows = rows.withColumns({"_n": n, "_k": labelled, "_s": F.round(sum_l, 9), "_u": left})
    rest = F.when(F.col("_u") > 0, (1 - F.col("_s")) * F.col("_g") / F.col("_u")).otherwise((1 - F.col("_s")) / (F.col("_n") - F.col("_k")))
    fits = F.col("_s") <= 1
    value = F.when(F.col("_k") == 0, F.col("_g")).when(fits, F.coalesce("_l", rest)).when(F.col("_k") == F.col("_n"), F.col("_l") / F.col("_s")).otherwise(F.col("_g"))
    has = F.col("_l").isNotNull()
    source = F.when(F.col("_k") == 0, "geometric").when(fits & has, "data_label").when(fits, "geometric_residual")
    source = source.when(F.col("_k") == F.col("_n"), "data_label_normalized").otherwise("geometric")
    return rows.withColumn("value", value).withColumn("source", source).drop("_g", "_l", "_n", "_k", "_s", "_u")


# --- heatmaps ------------------------------------------------------------------------------------------


def _centers(rows: DataFrame, key: list[str], at: str, gap: Column) -> DataFrame:
    """Mean of each run of coordinates without a gap above ``gap`` (a column of ``rows``)."""
    w = Window.partitionBy(*key).orderBy(at)
    opens = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    runs = rows.withColumn("_o", opens).withColumn("_run", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "_run").agg(F.avg(at).alias("center"))


def grid_lines(cells: DataFrame, key: list[str], at: str, extent: float) -> DataFrame:
    """Rows or columns of a heatmap: ``line, center``. Coarse lines by a gap of 1.5 % of the image, then again by half their median distance."""
    counted = cells.where(F.col(at).isNotNull())
    coarse = _centers(counted, key, at, F.lit(0.015 * extent))
    step = coarse.withColumn("_d", F.col("center") - F.lag("center").over(Window.partitionBy(*key).orderBy("center")))
    gaps = step.groupBy(*key).agg(F.median("_d").alias("_step"))
    fine = counted.join(gaps, key).withColumn("_gap", F.coalesce(0.5 * F.col("_step"), F.lit(0.015 * extent)))
    lines = _centers(fine, key, at, F.col("_gap"))
    return lines.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("center")) - 1).alias("line"), "center")


def nearest_line(cells: DataFrame, lines: DataFrame, key: list[str], at: str, name: str) -> DataFrame:
    """Cells with the number ``name`` of the nearest line, the first of equals. A chart's lines are gathered, so cells aren't multiplied."""
    held = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "center"))).alias("_lines"))
    away = F.transform("_lines", lambda x: F.struct(F.abs(x["center"] - F.col(at)).alias("d"), x["line"].alias("line")))
    return cells.join(held, key, "left").withColumn(name, F.array_min(away)["line"]).drop("_lines")


def robust_bounds(cells: DataFrame, key: list[str]) -> DataFrame:
    """``left, top, right, bottom``: the 5th percentiles of the near sides and the 95th of the far ones."""
    edge = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    return cells.groupBy(*key).agg(edge("x1", 0.05, "left"), edge("y1", 0.05, "top"), edge("x2", 0.95, "right"), edge("y2", 0.95, "bottom"))


def curve_value(curve: Column, color: Column) -> Column:
    """Struct (value, confidence) of a colour by the nearest point of a calibration curve; ``curve``: array of (``color``, ``value``), colours arrays of numbers.

    The confidence falls with the distance from the curve, by a deviation of 15 levels.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)

    def along(i: Column) -> Column:
        a, b = F.get(curve, i), F.get(curve, i + 1)
        step = less(b["color"], a["color"])
        length = dot(step, step)
        t = F.when(length < 1e-6, 0.0).otherwise(F.least(F.greatest(dot(less(color, a["color"]), step) / length, F.lit(0.0)), F.lit(1.0)))
        gap = F.zip_with(less(color, a["color"]), step, lambda p, q: p - t * q)
        return F.struct(F.round(dot(gap, gap), 9).alias("d"), i.alias("i"), (a["value"] + t * (b["value"] - a["value"])).alias("value"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(curve) - 2), along))
    return F.when(F.size(curve) >= 2, F.struct(best["value"].alias("value"), F.exp(-best["d"] / 450.0).alias("confidence")))


# --- zero lines ------------------------------------------------------------------------------------------


def zero_line(labels: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """``zero_at, method`` of an axis from its labels: the mean place of zero labels, else where a line through all labels is 0, else
    between the first neighbours (by value) of different sign, else beyond the two smallest positive or largest negative ones.
    """
    usable = labels.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    x, v = F.col(at).cast("double"), F.col(value).cast("double")
    got = usable.groupBy(*key).agg(
        F.avg(F.when(F.abs(v) < 1e-6, x)).alias("zeros"), F.count(F.lit(1)).alias("n"), F.covar_pop(x, v).alias("c"), F.var_pop(x).alias("vx"),
        F.avg(x).alias("mx"), F.avg(v).alias("mv"), F.array_sort(F.collect_list(F.struct(v.alias("v"), x.alias("x")))).alias("p"),
    )
    slope = F.when(F.col("vx") > 1e-12, F.col("c") / F.col("vx"))
    line = F.when(F.abs(slope) >= 1e-6, F.col("mx") - F.col("mv") / slope)
    p, n = F.col("p"), F.col("n").cast("int")
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b"))),
        lambda s: F.signum(s["a"]["v"]) != F.signum(s["b"]["v"]),
    )
    first = F.get(flips, F.lit(0))
    between = first["a"]["x"] + F.abs(first["a"]["v"]) / F.abs(first["b"]["v"] - first["a"]["v"]) * (first["b"]["x"] - first["a"]["x"])

    def beyond(a: Column, b: Column, start: Column) -> Column:
        steep = (b["v"] - a["v"]) / F.when(F.abs(b["x"] - a["x"]) > 1e-6, b["x"] - a["x"])
        return F.when(F.abs(steep) > 1e-6, start["x"] - start["v"] / steep)

    low, high = F.get(p, F.lit(0)), F.get(p, n - 1)
    outside = F.when(low["v"] > 0, beyond(low, F.get(p, F.lit(1)), low)).when(high["v"] < 0, beyond(F.get(p, n - 2), high, high))
    enough = F.col("n") >= 2
    method = F.when(F.col("zeros").isNotNull(), "zero_labels").when(enough & line.isNotNull(), "fit").when(enough & between.isNotNull(), "between").when(enough & outside.isNotNull(), "beyond")
    where = F.coalesce(F.col("zeros"), F.when(enough, F.coalesce(line, between, outside)))
    return got.select(*key, where.alias("zero_at"), method.alias("method"))


def edge_baseline(labels: DataFrame, key: list[str], x: Column, y: Column, width: float, height: float) -> DataFrame:
    """Baselines of scatter axes: the median place of labels in the bottom quarter (else the top one), and in the left quarter (else the right one)."""
    pick = lambda c, near: F.median(F.when(near, c))
    return labels.groupBy(*key).agg(
        F.coalesce(pick(y, y >= 0.75 * height), pick(y, y <= 0.25 * height)).alias("x_axis_at"), F.coalesce(pick(x, x <= 0.25 * width), pick(x, x >= 0.75 * width)).alias("y_axis_at")
    )


def edge_scores(rows: DataFrame, key: list[str], at: str, low: float, high: float) -> DataFrame:
    """How near centres are to either edge (mean of exp(-distance / 0.08)), and how evenly the median place parts them."""
    place = F.least(F.greatest((F.col(at) - low) / max(high - low, 1e-6), F.lit(0.0)), F.lit(1.0))
    middle = rows.withColumn("_m", F.median(at).over(Window.partitionBy(*key)))
    left, right = F.count_if(F.col(at) < F.col("_m")), F.count_if(F.col(at) >= F.col("_m"))
    return middle.groupBy(*key).agg(
        F.avg(F.exp(-place / 0.08)).alias("low_score"), F.avg(F.exp(-(1 - place) / 0.08)).alias("high_score"), (1 - F.abs(left - right) / (left + right)).alias("balance")
    )


# --- gates and intervals -----------------------------------------------------------------------------------


def calibration_gate(fits: DataFrame, key: list[str], r2: str) -> DataFrame:
    """A chart's calibration by its worst axis: ``uncalibrated`` below 0.4 or without any, ``approximate`` below 0.85, else ``high``; and how many axes warn."""
    got = fits.groupBy(*key).agg(F.min(r2).alias("worst_r2"), F.count_if(F.col(r2) < 0.85).alias("warnings"))
    quality = F.when(F.col("worst_r2").isNull() | (F.col("worst_r2") < 0.4), "uncalibrated").when(F.col("worst_r2") < 0.85, "approximate").otherwise("high")
    return got.withColumn("calibration_quality", quality)


# The value families of chart types that have intervals.
FAMILIES = {"bar": {"value": "bar.y"}, "scatter": {"x": "scatter.x", "y": "scatter.y"}, "line": {"x": "line.x", "y": "line.y"},
            "box": {"median": "box.median", "q1": "box.q1", "q3": "box.q3"}, "histogram": {"value": "histogram.value"}}


def with_intervals(elements: DataFrame, kind: str, table: DataFrame, relative: bool, tau: float) -> DataFrame:
    """Elements of one chart type with ``uncertainty``, a map from each value of its families to (low, high); null values and unknown types have none.

    ``table``: ``family, bin, lo, hi, q_alpha``; a family's few bins are gathered. A value's bin is that of its size, the last where none holds it.
    """
    held = table.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "q_alpha"))).alias("bins"))
    found = elements
    entries = []
    for name, family in FAMILIES.get(kind, {}).items():
        bins_of = held.select(F.col("family").alias("_family"), F.col("bins").alias(f"_{name}"))
        found = found.withColumn("_family", F.lit(family)).join(bins_of, "_family", "left").drop("_family")
        size, bins = F.abs(F.col(name)), F.col(f"_{name}")
        hit = F.coalesce(F.get(F.filter(bins, lambda b: (size >= b["lo"]) & (size < b["hi"])), F.lit(0)), F.element_at(bins, -1))  # noqa: B023
        half = hit["q_alpha"] * (F.greatest(size, F.lit(tau)) if relative else F.lit(1.0))
        span = F.struct((F.col(name) - half).alias("low"), (F.col(name) + half).alias("high"))
        entries.append(F.when(F.col(name).isNotNull() & half.isNotNull(), F.struct(F.lit(name).alias("key"), span.alias("value"))))
    known = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else None
    spans = F.map_from_entries(known) if entries else F.lit(None).cast("map<string,struct<low:double,high:double>>")
    return found.withColumn("uncertainty", spans).drop(*[f"_{n}" for n in FAMILIES.get(kind, {})])
