"""Associations of stacks, data labels, significance markers, box elements, slices, legends and axes.

All are within one chart: an equi-join on its key, then the rule. Elements are numbered (``bar``, ``label``, ...) in their order of detection, which
decides among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions import geometry as G
from abacist.operators import associate

# --- bars ------------------------------------------------------------------------------------------


def median_spacing(rows: DataFrame, key: list[str], at: str, default: float = 100.0) -> DataFrame:
    """Median distance of neighbouring centres per chart."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at))
    return rows.withColumn("_gap", gap).groupBy(*key).agg(F.coalesce(F.median("_gap"), F.lit(default)).alias("spacing"))


def stacks(bars: DataFrame, key: list[str], bar: str, center: str, extent: str, base: Column) -> DataFrame:
    """Bars with ``stack``, ``stack_at`` and ``place`` (from the base up): a bar joins the first stack whose first bar's centre is nearer than
    0.3 of the chart's median ``extent``, else it starts one.
    """
    whole = Window.partitionBy(*key)
    near = bars.withColumn("_near", 0.3 * F.median(extent).over(whole))
    row = F.struct(F.col(bar).alias("bar"), F.col(center).cast("double").alias("at"), F.col("_near").alias("near"))
    charts = near.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("bars"))

    def step(held: Column, b: Column) -> Column:
        hits = F.filter(F.transform(held["seeds"], lambda s, i: F.struct(i.alias("i"), (F.abs(s - b["at"]) < b["near"]).alias("hit"))), lambda h: h["hit"])
        new = F.size(hits) == 0
        stack = F.when(new, F.size(held["seeds"])).otherwise(F.get(hits, F.lit(0))["i"])
        seeds = F.when(new, F.concat(held["seeds"], F.array(b["at"]))).otherwise(held["seeds"])
        placed = F.struct(b["bar"].alias("bar"), stack.alias("stack"), F.get(seeds, stack).alias("at"))
        return F.struct(seeds.alias("seeds"), F.concat(held["out"], F.array(placed)).alias("out"))

    kind = dict(bars.dtypes)[bar]
    start = F.struct(F.array().cast("array<double>").alias("seeds"), F.array().cast(f"array<struct<bar:{kind},stack:int,at:double>>").alias("out"))
    found = charts.select(*key, F.explode(F.aggregate("bars", start, step)["out"]).alias("s")).select(*key, F.col("s.bar").alias(bar), F.col("s.stack").alias("stack"), F.col("s.at").alias("stack_at"))
    order = Window.partitionBy(*key, "stack").orderBy(base, bar)
    return bars.join(found, [*key, bar]).withColumn("place", F.row_number().over(order) - 1)


def label_strategies(bar: G.Box, label: G.Box, vertical: Column, spacing: Column) -> tuple[list[tuple[str, Column, Column]], Column]:
    """The ranked strategies of bar and label boxes, and their distance along the category axis."""
    side = lambda b: (F.when(vertical, b.x1).otherwise(b.y1), F.when(vertical, b.x2).otherwise(b.y2))
    (b1, b2), (l1, l2) = side(bar), side(label)
    distance = F.abs((l1 + l2) / 2 - (b1 + b2) / 2)
    shared = F.when(l2 - l1 >= 1e-6, G.overlap(b1, b2, l1, l2) / (l2 - l1)).otherwise(0.0)
    return associate.overlap_strategies(shared, distance, b2 - b1, spacing), distance


def bar_labels(bars: DataFrame, labels: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """Tick or data labels of bars, each label with its best bar only. ``bars``: ``bar``, box, ``spacing``; ``labels``: ``label``, box with ``l_``."""
    plans, distance = label_strategies(G.box(), G.box("l_"), vertical, F.col("spacing"))
    plans = [(n, c, F.round(v, 9)) for n, c, v in plans]
    return associate.ranked(bars, labels, key, plans, distance, "bar", "label")


def stack_labels(stacked: DataFrame, labels: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """The label of each stack, by its lowest bar, for all of its bars. ``stacked``: as ``stacks`` gives it, with ``spacing``."""
    plans, _ = label_strategies(G.box(), G.box("l_"), vertical, F.col("spacing"))
    at = F.when(vertical, (F.col("l_x1") + F.col("l_x2")) / 2).otherwise((F.col("l_y1") + F.col("l_y2")) / 2)
    score, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for label, holds, confidence in reversed(plans):
        score, name = F.when(holds, F.round(confidence, 9)).otherwise(score), F.when(holds, label).otherwise(name)
    pairs = stacked.where("place = 0").join(labels, key).withColumns({"confidence": score, "strategy": name, "distance": F.abs(F.col("stack_at") - at)})
    best = F.max_by(F.struct("label", "strategy", "confidence", "distance"), F.struct("confidence", -F.col("distance"), -F.col("label")))
    chosen = pairs.where("confidence IS NOT NULL").groupBy(*key, "stack").agg(best.alias("b")).select(*key, "stack", "b.*")
    size = F.count(F.lit(1)).over(Window.partitionBy(*key, "stack"))
    return stacked.withColumn("stack_size", size).join(chosen, [*key, "stack"], "left")


def significance(bars: DataFrame, markers: DataFrame, key: list[str], vertical: Column, reach: float = 100.0) -> DataFrame:
    """``bar, marker, distance``: each marker's nearest bar below it (left of it) with a gap under ``reach``; of a bar's markers the last stays."""
    b, m = G.box(), G.box("m_")
    (bx, by), (mx, my) = G.center(b), G.center(m)
    valid = F.when(vertical, (my < b.y1) & (b.y1 - m.y2 < reach)).otherwise((mx > b.x2) & (m.x1 - b.x2 < reach))
    distance = F.when(vertical, F.abs(mx - bx)).otherwise(F.abs(my - by))
    pairs = bars.join(markers, key).where(valid).withColumn("distance", distance)
    nearest = pairs.groupBy(*key, "marker").agg(F.min_by(F.struct("bar", "distance"), F.struct("distance", "bar")).alias("b"))
    last = nearest.groupBy(*key, F.col("b.bar").alias("bar")).agg(F.max_by(F.struct("marker", "b.distance"), "marker").alias("m"))
    return last.select(*key, "bar", "m.marker", "m.distance")


def spanned(bars: DataFrame, markers: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """``marker, bar, span_count`` of the bars whose centres are within a marker's span, wholly below it (left of it)."""
    b, m = G.box(), G.box("m_")
    cx, cy = G.center(b)
    inside = F.when(vertical, cx.between(m.x1, m.x2) & (m.y2 < b.y1)).otherwise(cy.between(m.y1, m.y2) & (m.x1 > b.x2))
    pairs = markers.join(bars, key).where(inside).select(*key, "marker", "bar")
    return pairs.withColumn("span_count", F.count(F.lit(1)).over(Window.partitionBy(*key, "marker")))


# --- boxes -----------------------------------------------------------------------------------------


def _first_or_nearest(boxes: DataFrame, others: DataFrame, key: list[str], number: str, vertical: Column, first: Column) -> DataFrame:
    """Per box ``first`` (an aggregate) of the intersecting elements, else the nearest whose centre is within half a box width of the box's."""
    b, o = G.box(), G.box("o_")
    (bx, by), (ox, oy) = G.center(b), G.center(o)
    touching = G.intersects(b, o)
    aligned = F.when(vertical, F.abs(ox - bx) < 0.5 * (b.x2 - b.x1)).otherwise(F.abs(oy - by) < 0.5 * (b.y2 - b.y1))
    away = F.when(vertical, F.abs(oy - by)).otherwise(F.abs(ox - bx))
    pairs = boxes.join(others, key).withColumns({"_touch": touching, "_away": F.when(~touching & aligned, away)}).where("_touch OR _away IS NOT NULL")
    near = F.min_by(F.struct(*[f"o_{c}" for c in ("x1", "y1", "x2", "y2")]), F.struct(F.coalesce("_away", F.lit(float("inf"))), number))
    return pairs.groupBy(*key, "box").agg(F.count_if(F.col("_touch")).alias("touching"), F.coalesce(first, near).alias("at")).select(*key, "box", "touching", "at.*")


def box_whiskers(boxes: DataFrame, indicators: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """Each box's range indicator: the envelope of those that touch it, else the nearest aligned one. ``boxes``: ``box``, box; others with ``o_``."""
    own = lambda f, c: f(F.when(F.col("_touch"), F.col(f"o_{c}")))
    envelope = F.struct(*[own(F.min if c in ("x1", "y1") else F.max, c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    return _first_or_nearest(boxes, indicators, key, "indicator", vertical, F.when(F.count_if(F.col("_touch")) > 0, envelope))


def box_medians(boxes: DataFrame, lines: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """Each box's median line: the first that touches it, else the nearest aligned one."""
    line = F.struct(*[f"o_{c}" for c in ("x1", "y1", "x2", "y2")])
    return _first_or_nearest(boxes, lines, key, "line", vertical, F.min_by(F.when(F.col("_touch"), line), F.when(F.col("_touch"), F.col("line"))))


def box_outliers(boxes: DataFrame, points: DataFrame, key: list[str], vertical: Column, share: float = 0.4) -> DataFrame:
    """``box, point`` of the outliers whose centre is within ``share`` of a box's width of its centre; labels with a share of 0.5."""
    b, o = G.box(), G.box("o_")
    (bx, by), (ox, oy) = G.center(b), G.center(o)
    near = F.when(vertical, F.abs(ox - bx) < share * (b.x2 - b.x1)).otherwise(F.abs(oy - by) < share * (b.y2 - b.y1))
    return boxes.join(points, key).where(near).select(*key, "box", "point")


def typical_spacing(boxes: DataFrame, key: list[str], at: str) -> DataFrame:
    """``n, spacing, grouped``: the median gap of neighbouring centres, the least where gaps deviate by over half of it, 100 for a single box. Three boxes
    or more are grouped if the largest gap is over twice the least.
    """
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at))
    got = boxes.withColumn("_gap", gap).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.median("_gap").alias("mid"), F.min("_gap").alias("least"), F.max("_gap").alias("most"), F.stddev_pop("_gap").alias("vary")
    )
    uneven = (F.col("n") > 2) & (F.round(F.col("vary") - 0.5 * F.col("mid"), 9) > 0)
    spacing = F.when(F.col("n") < 2, 100.0).when(uneven, F.col("least")).otherwise(F.col("mid"))
    return got.select(*key, "n", spacing.alias("spacing"), F.col("mid").alias("median_gap"), ((F.col("n") >= 3) & (F.col("most") > 2 * F.col("least"))).alias("grouped"))


def box_tick_labels(boxes: DataFrame, labels: DataFrame, key: list[str], at: str, label_at: str) -> DataFrame:
    """Labels of each box, nearest first: ``box, rank, label, distance``.

    Grouped charts: boxes with gaps of at most 1.5 median gaps form clusters, each with the label nearest to its mean place. Other charts: all labels
    nearer than 0.35 of the typical spacing.
    """
    spaced = boxes.join(typical_spacing(boxes, key, at), key)
    order = Window.partitionBy(*key).orderBy(at, "box")
    opens = F.coalesce((F.col(at) - F.lag(at).over(order) > 1.5 * F.col("median_gap")).cast("int"), F.lit(0))
    clustered = spaced.where("grouped").withColumn("_o", opens).withColumn("cluster", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    centers = clustered.groupBy(*key, "cluster").agg(F.avg(at).alias("_center"))
    near = centers.join(labels, key).withColumn("distance", F.abs(F.col("_center") - F.col(label_at)))
    best = near.groupBy(*key, "cluster").agg(F.min_by(F.struct("label", "distance"), F.struct(F.round("distance", 9), "label")).alias("b"))
    of_cluster = clustered.select(*key, "box", "cluster").join(best, [*key, "cluster"]).select(*key, "box", F.lit(1).alias("rank"), "b.label", "b.distance")
    pairs = spaced.where("NOT grouped").join(labels, key).withColumn("distance", F.abs(F.col(at) - F.col(label_at))).where(F.col("distance") < 0.35 * F.col("spacing"))
    ranked = F.row_number().over(Window.partitionBy(*key, "box").orderBy(F.round("distance", 9), "label"))
    return of_cluster.unionByName(pairs.select(*key, "box", ranked.alias("rank"), "label", "distance"))


def grid_layout(boxes: DataFrame, key: list[str], at: str, tolerance: float = 0.1) -> DataFrame:
    """``is_grid, spacing, groups``: even gaps deviate by under ``tolerance`` of their median; gaps over two medians part groups."""
    w = Window.partitionBy(*key)
    gaps = boxes.withColumn("_gap", F.col(at) - F.lag(at).over(w.orderBy(at))).withColumn("_mid", F.median("_gap").over(w))
    wide = F.count_if((F.col("_gap") > 2 * F.col("_mid")) & (F.col("_mid") >= 1e-6))
    got = gaps.groupBy(*key).agg(F.first("_mid").alias("spacing"), F.stddev_pop("_gap").alias("vary"), (wide + 1).alias("groups"))
    even = F.coalesce((F.col("spacing") >= 1e-6) & (F.round(F.col("vary") / F.col("spacing"), 9) < tolerance), F.lit(False))
    return got.select(*key, even.alias("is_grid"), "spacing", "groups")


def grouping_score(box: G.Box, other: G.Box, vertical: Column, diagonal: Column, color: Column) -> Column:
    """0.4 of nearness, 0.4 of alignment (with a bonus for containment) and 0.2 of a given colour likeness."""
    (bx, by), (ox, oy) = G.center(box), G.center(other)
    nearness = 1 - F.least(F.lit(1.0), G.distance((bx, by), (ox, oy)) / (0.3 * diagonal))
    wide, off = F.when(vertical, box.x2 - box.x1).otherwise(box.y2 - box.y1), F.when(vertical, F.abs(ox - bx)).otherwise(F.abs(oy - by))
    inside = F.when(vertical, (other.x1 >= box.x1) & (other.x2 <= box.x2)).otherwise((other.y1 >= box.y1) & (other.y2 <= box.y2))
    aligned = F.when(wide > 0, 1 - F.least(F.lit(1.0), off / F.when(wide > 0, wide))).otherwise(0.5)
    return 0.4 * nearness + 0.4 * F.when(inside, F.least(F.lit(1.0), aligned + 0.2)).otherwise(aligned) + 0.2 * color


# --- slices and legends --------------------------------------------------------------------------------


def slice_labels(slices: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """``slice, label``: in the slices' order, each takes the nearest label that is still free. Both sides: number, ``x, y``."""
    gathered = lambda rows, n: rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(n, "x", "y"))).alias(f"_{n}s"))
    charts = gathered(slices, "slice").join(gathered(labels, "label"), key)

    def step(held: Column, s: Column) -> Column:
        away = lambda q: (q["x"] - s["x"]) * (q["x"] - s["x"]) + (q["y"] - s["y"]) * (q["y"] - s["y"])
        free = F.filter("_labels", lambda q: ~F.array_contains(held["used"], q["label"]))
        best = F.array_min(F.transform(free, lambda q: F.struct(F.round(away(q), 6).alias("d"), q["label"].alias("label"))))["label"]
        pair = F.array(F.struct(s["slice"].alias("slice"), best.alias("label")))
        return F.when(best.isNull(), held).otherwise(F.struct(F.concat(held["used"], F.array(best)).alias("used"), F.concat(held["out"], pair).alias("out")))

    a, b = dict(slices.dtypes)["slice"], dict(labels.dtypes)["label"]
    start = F.struct(F.array().cast(f"array<{b}>").alias("used"), F.array().cast(f"array<struct<slice:{a},label:{b}>>").alias("out"))
    return charts.select(*key, F.explode(F.aggregate("_slices", start, step)["out"]).alias("p")).select(*key, "p.slice", "p.label")


def legend_column(labels: DataFrame, key: list[str]) -> DataFrame:
    """Charts whose legend is one column: two labels or more whose centres deviate by under 10 pixels across."""
    got = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("vary"))
    return got.select(*key, ((F.col("n") >= 2) & (F.col("vary") < 10)).alias("is_column"))


def without_column(labels: DataFrame, key: list[str]) -> DataFrame:
    """Labels of the charts whose legend isn't one column."""
    whole = Window.partitionBy(*key)
    column = (F.count(F.lit(1)).over(whole) >= 2) & (F.stddev_pop("x").over(whole) < 10)
    return labels.withColumn("_column", column).where("NOT _column").drop("_column")


def legend_by_clock(slices: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """``slice, label`` of a one-column legend: its labels from the top, the slices clockwise from twelve (``angle`` in degrees); the shorter side ends it."""
    clock = F.pmod(F.col("angle") - 270, F.lit(360.0))
    left = slices.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(clock, "slice")))
    right = labels.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("y", "label")))
    return left.select(*key, "rank", "slice").join(right.select(*key, "rank", "label"), [*key, "rank"]).drop("rank")


def legend_nearest(slices: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """``slice, text`` of the nearest label, ``Unknown`` without any. Both sides: number, ``x, y``; labels have ``text``."""
    right = labels.where(F.col("text").isNotNull()).select(*key, "label", "text", F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = slices.join(right, key, "left").withColumn("_d", F.round(G.distance((F.col("x"), F.col("y")), (F.col("_x"), F.col("_y"))), 9))
    best = F.min_by("text", F.when(F.col("text").isNotNull(), F.struct("_d", "label")))
    return pairs.groupBy(*key, "slice").agg(F.coalesce(F.nullif(best, F.lit("")), F.lit("Unknown")).alias("text"))


# --- axes, documents -------------------------------------------------------------------------------------


def aligned_ticks(ticks: DataFrame, bars: DataFrame, key: list[str], at: str, bar_at: str, extent: float, share: float = 0.15) -> DataFrame:
    """Tick labels with a bar nearer than ``share`` of the image; all of a chart without bars. A chart's bars are gathered, so ticks aren't multiplied."""
    held = bars.groupBy(*key).agg(F.collect_list(bar_at).alias("_bars"))
    near = F.exists("_bars", lambda b: F.abs(F.col(at) - b) < share * extent)
    return ticks.join(held, key, "left").where(F.col("_bars").isNull() | near).drop("_bars")


def with_provenance(elements: DataFrame, assets: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Elements with their asset's ``columns``; null where the asset is unknown."""
    return elements.join(assets.select(*key, *columns), key, "left")


def resolved_pairs(samples: DataFrame, files: DataFrame, sample: str, wanted: str = "auto") -> DataFrame:
    """The files of each sample: ground truth (``_gt`` before ``_unified`` if ``wanted`` is ``auto``), baseline and candidate, null where missing.

    ``files``: ``root`` (``gt, baseline, candidate``) and ``name``.
    """
    if wanted not in ("auto", "gt_json", "unified_json"):
        raise ValueError("wanted must be auto, gt_json or unified_json")
    stem = F.regexp_extract("name", r"^(.*)_(gt|unified|analysis)\.json$", 1)
    kind = F.concat_ws("/", "root", F.regexp_extract("name", r"^(.*)_(gt|unified|analysis)\.json$", 2))
    found = files.select(stem.alias(sample), kind.alias("kind"), "name").where(F.col(sample) != "")
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("name")))
    wide = found.groupBy(sample).agg(of("gt/gt").alias("_gt"), of("gt/unified").alias("_unified"), of("baseline/analysis").alias("baseline"), of("candidate/analysis").alias("candidate"))
    unified = F.lit(wanted == "unified_json") | (F.lit(wanted == "auto") & F.col("_gt").isNull() & F.col("_unified").isNotNull())
    return samples.join(wide, sample, "left").select(
        *samples.columns, F.when(unified, "unified_json").otherwise("gt_json").alias("gt_format"), F.when(unified, F.col("_unified")).otherwise(F.col("_gt")).alias("gt"), "baseline", "candidate"
    )


def positional_errors(truth: DataFrame, found: DataFrame, key: list[str], pos: str, columns: list[str]) -> DataFrame:
    """Mean absolute errors of rows at the same place of two lists, per chart: of all ``columns`` and of each; the shorter list ends it."""
    right = found.select(*key, pos, *[F.col(c).alias(f"_{c}") for c in columns])
    errors = truth.select(*key, pos, *columns).join(right, [*key, pos]).select(*key, *[F.abs(F.col(c) - F.col(f"_{c}")).alias(c) for c in columns])
    total = [F.coalesce(F.sum(c), F.lit(0.0)) for c in columns]
    n = [F.count(c) for c in columns]
    return errors.groupBy(*key).agg((sum(total[1:], total[0]) / F.nullif(sum(n[1:], n[0]), F.lit(0))).alias("mae"), *[F.avg(c).alias(f"{c}_mae") for c in columns])
