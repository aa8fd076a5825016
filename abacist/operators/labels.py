"""Roles of axis labels: additive scores per role, parametrised by chart type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions import geometry as G

# Fixed values by chart type: threshold, kernel factor and width, small box, region bonuses, numeric bonuses, title bounds and bonuses.
PARAMETERS = {
    "bar":       {"least": 2.0, "kernel": 1.0, "sigma": 0.09, "small": (0.08, 0.04, 3.0), "left": (0.15, 6.0), "right": (0.85, 5.0), "bottom": (0.85, 5.5), "numeric": 3.0, "title": (0.15, 0.10, 4.0), "aspect": (5.0, 0.20, 3.5), "center": 3.0},
    "box":       {"least": 2.5, "kernel": 1.0, "sigma": 0.09, "small": (0.065, 0.038, 3.5), "left": (0.22, 5.0), "right": (0.78, 4.0), "bottom": (0.78, 5.0), "numeric": 2.5, "title": (0.13, 0.09, 5.0), "aspect": (6.5, 0.15, 4.5), "center": 2.0},
    "histogram": {"least": 2.0, "kernel": 1.0, "sigma": 0.11, "small": (0.09, 0.05, 4.0), "left": (0.22, 5.5), "right": (1.01, 0.0), "bottom": (0.78, 6.0), "numeric": 4.0, "title": (0.13, 0.08, 5.5), "aspect": (6.0, 0.16, 5.0), "center": 2.0},
    "line":      {"least": 2.5, "kernel": 1.2, "sigma": 0.09, "small": (0.07, 0.035, 4.0), "left": (0.20, 6.5), "right": (0.80, 5.0), "bottom": (0.85, 6.0), "numeric": 4.0, "title": (0.12, 0.08, 5.0), "aspect": (6.0, 0.16, 4.0), "center": 2.0},
    "scatter":   {"least": 3.0, "kernel": 1.5, "sigma": 0.09, "small": (0.075, 0.04, 5.0), "left": (0.25, 7.0), "right": (0.75, 6.0), "bottom": (0.75, 6.5), "numeric": 7.0, "title": (0.14, 0.09, 6.0), "aspect": (7.0, 0.14, 5.0), "center": 0.0},
}
# Weights of the region kernels.
LEFT, RIGHT, BOTTOM, TOP = 5.0, 4.0, 5.0, 4.0


def kernels(nx: Column, ny: Column, sigma: float) -> dict[str, Column]:
    """Gaussian scores around the usual places of axes and title, and the penalty of the middle."""
    bell = lambda cx, cy, w, where: F.when(where, w * F.exp(-((nx - cx) * (nx - cx) + (ny - cy) * (ny - cy)) / (2 * sigma * sigma))).otherwise(0.0)  # noqa: E731,E501
    tall, wide = (ny > 0.1) & (ny < 0.9), (nx > 0.15) & (nx < 0.85)
    middle = (nx > 0.2) & (nx < 0.8) & (ny > 0.2) & (ny < 0.8)
    off = (nx - 0.5) * (nx - 0.5) + (ny - 0.5) * (ny - 0.5)
    return {
        "left": bell(0.08, 0.5, LEFT, (nx < 0.2) & tall), "right": bell(0.92, 0.5, RIGHT, (nx > 0.8) & tall),
        "bottom": bell(0.5, 0.92, BOTTOM, wide & (ny > 0.8)), "top": bell(0.5, 0.08, TOP, wide & (ny < 0.15)),
        "center": F.when(middle, F.exp(-off / 0.08)).otherwise(0.0),
    }


def scores(kind: str, nx: Column, ny: Column, w: Column, h: Column, numeric: Column, vertical: Column, alignment: Column | None = None) -> dict[str, Column]:
    """Scores of the roles scale, tick and title for labels of one chart type; ``alignment``: how well a label of a bar or box chart meets an element."""
    p = PARAMETERS[kind]
    k = {n: c * p["kernel"] for n, c in kernels(nx, ny, p["sigma"]).items()}
    add = lambda condition, value: F.when(condition, value).otherwise(0.0)
    aspect, edge = w / (h + 1e-6), F.least(nx, 1 - nx, ny, 1 - ny)
    in_region = add(vertical & (nx < p["left"][0]), p["left"][1]) + add(vertical & (nx > p["right"][0]), p["right"][1]) + add(~vertical & (ny > p["bottom"][0]), p["bottom"][1])
    scale = k["left"] + k["right"] + add((w < p["small"][0]) & (h < p["small"][1]), p["small"][2]) + in_region
    scale = scale + add(numeric, p["numeric"]) + 2 * F.greatest((0.2 - edge) / 0.2, F.lit(0.0)) - p["center"] * k["center"]
    tick = k["bottom"] * (6.0 / BOTTOM if kind == "bar" else 1.0) + add(vertical & (ny > 0.75), 7.0) + add(~vertical & (nx < 0.25), 6.5) + add(~numeric, 2.0) - 0.5 * p["center"] * k["center"]
    if alignment is not None and kind in ("bar", "box"):
        tick = tick + (5.0 * alignment if kind == "bar" else 4.0 * alignment + add(alignment > 0.6, 3.0))
    title = k["top"] + add((w > p["title"][0]) | (h > p["title"][1]), p["title"][2]) + add((aspect > p["aspect"][0]) | (aspect < p["aspect"][1]), p["aspect"][2])
    if kind in ("line", "scatter", "histogram"):
        tick = add(~numeric & (ny > 0.7), 1.0) if kind == "line" else add(~numeric & (ny > 0.8), 2.0) if kind == "histogram" else F.lit(0.0)
        title = title + add(~numeric, 2.0)
    return {"scale": scale, "tick": tick, "title": title}


def alignment(labels: DataFrame, elements: DataFrame, key: list[str], at: str, element_at: str) -> DataFrame:
    """Labels with ``alignment``: 1 within half a mean spacing of the nearest element's centre, 0.5 within a whole one, else 0. A chart's elements are gathered."""
    held = elements.groupBy(*key).agg(F.collect_list(element_at).alias("_e"), ((F.max(element_at) - F.min(element_at)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("_gap"))
    near = F.array_min(F.transform("_e", lambda e: F.abs(F.col(at) - e)))
    score = F.when(near < 0.5 * F.col("_gap"), 1.0).when(near < F.col("_gap"), 0.5).otherwise(0.0)
    return labels.join(held, key, "left").withColumn("alignment", score).drop("_e", "_gap")


def roles(labels: DataFrame, kind: str) -> DataFrame:
    """``role`` and ``margin`` of labels (``nx, ny, w, h, numeric, vertical``, and ``alignment`` and ``below`` (the boxes) where known): the best score
    above the threshold, else by place; then bar, box and histogram labels whose place contradicts their role change it.
    """
    given = F.col("alignment") if "alignment" in labels.columns else None
    found = scores(kind, *[F.col(c) for c in ("nx", "ny", "w", "h", "numeric", "vertical")], given)
    out = labels.withColumns({f"score_{r}": F.round(c, 9) for r, c in found.items()})
    s = {r: F.col(f"score_{r}") for r in found}
    best = F.greatest(*s.values())
    ranked = F.array_sort(F.array(*s.values()))
    out = out.withColumn("margin", ranked[2] - ranked[1])
    p = PARAMETERS[kind]
    unclear = 1.3 if kind == "box" else 1.25
    limit = F.when(F.col("margin") < 0.5, p["least"] * unclear).when(F.col("margin") > 2, p["least"] * 0.9).otherwise(p["least"]) if kind in ("bar", "box", "histogram") else F.lit(p["least"])
    ny, numeric = F.col("ny"), F.col("numeric")
    edge = F.least(F.col("nx"), 1 - F.col("nx"), ny, 1 - ny)
    below = F.col("below") if "below" in labels.columns else F.lit(False)
    small = (F.col("w") < p["small"][0]) & (F.col("h") < p["small"][1])
    rest = "title" if kind == "histogram" else "tick"
    by_place = F.when(edge < 0.15, "scale").when(edge > 0.3, rest).when(small | numeric, "scale").otherwise(rest)
    if kind == "box":
        by_place = F.when(below | (ny > 0.82), "tick").otherwise(by_place)
    if kind in ("line", "scatter"):
        by_place = F.when(numeric, "scale").otherwise("title")
    chosen = F.when(s["scale"] == best, "scale").when(s["tick"] == best, "tick").otherwise("title")
    role = F.when(best > limit, chosen).otherwise(by_place)
    if kind in ("bar", "box", "histogram"):
        at_edge = ~below & ((edge < 0.1) | ((ny > 0.8) & (edge < 0.25))) if kind == "box" else edge < 0.1
        role = F.when((role == "scale") & (edge >= 0.25), rest).when((role == "tick") & at_edge, "scale").otherwise(role)
    return out.withColumn("role", role)


def axis_of_scale(nx: Column, ny: Column) -> Column:
    """Line charts: which axis a scale label belongs to."""
    return F.when(ny > 0.75, "x").when((nx < 0.25) | (nx > 0.75), "y").when(ny > nx, "x").otherwise("y")


def element_context(elements: DataFrame, key: list[str], kind: Column, vertical: Column) -> DataFrame:
    """What label scores need of a chart's elements: extent with 2 % of padding, mean spacing, median box sizes and point density, by type.

    ``elements``: ``x1, y1, x2, y2``; ``kind`` and ``vertical`` are of the chart.
    """
    b = G.box()
    cx, cy = G.center(b)
    got = elements.withColumns({"_x": cx, "_y": cy, "_k": kind, "_v": vertical}).groupBy(*key).agg(
        F.count(F.lit(1)).alias("num_elements"), F.min("_x").alias("l"), F.max("_x").alias("r"), F.min("_y").alias("t"), F.max("_y").alias("b"),
        F.median(b.x2 - b.x1).alias("mw"), F.median(b.y2 - b.y1).alias("mh"), F.first("_k").alias("k"), F.first("_v").alias("v"),
    )
    wide, high = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    spacing = F.when(F.col("num_elements") > 1, F.when(F.col("v"), wide).otherwise(high) / (F.col("num_elements") - 1)).otherwise(0.0)
    area = 1.04 * wide * 1.04 * high
    dense = F.when(F.col("k").isin("scatter", "line", "histogram") & (wide > 0) & (high > 0), F.col("num_elements") / F.greatest(area, F.lit(1.0))).otherwise(0.0)
    boxed = lambda c: F.when(F.col("k") == "box", F.col(c)).otherwise(0.0)
    return got.select(
        *key, "num_elements", (F.col("l") - 0.02 * wide).alias("left"), (F.col("t") - 0.02 * high).alias("top"), (F.col("r") + 0.02 * wide).alias("right"), (F.col("b") + 0.02 * high).alias("bottom"),
        spacing.alias("avg_spacing"), wide.alias("x_spread"), high.alias("y_spread"), boxed("mw").alias("median_box_width"), boxed("mh").alias("median_box_height"), dense.alias("point_density"),
    )


def dispatched(labels: DataFrame, kind: str, confidence: str) -> DataFrame:
    """Roles by each row's chart type: types in doubt (under 0.7) or without a scorer take the bar's."""
    known = F.when((F.col(confidence) >= 0.7) & F.col(kind).isin(*PARAMETERS), F.col(kind)).otherwise("bar")
    rows = labels.withColumn("scorer", known)
    parts = [roles(rows.where(F.col("scorer") == k), k) for k in PARAMETERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def axes_of_scatter(labels: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """``axis`` (x, y or null) of scatter scale labels (``label, cx, cy``).

    The row (of a twentieth of the image) with most labels, at least two, is the x axis's, the lowest of equals; the leftmost such column the y axis's.
    Labels left over go to the axis within a twentieth of the height, the nearer one, else by the bottom quarter and the left fifth.
    """
    whole = Window.partitionBy(*key)

    def line_score(at: str, size: float, last: bool) -> Column:
        line = Window.partitionBy(*key, F.floor(F.col(at) / (size * 0.05)))
        n, mean = F.count(F.lit(1)).over(line), F.avg(at).over(line)
        return F.when(n >= 2, F.struct(n.alias("n"), F.round(mean if last else -mean, 9).alias("at"), F.floor(F.col(at) / (size * 0.05)).alias("line")))

    marked = labels.withColumns({"_row": line_score("cy", height, True), "_column": line_score("cx", width, False)})
    marked = marked.withColumns({"_best_row": F.max("_row").over(whole), "_best_column": F.max("_column").over(whole)})
    in_row, in_column = (F.coalesce(F.col(c) == F.col(b), F.lit(False)) for c, b in (("_row", "_best_row"), ("_column", "_best_column")))
    to_x = F.coalesce(F.abs(F.col("cy") - F.col("_best_row.at")), F.lit(9999.0))
    to_y = F.coalesce(F.abs(F.col("cx") + F.col("_best_column.at")), F.lit(9999.0))
    near = 0.05 * height
    rest = F.when((to_x < near) & (to_x < to_y), "x").when(to_y < near, "y").when(F.col("cy") / height > 0.75, "x").when(F.col("cx") / width < 0.2, "y")
    axis = F.when(in_row, "x").when(in_column, "y").otherwise(rest)
    return marked.withColumn("axis", axis).drop("_row", "_column", "_best_row", "_best_column")


def heatmap_roles(labels: DataFrame) -> DataFrame:
    """``role`` of heatmap labels: ``x1, y1, x2, y2``, image ``width, height``, and the grid's bounds ``left, top, right, bottom``.

    Scale labels share area with a region beside the grid or lie in an axis's usual place; titles in the top one. Below the threshold both are
    scored again as in an image of 1000 x 1000. Scores also hold ``role_score``.
    """
    b = G.box()
    cx, cy = G.center(b)
    left, top, right, bottom = (F.col(c) for c in ("left", "top", "right", "bottom"))
    zero = F.lit(0.0)
    beside = [G.Box(zero, top, left, bottom), G.Box(right, top, 2 * right, bottom)]
    over = [G.Box(left, bottom, right, 2 * bottom), G.Box(left, zero, right, top)]
    shared = lambda regions: G.iou(b, regions[0]) + G.iou(b, regions[1])
    regional = 6.0 * shared(beside) + 6.0 * shared(over)

    def scored(width: Column, height: Column) -> tuple[Column, Column]:
        k = kernels(cx / width, cy / height, 0.05)
        scale = regional + k["left"] * (6.0 / LEFT) + k["right"] * (3.0 / RIGHT) + k["bottom"] * (6.0 / BOTTOM) - 3.0 * k["center"]
        return scale, k["top"] * (4.0 / TOP)

    scale, title = scored(F.col("width"), F.col("height"))
    again_scale, again_title = scored(F.lit(1000.0), F.lit(1000.0))
    best = F.greatest(scale, zero, title)
    role = F.when(best > 1.8, F.when(scale == best, "scale").otherwise("title")).when(again_scale > again_title, "scale").otherwise("title")
    return labels.withColumn("role", role).withColumn("role_score", best)


def axis_of_heatmap(cx: Column, cy: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Beside the grid's rows: ``y``; above or below its columns: ``x``; else by the nearer edge."""
    beside, over = cy.between(top, bottom), cx.between(left, right)
    to_side, to_end = F.least(F.abs(cx - left), F.abs(cx - right)), F.least(F.abs(cy - top), F.abs(cy - bottom))
    return F.when(beside & ~over, "y").when(over & ~beside, "x").when(to_side < to_end, "y").otherwise("x")


def pie_role(text: Column, cluster: Column, distance: Column, radius: Column) -> Column:
    """``data_label`` for percentages, numbers and lone labels (cluster -1) and those near the pie; ``legend`` for other clustered ones; null without text."""
    number = text.rlike(r"\d+%") | F.trim(text).rlike(r"^\d+(\.\d+)?$")
    legend = ~number & (cluster != -1) & (distance > 1.2 * radius)
    return F.when(text.isNotNull() & (text != ""), F.when(legend, "legend").otherwise("data_label"))
