"""Nested chart documents: ground truth of generators, benchmark projections, rows of the review tab, class names, and orchestration by chart type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions.scalars import CHART_TYPES, chart_type

# Names of the detectors' classes by chart type, in the order of their numbers.
_MARKS = "chart data_point axis_title significance_marker error_bar legend chart_title data_label axis_labels"
CLASSES = {
    "bar": "chart bar axis_title significance_marker error_bar legend chart_title data_label axis_labels",
    "box": "chart box axis_title significance_marker range_indicator legend chart_title median_line axis_labels outlier",
    "line": _MARKS, "scatter": _MARKS, "area": _MARKS,
    "histogram": "chart bar axis_title legend chart_title data_label axis_labels",
    "heatmap": "chart cell axis_title color_bar legend chart_title data_label axis_labels significance_marker",
    "pie": "slice",
}
# Characters that text recognition may return, by kind of label.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WHITELISTS = {"scale_label": "0123456789.,-eE+%", "tick_label": _LETTERS + " -_/", "axis_title": _LETTERS + " -_()$%", "data_label": "0123456789.,-+%"}


def class_name(kind: Column, class_id: Column) -> Column:
    """A detection's class name; types without a list take the bar's, numbers outside it are ``unknown``."""
    lists = reduce(lambda out, k: F.when(kind == k, F.array(*[F.lit(c) for c in CLASSES[k].split()])).otherwise(out), CLASSES, F.array(*[F.lit(c) for c in CLASSES["bar"].split()]))
    return F.coalesce(F.get(lists, class_id.cast("int")), F.lit("unknown"))


def whitelist(label: Column, overrides: Column | None = None) -> Column:
    """The characters allowed for a kind of label: of the settings' map ``overrides``, else the default; null for no restriction."""
    default = reduce(lambda out, k: F.when(label == k, WHITELISTS[k]).otherwise(out), WHITELISTS, F.lit(None).cast("string"))
    return F.coalesce(F.try_element_at(overrides, label), default) if overrides is not None else default


def calibration_points(labels: DataFrame, key: list[str], vertical: Column) -> DataFrame:
    """``at, value, weight`` of scale labels (``xyxy``, ``cleaned``, ``text``, ``confidence``): the middle of the box, the cleaned value or the
    text's first number; the confidence within 0 and 1, 0.8 if missing. Labels without a finite value go.
    """
    b = F.col("xyxy")
    usable = F.coalesce(F.size(b) >= 4, F.lit(False))
    at = F.when(vertical, (F.get(b, F.lit(1)) + F.get(b, F.lit(3))) / 2).otherwise((F.get(b, F.lit(0)) + F.get(b, F.lit(2))) / 2)
    number = F.regexp_extract(F.regexp_replace(F.regexp_replace(F.trim("text"), " ", ""), ",", "."), r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0)
    value = F.coalesce(F.col("cleaned").cast("double"), F.nullif(number, F.lit("")).try_cast("double"))
    weight = F.least(F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)), F.lit(0.0)), F.lit(1.0))
    points = labels.where(usable).select(*key, at.alias("at"), value.alias("value"), weight.alias("weight"))
    return points.where(F.col("at").isNotNull() & (F.abs("value") < float("inf")) & ~F.isnan("value"))


# --- ground truth of generators ------------------------------------------------------------------------


def bar_values(bars: Column) -> Column:
    """``value, x_position`` of bars: their top, else their height, else 0."""
    value = lambda b: F.coalesce(b["top"], b["height"], F.lit(0.0))
    return F.transform(F.filter(bars, lambda b: b.isNotNull()), lambda b: F.struct(value(b).alias("value"), b["center"].alias("x_position")))


def histogram_bins(bars: Column) -> Column:
    """``bin_index, frequency, left_edge, right_edge`` of bins: their height, else their top, else 0; edges null without centre or width."""
    def row(b: Column, i: Column) -> Column:
        half = b["width"] / 2
        return F.struct(i.alias("bin_index"), F.coalesce(b["height"], b["top"], F.lit(0.0)).alias("frequency"), (b["center"] - half).alias("left_edge"), (b["center"] + half).alias("right_edge"))

    return F.transform(bars, row)


def data_points(series: Column) -> Column:
    """The points of all series with both numbers."""
    return F.filter(F.flatten(F.transform(series, lambda s: F.coalesce(s["points"], F.array().cast("array<struct<x:double,y:double>>")))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def box_statistics(boxes: Column) -> Column:
    """``q1, median, q3`` under any of their names; incomplete boxes go."""
    of = lambda b, *names: F.coalesce(*[b[n] for n in names])
    rows = F.transform(boxes, lambda b: F.struct(
        of(b, "q1", "quartile_1", "lower_quartile").alias("q1"), of(b, "median", "median_value", "q2").alias("median"), of(b, "q3", "quartile_3", "upper_quartile").alias("q3")))
    return F.filter(rows, lambda b: b["q1"].isNotNull() & b["median"].isNotNull() & b["q3"].isNotNull())


def annotations(items: Column) -> Column:
    """Annotations as detections of confidence 1, class numbers as integers where they are."""
    return F.transform(F.filter(items, lambda a: a.isNotNull()), lambda a: F.struct(
        a["bbox"].alias("bbox"), a["text"].alias("text"), F.lit(1.0).alias("confidence"), a["class_id"].try_cast("int").alias("class_id"), a["class_name"].alias("class_name")))


def axis_calibration(info: Column) -> Column:
    """Limits and scale of both axes; linear scales and a primary y axis where nothing is said."""
    axis = lambda a: F.struct(info[f"{a}_min"].alias("min"), info[f"{a}_max"].alias("max"), F.coalesce(info[f"{a}_scale"], F.lit("linear")).alias("scale"))
    primary = F.coalesce(info["primary_scale_axis"], F.lit("y"))
    return F.struct(axis("x").alias("x_axis"), axis("y").alias("y_axis"), primary.alias("primary_scale_axis"), info["secondary_scale_axis"].alias("secondary_scale_axis"))


def truth_document(charts: DataFrame) -> DataFrame:
    """``path, chart_type, axis_calibration`` of generated charts and what their type has: ``bar_values, boxplot_statistics, data_points, histogram_bins``; null
    for other types. ``charts``: ``path, chart_type, scale_info, bars, boxes, series``.
    """
    kind = F.coalesce("chart_type", F.lit("unknown"))
    only = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    return charts.select(
        "path", kind.alias("chart_type"), axis_calibration(F.col("scale_info")).alias("axis_calibration"), only(bar_values(F.col("bars")), "bar").alias("bar_values"),
        only(box_statistics(F.col("boxes")), "box").alias("boxplot_statistics"), only(data_points(F.col("series")), "line", "scatter", "area").alias("data_points"),
        only(histogram_bins(F.col("bars")), "histogram").alias("histogram_bins"),
    )


GOLD = ["source_file", "page_index", "chart_type", "group", "outcome", "value", "unit", "error_bar_type"]


def gold_rows(charts: DataFrame) -> DataFrame:
    """Gold rows of generated charts, in the protocol's columns, ordered by file and element.

    ``charts``: ``path`` (``*_detailed.json``), ``chart_type, error_bar_type, unit, outcome_label, y_label`` and ``elements`` (``name, column, value``), those of
    its type. Bars and boxes without a name are ``Group``, lines, scatters and areas ``Series``, slices ``Slice``, bins ``Bin``; a heatmap cell's outcome is its
    column. Boxes have ``IQR`` as error bar, pies, heatmaps and histograms none.
    """
    kind = F.coalesce("chart_type", F.lit("bar"))
    e = F.col("e")
    default = F.when(kind.isin("line", "scatter", "area"), "Series").when(kind == "pie", "Slice").when(kind == "heatmap", "Row").when(kind == "histogram", "Bin").otherwise("Group")
    outcome = F.when(kind == "heatmap", F.coalesce(e["column"], F.lit("Col"))).otherwise(F.coalesce("outcome_label", "y_label", F.lit("Value")))
    bars = F.when(kind == "box", "IQR").when(kind.isin("pie", "heatmap", "histogram"), "").otherwise(F.coalesce("error_bar_type", F.lit("SD")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\.json$", 1), "_detailed", "")
    rows = charts.where(kind.isin(*CHART_TYPES)).select("*", F.posexplode("elements").alias("_i", "e"))
    return rows.select(
        F.concat(stem, F.lit(".png")).alias("source_file"), F.lit(0).alias("page_index"), kind.alias("chart_type"), F.coalesce(e["name"], default).alias("group"),
        outcome.alias("outcome"), F.coalesce(e["value"].cast("string"), F.lit("")).alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), bars.alias("error_bar_type"), F.col("_i").alias("element"),
    ).orderBy("source_file", "element").drop("element")


# --- the review tab -------------------------------------------------------------------------------------

# Columns of the tab by chart type; editable ones are marked.
TAB = {
    "bar": "label* value* confidence pixel_size* error_bar*", "histogram": "label* value* confidence pixel_size* error_bar*", "pie": "label* value* percent* angle* confidence",
    "line": "index value* position* confidence", "scatter": "index x* y* center_x center_y confidence", "box": "label* whisker_low* q1* median* q3* whisker_high* outliers*",
    "heatmap": "row col row_label* col_label* value* confidence", "area": "kind index position* value* confidence auc num_points", "": "index value* confidence",
}


def tab_columns(kind: str) -> list[tuple[str, bool]]:
    """Names of the tab's columns and whether they can be edited; unknown types have three."""
    return [(c.rstrip("*"), c.endswith("*")) for c in TAB.get(kind, TAB[""]).split()]


def tab_rows(elements: DataFrame, key: list[str], kind: str, index: str) -> DataFrame:
    """Rows of one chart type's tab from element columns of the same names; missing columns are null.

    Labels: ``bar_label``, the tick's text, ``text_label``, the first that isn't blank. Values: ``value``, else ``estimated_value``. A pie's percent is its
    value in hundredths, 0 for a missing one; summaries (types ending in ``_summary``) can't be edited.
    """
    has = lambda c: F.col(c) if c in elements.columns else F.lit(None).cast("double")
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in elements.columns else F.lit(None).cast("string")
    value = F.coalesce(has("value"), has("estimated_value"))
    share = F.coalesce(has("value"), F.lit(0.0))
    summary = F.coalesce(F.col("type").endswith("_summary"), F.lit(False)) if "type" in elements.columns else F.lit(False)
    made = {
        "label": F.coalesce(text("bar_label"), text("tick_text"), text("text_label"), text("label"), F.lit("")), "value": share if kind == "pie" else value, "percent": share * 100,
        "index": F.col(index), "kind": F.when(summary, "summary").otherwise("point"), "row_label": F.coalesce(text("row_label"), F.lit("")), "col_label": F.coalesce(text("col_label"), F.lit("")),
        "outliers": F.array_join(F.transform("outliers", lambda o: F.regexp_replace(F.format_string("%.4g", o), r"(\.\d*?)0+$", "$1")), ", ") if "outliers" in elements.columns else F.lit(""),
    }
    columns = tab_columns(kind)
    editable = F.array(*[F.lit(c) for c, e in columns if e])
    return elements.select(*key, *[made.get(c, has(c)).alias(c) for c, _ in columns], F.when(summary, F.array().cast("array<string>")).otherwise(editable).alias("editable"))


# --- orchestration -----------------------------------------------------------------------------------------

Handler = Callable[[DataFrame], DataFrame]


def dispatched(charts: DataFrame, kind: str, handlers: dict[str, Handler]) -> DataFrame:
    """The handlers' rows, each for the charts of its (normalised) type; charts of types without a handler come back with an ``error``.

    Handlers keep their input's key columns. Every branch is a filter on the same plan, so unused types cost nothing.
    """
    typed = charts.withColumn(kind, chart_type(F.col(kind)))
    parts = [handler(typed.where(F.col(kind) == k)).withColumn("error", F.lit(None).cast("string")) for k, handler in handlers.items()]
    parts.append(typed.where(~F.col(kind).isin(*handlers)).withColumn("error", F.concat(F.lit("Unsupported chart type: "), F.col(kind))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def detected_types(detections: DataFrame, key: list[str], kind: str) -> DataFrame:
    """A chart row per image and type that has detections, in the handlers' order: images with several types are handled once for each."""
    place = F.array_position(F.array(*[F.lit(k) for k in CHART_TYPES]), F.col(kind))
    found = detections.where(F.col(kind).isin(*CHART_TYPES)).groupBy(*key, kind).agg(F.count(F.lit(1)).alias("detections"))
    return found.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(place)))


def hybrid(standard: DataFrame, override: DataFrame, key: list[str], r2: str) -> DataFrame:
    """Standard elements; charts without a calibration (``r2`` null or under 0.15) take those of ``override`` where it has any, marked ``vlm_override``."""
    doubtful = standard.groupBy(*key).agg(F.first(r2).alias("_r2")).where("_r2 IS NULL OR _r2 < 0.15").select(*key)
    taken = override.join(doubtful, key, "left_semi")
    kept = standard.join(taken.select(*key).distinct(), key, "left_anti").withColumn("value_source", F.lit("standard"))
    return kept.unionByName(taken.withColumn("value_source", F.lit("vlm_override")), allowMissingColumns=True)


def compared_methods(summaries: DataFrame) -> DataFrame:
    """Calibration methods by ``value_mae``, the best first and marked; missing errors count as infinite, missing rates as 0."""
    filled = summaries.fillna(float("inf"), ["value_mae"]).fillna(0.0, ["detection_f1", "relaxed_accuracy"]).fillna(100.0, ["relative_error_pct"])
    best = F.row_number().over(Window.orderBy("value_mae", "method")) == 1  # a row per method
    return filled.withColumn("recommended", best).orderBy("value_mae", "method")


def type_statistics(results: DataFrame, kind: str, seconds: str, confidence: str) -> DataFrame:
    """Count, total and mean time and mean confidence by type."""
    return results.groupBy(kind).agg(F.count(F.lit(1)).alias("count"), F.sum(seconds).alias("total_time"), F.avg(seconds).alias("avg_time"), F.avg(confidence).alias("avg_confidence"))
