"""Protocol rows: projection of elements, filters, context merge, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.functions.text import blank_to_null

COLUMNS = ["source_file", "page_index", "chart_type", "series_id", "group", "outcome", "value", "unit", "error_bar_type",
           "error_bar_value", "baseline_value", "confidence", "review_status", "notes"]


def value_ladder(*candidates: Column) -> Column:
    """The first candidate that is a number."""
    return F.coalesce(*[c.try_cast("double") for c in candidates])


def is_synthetic(element: Column) -> Column:
    """Summary elements, and those without any box."""
    return F.coalesce(element["type"] == "summary", F.lit(False)) | (element["bbox"].isNull() & element["xyxy"].isNull())


def outcome(outcomes: Column, titles: Column) -> Column:
    """First outcome that contains a title or is in one, ignoring case; with titles, a single outcome matches anyway."""
    fits = lambda o: F.exists(titles, lambda t: F.lower(t).contains(F.lower(o)) | F.lower(o).contains(F.lower(t)))
    named = F.coalesce(F.size(titles), F.lit(0)) > 0
    only = F.when(named & (F.size(outcomes) == 1), outcomes[0])
    return F.coalesce(F.when(named, F.get(F.filter(outcomes, fits), F.lit(0))), only, F.lit(""))


def group_label(*candidates: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(""))


def titles(*sources: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(s, empty) for s in sources]))


def first_baseline(baselines: Column) -> Column:
    return F.get(F.filter(F.transform(baselines, lambda b: b["value"]), lambda v: v.isNotNull()), F.lit(0))


def project(results: DataFrame, context: dict | None = None) -> DataFrame:
    """A row per real element of pipeline results (``source_file, page_index, chart_type, elements, baselines, titles``)."""
    context = context or {}
    outcomes = F.array(*[F.lit(o) for o in context.get("outcomes", [])]).cast("array<string>")
    units = context.get("units", {})
    rows = results.select("*", F.posexplode("elements").alias("element_index", "e")).where(~is_synthetic(F.col("e")))
    e = F.col("e")
    chosen = outcome(outcomes, F.col("titles"))
    unit = F.lit("")
    for name, u in units.items():
        unit = F.when(F.col("outcome") == name, u).otherwise(unit)
    rows = rows.withColumn("outcome", chosen).select(
        "source_file", "page_index", "chart_type", "element_index",
        F.when(F.col("chart_type") == "scatter", e["x"].cast("string")).otherwise(F.coalesce(e["text_label"], F.lit(""))).alias("series_id"),
        group_label(e["tick_label"]["text"], e["bar_label"], e["label"]).alias("group"), "outcome",
        value_ladder(e["value"], e["estimated_value"], e["y"]).alias("value"), unit.alias("unit"),
        F.lit(context.get("error_bar_type", "")).alias("error_bar_type"), e["error_bar"]["margin"].alias("error_bar_value"),
        first_baseline(F.col("baselines")).alias("baseline_value"), e["confidence"].alias("confidence"),
        F.lit("auto").alias("review_status"), F.lit("").alias("notes"),
    )
    return rows


def filtered(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters; None and ``All`` don't filter."""
    for name, wanted in equal.items():
        if wanted not in (None, "", "All"):
            rows = rows.where(F.col(name) == wanted)
    return rows


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


def context_merge(fresh: DataFrame, held: DataFrame, key: list[str], filled: list[str], edited: Column) -> DataFrame:
    """Held rows that aren't edited give way to fresh ones; edited ones stay, their empty ``filled`` columns taken from fresh ones."""
    h = held.withColumn("_edited", edited)
    f = fresh.select(*key, *[F.col(c).alias(f"_{c}") for c in held.columns if c not in key], F.lit(True).alias("_fresh"))
    both = h.join(f, key, "full_outer")
    keep = F.coalesce(F.col("_edited"), F.lit(False)) | F.col("_fresh").isNull()
    value = lambda c: F.when(keep, F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")) if c in filled else F.col(c)).otherwise(F.col(f"_{c}"))  # noqa: E731,E501
    return both.select(*[F.col(c) if c in key else value(c).alias(c) for c in held.columns])


def apply_edits(rows: DataFrame, edits: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The last edit (``edit_no``) of each key and field wins; ``edits``: key, ``field``, ``new_value``, ``edit_no``."""
    last = edits.groupBy(*key).pivot("field", fields).agg(F.max_by("new_value", "edit_no"))
    named = last.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    changed = F.coalesce(*[F.col(f"_{f}") for f in fields]).isNotNull()
    joined = rows.join(named, key, "left").withColumn("is_edited", changed)
    kinds = dict(rows.dtypes)
    return joined.select(*[F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns], "is_edited")


def page(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Rows numbered and dealt to pages, within each source file."""
    n = F.row_number().over(Window.partitionBy("source_file").orderBy(*order))
    return rows.withColumn("row_no", n).withColumn("page", F.ceil(n / size).cast("int"))


def pagination(rows: DataFrame, key: list[str], kind: str, size: int = 100) -> DataFrame:
    """``total_rows, total_pages, enabled`` per chart: only heatmaps of more than a page are paged."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total_rows"), F.first(kind).alias("_kind"))
    pages = F.greatest(F.ceil(F.col("total_rows") / size), F.lit(1)).cast("int")
    return counted.select(*key, "total_rows", pages.alias("total_pages"), ((F.col("_kind") == "heatmap") & (F.col("total_rows") > size)).alias("enabled"))
