"""Sinks: protocol CSV, detections, JSON documents, run manifests, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.operators.documents import GOLD
from abacist.operators.protocol import COLUMNS, filtered


def protocol_csv(rows: DataFrame, path: str, **equal: str | None) -> None:
    """The fixed columns, in order, with a header even without rows. Partitions write side by side."""
    filtered(rows, **equal).select(*COLUMNS).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def flat_detections(rows: DataFrame) -> DataFrame:
    """A row per detection of a map from class to detections; confidence: OCR's, else the detector's, else 0."""
    each = rows.select("image_file", F.explode("detections").alias("class_name", "list")).select("image_file", "class_name", F.posexplode("list").alias("idx", "d"))
    confidence = F.coalesce(F.col("d.ocr_confidence"), F.col("d.conf"), F.lit(0.0))
    edges = [F.get("d.xyxy", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return each.select("image_file", "class_name", "idx", *edges, F.coalesce("d.text", F.lit("")).alias("text"), confidence.alias("confidence"))


def json_documents(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON Lines; ``by`` makes a folder per value."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def text_summary(rows: DataFrame, path: str) -> None:
    line = F.format_string("%s page %s: %s, %s = %s %s", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_file", "page_index", "chart_type", "group", "value", "unit")])
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    writers = {"csv": lambda: rows.write.mode("overwrite").option("header", True).csv(path), "json": lambda: json_documents(rows, path),
               "txt": lambda: text_summary(rows, path), "protocol_csv": lambda: protocol_csv(rows, path)}
    if kind not in writers:
        raise ValueError(f"unknown export kind {kind}")
    writers[kind]()


def analysis_name(image: Column) -> Column:
    """The name of an image's analysis: its stem and ``_analysis.json``."""
    return F.concat(F.regexp_replace(F.regexp_extract(image, r"([^/\\\\]*)$", 1), r"\.[^.]*$", ""), F.lit("_analysis.json"))


def gold_csv(rows: DataFrame, path: str) -> None:
    """Gold rows with a header, in the order of their files; partitions are ranges of it."""
    rows.select(*GOLD).repartitionByRange("source_file").sortWithinPartitions("source_file").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report_document(report: DataFrame, by_type: DataFrame, kind: str) -> DataFrame:
    """One row: the validation report as a JSON document of alignment, metrics, gates and chart types. ``report``, ``by_type``: as ``align`` gives them."""
    limits = {"success_rate": 0.99, "accuracy": 0.95, "ccc": 0.90, "kappa": 0.81}
    gate = lambda c: F.struct(F.col(c).alias("observed"), F.lit(limits[c]).alias("threshold"), F.coalesce(F.col(c) >= limits[c], F.lit(False)).alias("pass"))
    types = by_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.struct("count", "accuracy", "ccc"))))).alias("per_chart_type"))  # a row per type
    nested = F.struct(
        F.struct("matched", "unmatched_gold", "unmatched_pred", "total").alias("alignment"), F.struct(*limits).alias("metrics"),
        F.struct(*[gate(c).alias(c) for c in limits]).alias("gates"), F.col("passed").alias("all_thresholds_met"), "per_chart_type",
    )
    one = F.lit(1).alias("_one")
    return report.select("*", one).join(types.select("*", one), "_one").select(F.to_json(nested, {"ignoreNullFields": "false"}).alias("report"))


def truth_documents(rows: DataFrame, path: str, compact: bool = False) -> None:
    """Ground truth as JSON Lines; ``compact`` leaves out what is null."""
    rows.write.mode("overwrite").option("ignoreNullFields", compact).json(path)


def run_manifest(rows: DataFrame, settings: dict[str, str], seconds: float | None = None) -> DataFrame:
    """One row: settings, the time of writing, the run's seconds, number of assets and rows, and the rows per asset as a JSON object."""
    per_asset = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    fixed = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]) if settings else F.create_map().cast("map<string,string>")
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_file", "rows"))))
    return per_asset.agg(F.count(F.lit(1)).alias("assets"), F.sum("rows").alias("rows"), F.to_json(counts).alias("rows_per_asset")).withColumns({
        "settings": fixed, "written_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "runtime_seconds": F.lit(seconds).cast("double")})


def subset(wanted: DataFrame, documents: DataFrame, key: str, path: str, missing: str = "skip") -> DataFrame:
    """Write the wanted documents over what the folder held; returns how many were written and skipped, by reason. ``missing``: ``skip`` or ``error``."""
    if missing not in ("skip", "error"):
        raise ValueError("missing must be skip or error")
    lost = wanted.join(documents.where(F.col("content").isNotNull()), key, "left_anti")
    if missing == "error" and not lost.isEmpty():
        raise ValueError(f"no document for {lost.first()[key]}")
    found = wanted.join(documents, key, "left").withColumn("reason", F.when(F.col("content").isNull(), "missing").otherwise("written"))
    found.where("reason = 'written'").select(key, "content").write.mode("overwrite").json(path)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
