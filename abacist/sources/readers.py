"""Scans: assets, CSV and JSON documents, manifests, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Image suffixes, and the list keys of manifests and id keys of their records, in order.
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
LIST_KEYS = ("records", "samples", "items", "data", "examples", "questions")
ID_KEYS = ("sample_id", "id", "imgname", "image", "image_path")
PROTOCOL_REQUIRED = ("source_file", "chart_type", "group", "outcome", "value")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def likely_figure(width: Column, height: Column, text_parts: Column, lines: Column) -> Column:
    """Whether an image may be a chart: sides from 0.3 up to 4 to 1, three text-like parts, two straight lines; true where these weren't counted."""
    ratio = width / F.when(height != 0, height)
    return F.coalesce((ratio > 0.3) & (ratio < 4.0) & (text_parts >= 3) & (lines >= 2), ~F.coalesce((ratio <= 0.3) | (ratio >= 4.0), F.lit(False)))


def assets(spark: SparkSession, folder: str, kind: str = "auto") -> DataFrame:
    """``path, kind, bytes`` of a folder's (or one) image and PDF files, images first, by name; a missing path has none. Contents aren't read."""
    wanted = {"auto": (*IMAGES, "pdf"), "image": IMAGES, "pdf": ("pdf",)}[kind]
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, bytes long, kind string")
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    typed = files.withColumn("kind", F.when(suffix(F.col("path")) == "pdf", "pdf").otherwise("image"))
    return typed.where(suffix(F.col("path")).isin(*wanted)).orderBy((F.col("kind") == "pdf").cast("int"), "path")


def figure_id(source: Column, page: Column, figure: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.format_string("%s_p%03d_f%02d", stem, page, figure)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images; files that can't be decoded are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(folder)


def protocol_csv(spark: SparkSession, path: str, required: tuple[str, ...] = PROTOCOL_REQUIRED) -> DataFrame:
    """All columns as text; a missing required column is an error that names it."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def checked_csv(spark: SparkSession, path: str, required: tuple[str, ...] = PROTOCOL_REQUIRED) -> tuple[DataFrame | None, str | None]:
    """The rows, or what is wrong with the file: that it is missing, empty or lacks columns."""
    if not exists(spark, path):
        return None, f"File not found: {path}"
    try:
        return protocol_csv(spark, path, required), None
    except ValueError as error:
        return None, str(error)


CONTEXT = T.StructType([
    T.StructField("outcomes", T.ArrayType(T.StringType())), T.StructField("groups", T.ArrayType(T.StringType())),
    T.StructField("units", T.MapType(T.StringType(), T.StringType())), T.StructField("error_bar_type", T.StringType()),
    T.StructField("focus_outcomes", T.ArrayType(T.StringType())), T.StructField("focus_groups", T.ArrayType(T.StringType())),
])


def context(spark: SparkSession, path: str) -> DataFrame:
    """One row of the context of interest; lists that are missing or aren't lists are empty."""
    read = spark.read.schema(CONTEXT).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    return read.withColumns({c: F.coalesce(c, empty) for c in ("outcomes", "groups")})


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON or JSON Lines (``.jsonl, .ndjson``) manifest: a list, an object with one of the list keys, or a record per line.

    Rows that aren't objects are an error.
    """
    read = spark.read.option("multiLine", not path.endswith((".jsonl", ".ndjson"))).json(path)
    if "_corrupt_record" in read.columns:
        raise ValueError(f"{path} has rows that aren't objects")
    for key in LIST_KEYS:
        if key in read.columns and isinstance(read.schema[key].dataType, T.ArrayType):
            return read.select(F.explode(key).alias("r")).select("r.*")
    return read


def benchmark_records(records: DataFrame) -> DataFrame:
    """``sample_id, benchmark_format, question, answer, qa_type`` of chart question records of either naming."""
    has = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in records.columns], F.lit(None).cast("string"))
    question, answer = has("query", "question"), has("label", "answer")
    raw = has(*ID_KEYS)
    stem = F.regexp_replace(F.regexp_extract(raw, r"([^/\\]*)$", 1), r"(?<=.)\.[A-Za-z]\w*$", "")
    kind = F.when(has("query").isNotNull(), "chartqa").otherwise("plotqa")
    return records.select(stem.alias("sample_id"), kind.alias("benchmark_format"), question.alias("question"), answer.alias("answer"), has("type", "qa_type").alias("qa_type"))


def document_pairs(truth: DataFrame, predicted: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Documents paired by base name (``<base>_gt.json`` with ``<base>_analysis.json``); and truths without a prediction."""
    base = lambda end: F.regexp_extract(F.col(path), rf"([^/\\]*){end}\.json$", 1)
    a, b = truth.withColumn("base", base("_gt")), predicted.withColumn("base", base("_analysis"))
    return a.alias("gt").join(b.alias("pred"), "base"), a.join(b.select("base"), "base", "left_anti")


def conformal_table(spark: SparkSession, path: str) -> DataFrame:
    """``family, mode, tau, bin, lo, hi, q_alpha, n_cal`` of a sidecar of binned quantiles."""
    schema = (
        "version string, alpha double, families map<string, struct<mode:string, tau:double, "
        "bins:array<struct<bin_edges:array<double>, q_alpha:double, n_cal:bigint>>>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("families").alias("family", "f"))
    dealt = rows.select("family", "f.mode", "f.tau", F.posexplode("f.bins").alias("bin", "b"))
    return dealt.select("family", "mode", "tau", "bin", F.col("b.bin_edges")[0].alias("lo"), F.col("b.bin_edges")[1].alias("hi"), "b.q_alpha", "b.n_cal")


def conformal_sidecar(spark: SparkSession, path: str) -> tuple[DataFrame | None, bool]:
    """The table and whether it was loaded: a missing file or one without families isn't."""
    if not exists(spark, path):
        return None, False
    table = conformal_table(spark, path)
    return (None, False) if table.isEmpty() else (table, True)


def evaluation_payload(spark: SparkSession, path: str) -> DataFrame:
    """One row of ``summary`` and ``per_chart_metrics``; a payload without either is an error."""
    read = spark.read.option("multiLine", True).json(path)
    missing = [c for c in ("summary", "per_chart_metrics") if c not in read.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return read


def yolo_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``path, cls, cx, cy, w, h`` of normalised label lines; lines of another shape are dropped."""
    lines = spark.read.text(folder).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("p"))
    numbers = F.transform("p", lambda x: x.try_cast("double"))
    usable = lines.withColumn("n", numbers).where((F.size("n") >= 5) & F.forall(F.slice("n", 1, 5), lambda x: x.isNotNull()))
    return usable.select("path", F.col("n")[0].cast("int").alias("cls"), *[F.col("n")[i + 1].alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
