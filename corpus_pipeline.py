"""A corpus pipeline: four stages, each written as Parquet and read again as the next one's documents.

In every stage null texts count as empty, columns other than ``doc_id text lang source n_chars`` are carried along
unread whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm import credential_links, language_fusion, sos_packing, superminhash
from abacist.llm.queries import tokenizer_file
from abacist.llm.workspace import fresh_path, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; rejected ones go, among them null, empty and textless documents.

    Rows with equal id and text share a verdict made of all their declarations. Null ids, declarations and sources are ordinary.
    """
    model = language_fusion.fit(docs)
    judged = language_fusion.identify(docs, model, F.col("lang"), F.lit(""), F.col("source"))
    return language_fusion.filtered(docs, judged)


#: Where the ids that stand for null ones start; they are above all others.
NO_ID = 1 << 62


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8).

    Rows with a null id take one above all ids, made of their text, so they join groups and go before others. Of several rows
    with the kept id, one stays: that of the smallest text. Rows without an id and without words have no group and all stay.
    """
    made = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID - 1))
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    lone = F.col("doc_id").isNull() & wordless
    key = F.when(~lone, F.coalesce(F.col("doc_id").cast("long"), made))
    found = superminhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), words=5, percent=80)
    rows = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    keyed = docs.select(F.struct("*").alias("row"), key.alias("_key"), F.col("text").alias("_text"))
    # verdicts that differ from "kept, one row"
    other = stored(rows.where("NOT kept OR n > 1").select(F.col("doc_id").alias("_other"), "kept"), "duplicates")
    alone = keyed.join(other, F.col("_key") == F.col("_other"), "left_anti")
    several = keyed.join(other.where("kept"), F.col("_key") == F.col("_other"))
    first = F.min_by("row", F.struct(F.coalesce("_text", F.lit("")), F.xxhash64("row"))).alias("row")
    return alone.select("row").unionByName(several.groupBy("_key").agg(first).select("row")).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a mark; ``n_chars`` follows. Equal rows stay equal; null texts stay null, of null length."""
    hidden = credential_links.masked(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: which sequence of 2048 tokens it is in, and where. An empty text is a piece of its end id; equal rows each have pieces."""
    pieces = sos_packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, length=2048)
    return sos_packing.pack(stored(pieces.drop("ids"), "pieces"), 2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Similarity of shingle sets, tokens and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
