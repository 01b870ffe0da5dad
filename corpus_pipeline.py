"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; its result is written
as Parquet and read again. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editloom.llm import decontaminate, exact_dedup, near_join, packing, toxicity
from editloom.llm.common import hash_of_text, key_of, stage, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar predicts toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays; of rows that repeat a doc_id with equal texts too. Rows of one doc_id with other texts are
    documents of their own, in each stage."""
    rows = stage(exact_dedup.dedup_keys(docs), "pipeline-copies")
    left = without(docs, stage(rows.where("not kept").select("key", "text_hash").distinct(), "pipeline-dropped"))
    kept = rows.where("kept")
    several = kept.groupBy("key", "text_sha256").agg(F.count("*").alias("rows")).where("rows > 1").select("key", "text_sha256")
    again = stage(kept.select("key", "text_hash", "text_sha256").distinct().join(several, ["key", "text_sha256"]), "pipeline-repeated")
    if again.limit(1).count() == 0:
        return left
    marked = left.withColumns({"__key": key_of(), "__hash": hash_of_text()})
    number = F.row_number().over(Window.partitionBy("__key", "__digest").orderBy(F.length("text").desc_nulls_last(), "text"))
    names = again.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("text_sha256").alias("__digest"))
    first = marked.join(names, ["__key", "__hash"]).withColumn("__row", number).where("__row = 1")
    return without(left, again).unionByName(first.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    rows = near_join.near_duplicates(docs)
    return without(docs, stage(rows.where("not first").select("key", "text_hash").distinct(), "pipeline-near"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, stage(found.select("key", "text_hash").distinct(), "pipeline-benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_benchmark), ("packing", pack)]

#: Tokenising, the learned toxicity score and the alignment have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
