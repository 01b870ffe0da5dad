"""Linking requests with reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm


def file_keys(files: DataFrame) -> DataFrame:
    """files(file_no, file_name) -> first file per lookup key: key_kind (name, stem, gene), key, file_name, file_no."""
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    low = lambda c: F.lower(F.trim(c))
    keys = F.array(*[F.struct(F.lit(k).alias("key_kind"), v.alias("key")) for k, v in (
        ("name", low(F.col("file_name"))), ("stem", low(stem)), ("gene", F.coalesce(norm.gene_token(stem), F.lit(""))))])
    df = files.select("file_no", "file_name", F.inline(keys)).where("key <> ''")
    w = Window.partitionBy("key_kind", "key").orderBy("file_no")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def link_definitions(definitions: DataFrame, keys: DataFrame) -> DataFrame:
    """Definition rows with their file: by full name first, else by stem; without a match an error text."""
    part = lambda k: keys.where(F.col("key_kind") == k).select(F.col("key").alias("_k"), F.col("file_name").alias("by_" + k))
    df = definitions.withColumn("_k", F.lower(F.trim("file_token")))
    df = df.join(part("name"), "_k", "left").join(part("stem"), "_k", "left")
    name = F.coalesce("by_name", "by_stem")
    err = F.when(name.isNull(), F.concat(F.lit("Line "), F.col("line_number").cast("string"), F.lit(': could not find GenBank file "'),
                                         F.col("file_token"), F.lit('" in the uploaded folder.')))
    return df.withColumns({"file_name": name, "err": err}).drop("_k", "by_name", "by_stem")
