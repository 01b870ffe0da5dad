"""Lookup tables stored by gene, so that a lookup of some genes reads only their part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frame import broadcast_if_small

#: Folders of a stored table; also the most values a lookup brings to the driver.
FOLDERS = 256


def _folder(gene: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gene), F.lit(folders)).cast("int")


def store_by_gene(df: DataFrame, path: str, gene: str = "gene", folders: int = FOLDERS) -> None:
    """Write ``df`` in one folder per hash of the gene, sorted by gene, with bloom filters on it.

    Rows are dealt out by range within the folder, so the rows of a very common gene are shared by several files."""
    tie = [c for c, t in df.dtypes if c != gene and not t.startswith(("map", "array", "struct", "variant"))][:1]
    rows = df.withColumn("gene_folder", _folder(F.col(gene), folders)).repartitionByRange("gene_folder", gene, *tie).sortWithinPartitions("gene_folder", gene)
    rows.write.option(f"parquet.bloom.filter.enabled#{gene}", "true").partitionBy("gene_folder").parquet(path)


def read_genes(spark: SparkSession, path: str, asked: DataFrame, gene: str = "gene", folders: int = FOLDERS) -> DataFrame:
    """The rows of the asked genes (a column ``gene`` of the same form as stored): other folders are not listed in the scan."""
    names = asked.select(F.col(gene)).where(F.col(gene).isNotNull()).distinct()
    wanted = [r[0] for r in names.select(_folder(F.col(gene), folders)).distinct().collect()]
    return spark.read.parquet(path).where(F.col("gene_folder").isin(wanted)).join(broadcast_if_small(names), gene, "left_semi").drop("gene_folder")
