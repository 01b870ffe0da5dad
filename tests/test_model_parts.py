"""Models are few bytes and much work: they are not gathered into one task by size."""

from pyspark.sql import functions as F

from editloom.checks.fixtures import models
from editloom.plans import designs as ds
from editloom.sources.models import build_models

PARTS = 40


def _documents(spark, folder, rows):
    spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_designs_keep_their_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTS))
    try:
        m = models(spark, _documents(spark, tmp_path, 600))
        asked = m.select(F.col("seq_id").alias("request_id"), "seq_id", F.lit("C-EGFP").alias("tag"), F.lit("250").alias("homology_arm"))
        d = ds.terminal_designs(m, asked, "ct")
        used = d.select(F.spark_partition_id().alias("p"), "request_id", "err").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r["count"] for r in used) == 600
    assert len(used) > PARTS // 2, used


def test_parts_grow_with_the_table(spark, tmp_path):
    from editloom.checks.fixtures import sequence_parts
    assert sequence_parts(spark, _documents(spark, tmp_path, 300_000)) >= 60


def test_parts_leave_models_as_they_are(spark):
    seqs = spark.createDataFrame([(i, "G", "ACGATGAAATAAC" * 3) for i in (1, 2, 3)] + [(None, "G", "ACG")], "seq_id long, gene string, seq string")
    segs = spark.createDataFrame([(1, 3, 9), (1, 12, 15), (2, 3, 12), (2, 3, 12), (None, 1, 2)], "seq_id long, seg_start long, seg_end long")
    exons = spark.createDataFrame([(1, 1, 0, 20), (1, 2, 20, 30)], "seq_id long, exon_number int, exon_start long, exon_end long")
    rows = [sorted((r.seq_id, r.cds, len(r.segs), None if r.exons is None else [x.exon_number for x in r.exons])
                   for r in build_models(seqs, segs, exons, parts).collect()) for parts in (None, 1, 7)]
    assert rows[0] == rows[1] == rows[2] and [r[0] for r in rows[0]] == [1, 2] and rows[0][1][2] == 2
