"""Lookups of some genes in stored tables."""

import re

from pyspark.sql import functions as F

from editloom.operators import library as lib
from editloom.sources.stored import read_genes, store_by_gene


def targets(spark, rows):
    return lib.summarize_targets(spark.createDataFrame(rows, "id long, gene string, sequence string, chromosome string, position string, strand string, coverage int, oof_score double, "
                                                             "cds_percentages map<string,double>, offtarget_counts array<long>"))


SEQ = "ACGTACGTACGGACGTACGTAGG"


def row(i, gene, coverage, counts, oof=70.0, cds=20.0, seq=SEQ):
    return (i, gene, seq, "1", "5", "+", coverage, oof, {"a": cds}, counts)


def test_first_tier_is_that_of_the_row_wise_tiers(spark):
    rows = [row(1, "A", 3, [1, 0, 0]), row(2, "A", 3, [0, 0, 0]), row(3, "A", 2, [0, 0, 0]),
            row(4, "B", 9, [0, 4, 0]), row(5, "B", 2, [0, 0, 0]), row(6, "B", 2, [1, 0, 0], 50.0),
            row(7, "C", 1, [3, 3, 3]), row(8, "C", None, [2, 0, 0]), row(9, "D", 1, [0, 0, 0], seq="TTTTT" + SEQ[5:]), row(10, "E", None, [0, 0, 0])]
    rows += [row(100 + i, "HOT", i % 4, [i % 3, 0, 0], float(i % 90)) for i in range(500)]
    t = targets(spark, rows)
    tiered = lib.with_filter_tier(t)
    want = lib.best_tier_targets(tiered).join(lib.tier_counts(tiered).drop("tier"), "gene").select("gene", "id", "rank", "tier", "total_targets").collect()
    got = lib.first_tier_targets(t).select("gene", "id", "rank", "tier", "total_targets").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["gene"] for r in got} == {"A", "B", "C", "E", "HOT"}


def test_only_asked_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "stored")
    df = spark.range(20_000).select(F.concat(F.lit("G"), (F.col("id") % 500).cast("string")).alias("gene"), "id")
    store_by_gene(df, path)
    asked = spark.createDataFrame([("G7",), ("G7",), ("G499",), ("NONE",), (None,)], "gene string")
    got = read_genes(spark, path, asked)
    assert sorted(map(tuple, got.collect())) == sorted(("G%d" % (i % 500), i) for i in range(20_000) if i % 500 in (7, 499))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*gene_folder", plan)
    files = got.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 3
    assert read_genes(spark, path, asked.limit(0)).count() == 0
