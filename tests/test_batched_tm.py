"""Melting temperatures in one Arrow pass, and alignment hits sent once."""

import random

from pyspark.sql import functions as F

from editloom.checks.fixtures import view
from editloom.functions import seq as sq
from editloom.functions.oligo import oligo_tm


def test_batched_tm_equals_the_column_measure(spark):
    rng = random.Random(3)
    texts = [None, "", "A", "ac", "NNNN", "AÄCGT", "ACGT-acgu"] + ["".join(rng.choice(x) for _ in range(rng.randint(1, 70))) for x in ("ACGT", "ACGTacgtN") * 150]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").repartition(3)
    rows = df.select("s", sq.melting_temperature(F.col("s")).alias("a"), oligo_tm("s").alias("b")).collect()
    assert len(rows) == len(texts) and [r.s for r in rows if r.a != r.b] == []


def test_tm_query_runs_in_a_pass(spark, tmp_path):
    import __spark_entry__
    spark.createDataFrame([(i, "t") for i in range(3)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = __spark_entry__.queries()["seq_4_melting_temperature"](spark, str(tmp_path))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString() and df.where("tm > 0").count() > 100


def test_hits_of_a_query_meet_in_one_exchange(spark, tmp_path):
    rows = [(k, n, k + n, 7, "R" if n % 2 else "N") for k in range(20) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    v = view(spark, str(tmp_path), "fx_hsps", "l_orderkey")
    both = v.groupBy("query_id", "accession").agg(F.collect_list("hseq").alias("h")).groupBy("query_id").agg(F.collect_list("h").alias("h"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and both.count() == 20
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, view(spark, str(tmp_path), "fx_hsps").collect()))
