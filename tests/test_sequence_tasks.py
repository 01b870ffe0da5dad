"""Sequences are made in all tasks, from ids that were sent there."""

import re

from pyspark.sql import functions as F

from editloom.checks import fixtures
from editloom.operators import genome as gn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_made_after_the_ids_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(i, "text") for i in range(50)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seqs = fixtures.view(spark, str(tmp_path), "fx_sequences")
    lines = plan(seqs).split("\n")
    made = [i for i, x in enumerate(lines) if "md5(" in x]
    sent = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    # The plan is read upwards: the exchange lies below every line that makes text.
    assert made and len(sent) == 1 and max(made) < sent[0]
    assert seqs.where(F.length("seq") == 2016).count() == 50
    # Models take the sequences as they lie, without sending the text.
    models = plan(fixtures.models(spark, str(tmp_path)))
    assert not re.search(r"Exchange hashpartitioning\(seq_id[^\n]*\n[^\n]*(Generate|md5)", models)
    assert gn.scan_sequences(seqs).count() > 0
