"""The sides of a target meet, not its candidates."""

import random

from pyspark.sql import functions as F

from editloom.operators import primers as pr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_search_sends_no_candidates(spark):
    rng = random.Random(13)
    seqs = ["".join(rng.choice("ACGT") for _ in range(2016)) for _ in range(12)]
    rows = [(i, s) for i, s in enumerate(seqs)] + [(3, seqs[3]), (None, seqs[0]), (20, None), (21, "ACGT")]
    df = spark.createDataFrame(rows, "target_id long, seq string").withColumns({"anchor_start": F.lit(1000).cast("bigint"), "anchor_end": F.lit(1050).cast("bigint")})
    found = pr.ranked_pairs(pr.flanking_targets(df))
    assert "FlatMapGroupsInArrow" not in plan(found)
    got = {}
    for r in found.orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append((r["rank"], r["fw_seq"], r["rev_seq"], r["score"]))
    one = {}
    for i in range(12):
        alone = pr.ranked_pairs(pr.flanking_targets(df.where(f"target_id = {i}").limit(1))) if i in (0, 7) else None
        if alone is not None:
            one[i] = [(r["rank"], r["fw_seq"], r["rev_seq"], r["score"]) for r in alone.orderBy("rank").collect()]
            assert got[i] == one[i]
    # Rows that repeat a target are one target with each candidate twice, so its best pair stands four times.
    assert [x[1:] for x in got[3]][:4] == [got[3][0][1:]] * 4 and got[None] == one[0] and 20 not in got and 21 not in got
