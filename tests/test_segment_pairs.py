"""Guide pairs of segments: the best one leaves its task alone."""

import random

from editloom.operators import guides as gd


def test_best_pair_without_an_exchange_of_pairs(spark):
    rng = random.Random(4)
    rows = [(s, g, 100, 300, g + 1, "".join(rng.choices("ACGT", k=20)), "AGG", rng.choice("+-"), cut, rng.choice([40, 50, 60]), cut - 17)
            for s in range(3) for g in range(2) for cut in rng.choices(range(90, 310), k=40)]
    sites = spark.createDataFrame(rows, "seq_id long, seg_no int, seg_start long, seg_end long, exon_number int, spacer string, pam string, strand string, cut long, gc int, ps long").repartition(4)
    pairs = gd.segment_pairs(sites)
    order = lambda r: (100 - r[9]) * 2**40 + r[10] * 2 + (r[7] != "+")
    want = {}
    for l in rows:
        for r in rows:
            gap = r[8] - l[8]
            if l[:2] == r[:2] and 0 <= gap <= 140 and (gap or order(l) < order(r)):
                preferred = 40 <= gap <= 140
                key = (not preferred, l[7] == r[7], -l[9] - r[9], abs(gap - 90) if preferred else -gap, min(order(l), order(r)), max(order(l), order(r)))
                want.setdefault(l[:2], []).append((key, l[10], r[10]))
    assert pairs.count() == sum(map(len, want.values()))
    best = gd.best_pair_per_segment(pairs)
    assert sorted((r.seq_id, r.seg_no, r.l_ps, r.r_ps) for r in best.collect()) == sorted((*k, *min(v)[1:]) for k, v in want.items())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gd.best_pair_per_segment(gd.segment_pairs(sites))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan, plan
