"""Oligo measures by bits, primer candidates by running sums, the guide-blocking edit and sequences that are made once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from editloom.checks import fixtures
from editloom.functions import fixed as fx
from editloom.functions import oligo as ol
from editloom.operators import guides as gd


def _texts(letters: str, sizes, count: int = 300) -> list[str]:
    rng = np.random.default_rng(7)
    return ["".join(rng.choice(list(letters), rng.integers(*sizes))) for _ in range(count)]


def test_bits_give_the_runs_and_counts_of_the_tables():
    for texts in (_texts("ACGT", (18, 27)), _texts("ACGTN", (0, 64)), _texts("AT", (1, 40)), ["AT" * 9, "GCG", "", "A" * 30]):
        o, turned = ol.Oligos(pa.array(texts)), ol.Oligos(pa.array(texts[::-1]))
        rc = o.reverse_complement()
        runs, stems = ol._runs_and_stems(o.left, rc, o.n)
        assert (runs == ol._longest_run_wide(o.left, rc)).all() and (stems == ol._longest_run_wide(o.left, rc, o.n)).all()
        other = turned.reverse_complement()
        assert (ol._longest_run(o.left, other) == ol._longest_run_wide(o.left, other)).all()
        for a, b in zip(ol._bit_counts(o), ol._counts(o)):
            assert np.array_equal(a, b)


def test_candidates_are_all_stretches_that_pass():
    pieces = [*_texts("ACGT", (40, 90), 6), "ACGTTGCANGCATCGATCGGATCGATTTACGGCATTACG", "ACGT"]
    flipped = [i % 2 == 1 for i in range(len(pieces))]
    first, last, end = (np.array(x) for x in ([0, 3, -2, 5, 0, 1, 0, 0], [60, 30, 20, 90, 10, 50, 60, 9], [90, 70, 40, 200, 36, 60, 90, 9]))
    w = ol.primer_windows(pieces, flipped, first, last, end)
    at = np.concatenate(([0], np.cumsum(w["n"])))
    found = {(int(r), int(s), bytes(w["text"][at[k]:at[k + 1]]).decode(), float(t), float(p)) for k, (r, s, t, p) in enumerate(zip(w["row"], w["start"], w["tm"], w["penalty"]))}
    wanted = set()
    for i, piece in enumerate(pieces):
        for s in range(max(0, first[i]), last[i] + 1):
            for n in range(fx.PRIMER_LEN_MIN, fx.PRIMER_LEN_MAX + 1):
                if s + n > min(end[i], len(piece)):
                    continue
                text = piece[s:s + n]
                text = text[::-1].translate(str.maketrans("ACGT", "TGCA")) if flipped[i] else text
                q = {k: v[0] for k, v in ol.assess(ol.Oligos(pa.array([text]))).items()}
                if ("N" not in text and not q["run4"] and fx.PRIMER_GC_MIN <= q["gc"] <= fx.PRIMER_GC_MAX and fx.PRIMER_TM_MIN <= q["tm"] <= fx.PRIMER_TM_MAX
                        and q["self_three"] < 4 and q["hairpin"] < 6 and q["penalty"] <= fx.PRIMER_PENALTY_MAX):
                    wanted.add((i, s, text, float(q["tm"]), float(q["penalty"])))
    assert wanted and found == wanted and len(w["n"]) == len(wanted)


def test_blocking_edit_takes_the_first_site_that_may_change(spark):
    guide = "named_struct('spacer', 'x', 'pam', 'x', 'strand', '+', 'cut', 17L, 'd', 0L, 'gc', 50, 'ps', 0L)"
    df = spark.sql(f"""SELECT 'ACGTACGTACGTACGTACGTTGG' AS bases, 0L AS start, 23 AS seq_len, '' AS cds, g, blocked,
 array(named_struct('start', 900L, 'end', 903L, 'cum', 0L)) AS segs
 FROM VALUES ({guide}, array(0L)), ({guide}, array(21L, 22L)), (null, array(0L)) AS t(g, blocked)""")
    ref = gd.Reference(F.col("bases"), F.col("start"), F.col("seq_len"))
    edit = lambda loose: gd.blocking_edit(ref, F.col("g"), F.col("cds"), F.col("segs"), F.col("blocked"), loose)
    rows = df.select(edit(True).alias("loose"), edit(False).alias("strict")).collect()
    assert [r.loose and (r.loose.gp, r.loose.base, r.loose.old, r.loose.kind) for r in rows] == [(21, "A", "G", "noncoding"), (10, "A", "G", "noncoding"), None]
    assert [r.strict for r in rows] == [None, None, None]


def test_filters_on_models_do_not_make_the_sequences_again(spark, tmp_path):
    spark.createDataFrame([(i, "t") for i in range(5)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = fixtures.models(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 63
