"""The site scan makes no row per base and finds what trying every place finds."""

import random

from pyspark.sql import functions as F

from editloom.operators import genome as gn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, letters, sizes):
    return [None if i % 29 == 28 else "".join(rng.choice(letters[i % len(letters)]) for _ in range(rng.choice(sizes))) for i in range(n)]


def brute_sites(seq, any_pam, drop_runs):
    pair, out = str.maketrans("ACGT", "TGCA"), set()
    for at in range(len(seq) - 22):
        w = seq[at:at + 23]
        back = "".join(x if x in "ACGTN" else "N" for x in w.upper()[::-1].translate(pair))
        for strand, site, shift, good in (("+", w, 17, w[21:] == "GG" and (any_pam or w[20] in "ACGT")), ("-", back, 6, w[:2] == "CC" and (any_pam or w[2] in "ACGT"))):
            if good and not (drop_runs and ("TTTTT" in site[:20] or "AAAAA" in site[:20])):
                out.add((site[:20], site[20:], strand, at + shift, at, 5 * sum(x in "GCgc" for x in site[:20])))
    return out


def test_sites_are_found_without_a_row_per_base(spark):
    rng = random.Random(11)
    texts = words(rng, 60, ["ACGT", "ACGTN", "GC", "ACGTacgtn", "ACGTRé", "GGGGCCCCTA"], [0, 22, 23, 24, 300, 2000]) + ["ACGTCCGG" * 9000]
    df = spark.createDataFrame([(i, t, [str(i)]) for i, t in enumerate(texts)], "seq_id long, seq string, kept array<string>")
    for options in ({"any_pam": False, "drop_runs": True}, {"any_pam": True, "drop_runs": False}):
        found = gn.scan_sequences(df, **options)
        assert "explode(sequence" not in plan(found)
        got = [(r["seq_id"], r["spacer"], r["pam"], r["strand"], r["cut"], r["ps"], r["gc"]) for r in found.collect()]
        want = {(i, *x) for i, t in enumerate(texts) if t is not None for x in brute_sites(t, **options)}
        assert len(got) == len(want) and set(got) == want
    part = gn.scan_sites(df.select("kept", F.col("seq").alias("bases"), (F.col("seq_id") * 10).alias("bases_start")))
    assert part.columns == ["kept", "spacer", "pam", "strand", "cut", "ps", "gc"]
    assert {(r["kept"][0], r["ps"] - 10 * int(r["kept"][0])) for r in part.collect()} == {
        (str(i), x[4]) for i, t in enumerate(texts) if t is not None for x in brute_sites(t, False, True)}
