"""Complement runs and differences of oligos: against every substring, and each text made once."""

import random

from pyspark.sql import functions as F

from editloom.functions import seq as sq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, letters, sizes):
    return [None if i % 29 == 28 else "".join(rng.choice(letters[i % len(letters)]) for _ in range(rng.choice(sizes))) for i in range(n)]


def longest(left, fits):
    return max((k for k in range(1, len(left) + 1) for i in range(len(left) - k + 1) if fits(i, k)), default=0)


def test_runs_are_arrow_passes(spark):
    rng, turn = random.Random(12), lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    letters = ["ACGT", "ACGTN", "ACGTacgt", "ACGTRYé", "AT"]
    rows = list(zip(words(rng, 150, letters, [0, 5, 18, 26, 70]), words(rng, 150, letters, [0, 5, 18, 26])))
    a, b = F.col("a"), F.col("b")
    out = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", sq.complement_run(a, b).alias("run"), sq.three_prime_complement_run(a, b).alias("three"), sq.hairpin_run(a).alias("stem"), sq.hairpin_run(a, 5).alias("wide"))
    assert "ArrowEvalPython" in plan(out) and "aggregate(sequence" not in plan(out)
    for r in out.collect():
        x, y = (r["a"] or "").upper(), (r["b"] or "").upper()
        stem = lambda loop: longest(x, lambda i, k: turn(x[i:i + k]) in x[i + k + loop:])
        assert r["run"] == longest(x, lambda i, k: x[i:i + k] in turn(y))
        assert r["three"] == longest(x[-8:], lambda i, k: x[-8:][i:i + k] in turn(y[-8:]))
        assert (r["stem"], r["wide"]) == (stem(3), stem(5))


def test_compared_texts_are_made_once(spark):
    rows = [("ACGTACGTA", "ACCTACGTT"), ("", "A"), (None, "ACG"), ("ACGA", "ACG"), ("ACG", None)]
    made_a, made_b = F.left(F.col("a"), F.lit(18)), F.left(F.col("b"), F.lit(18))
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(sq.diff_positions(made_a, made_b).alias("bases"), sq.diff_items(sq.codons(made_a), sq.codons(made_b)).alias("codons"))
    text = out._jdf.queryExecution().analyzed().toString()
    # A place evaluated its text again: each of the two calls names each text once for every place it is used in.
    assert sq.diff_positions(made_a, made_b)._jc.toString().count("left(") == 2, text
    got = [(r["bases"], r["codons"]) for r in out.collect()]
    assert got[0] == ([2, 8], [0, 2]) and got[1] == ([], []) and got[2] == ([], [0]) and got[3] == ([3], [])
