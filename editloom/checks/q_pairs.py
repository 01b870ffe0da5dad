"""Primer pair searches on short flanks, where SQL can try every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import primers as pr
from .fixtures import view, with_views
from .q_sequence import _GCP, _QC, _RUN4, run_sql
from .registry import query

# Per mode: length of the reference taken, and the target columns (SQL, over seq_id).
_TARGETS = {
    "flanking": (506, {"a": "90 + seq_id % 5", "b": "400"}),
    "centred": (458, {"a": "222 + seq_id % 11", "b": "0"}),
    "outside": (600, {"a": "26", "b": "574"}),
    "screen": (100, {"a": "30 + seq_id % 3", "b": "68"}),
}
# Start and end limits of single primers by side, and what holds of a pair.
_SIDES = {
    "flanking": ("start >= greatest(0, a - 500) AND start < greatest(0, a - 80)", "start >= least(n, b + 80) AND start < least(n, b + 460)"),
    "centred": ("start <= n - 450", "start + len >= 450"),
    "outside": ("start >= greatest(0, a - 650) AND start + len <= a", "start >= b AND start <= b + 650"),
    "screen": ("start <= least(n - 18, 40)", "start >= 68"),
}
_APART = "right(f.s, 4) <> translate(reverse(right(r.s, 4)), 'ACGT', 'TGCA')"
_IDEAL = "CAST(floor(f.a - (r.start + r.len - f.start) / 2.0e0 + 0.5e0) AS BIGINT)"
_TOP = "greatest(0, f.n - (r.start + r.len - f.start))"
_RULES = {
    "flanking": f"r.start + r.len - f.start BETWEEN 450 AND 500 AND {_APART}",
    "centred": f"r.start + r.len - f.start BETWEEN 450 AND 500 AND {_APART} AND r.start > f.start + f.len AND f.start BETWEEN greatest(0, least({_TOP}, {_IDEAL} - 35)) AND greatest(0, least({_TOP}, {_IDEAL} + 35))",
    "outside": f"r.start + r.len - f.start BETWEEN f.b - f.a + 48 AND f.b - f.a + 1352 AND {_APART}",
    "screen": "r.start BETWEEN greatest(f.start + f.len + 50, least(greatest(0, f.n - r.len), f.n - 58)) AND greatest(f.start + f.len + 50, least(greatest(0, f.n - r.len), f.n + 22))",
}
_AMP = {"screen": "greatest(36, a - f_start + r_end - b)"}
_WANTED = {"outside": "b - a + 240", "screen": "500"}
_EXTRA = {
    "flanking": "0.0e0", "centred": "abs(a - (f_start + (r_end - f_start) / 2.0e0)) / 5.0e0",
    "outside": "(abs(a - f_start - 120) + abs(r_end - b - 120)) / 25.0e0", "screen": "(abs(a - f_start - 250) + abs(r_end - b - 250)) / 20.0e0",
}
_TIES = {"centred": "r_end - f_start, f_start, f_len, r_len", "outside": "fi, ri"}


def pair_sql(mode: str) -> str:
    """Every pair of every target, measured and ranked."""
    n, t = _TARGETS[mode]
    left, right = _SIDES[mode]
    flip = "translate(reverse(substr(seq, start + 1, len)), 'ACGT', 'TGCA')"
    place = "abs(CASE WHEN side = 'f' THEN a - start ELSE start + len - b END - 120) + abs(tm - 60) * 8 + abs(gc - 50) * 2 - clamp * 4"
    return with_views("fx_sequences", f""", tg AS MATERIALIZED (SELECT seq_id AS target_id, substr(seq, 1, {n}) AS seq, {n} AS n, {t['a']} AS a, {t['b']} AS b FROM fx_sequences),
spot AS (SELECT CAST(p AS INT) AS start, CAST(l AS INT) AS len FROM (SELECT unnest(range(0, {n} - 17)) AS p), (SELECT unnest(range(18, 27)) AS l) WHERE p + l <= {n}),
raw AS (SELECT target_id, n, a, b, 'f' AS side, start, len, substr(seq, start + 1, len) AS s FROM tg, spot WHERE {left}
 UNION ALL SELECT target_id, n, a, b, 'r', start, len, {flip} FROM tg, spot WHERE {right}),
cand AS MATERIALIZED (SELECT * FROM raw WHERE NOT {_RUN4} AND {_GCP} BETWEEN 38 AND 67), o AS (SELECT DISTINCT s FROM cand)""" + _QC + f""",
ok AS MATERIALIZED (SELECT c.*, q.gc, q.tm, q.clamp, q.penalty, row_number() OVER (PARTITION BY target_id, side ORDER BY {place}, start, len) AS i FROM cand c JOIN q USING (s)
 WHERE tm BETWEEN 55 AND 67 AND self_three < 4 AND hairpin < 6 AND penalty <= 22),
pr AS MATERIALIZED (SELECT f.target_id, f.a, f.b, f.s AS fs, r.s AS rs, f.start AS f_start, f.len AS f_len, r.start AS r_start, r.len AS r_len, r.start + r.len AS r_end, f.i AS fi, r.i AS ri,
 f.tm AS tf, r.tm AS tr, f.gc AS gf, r.gc AS gr, f.clamp AS cf, r.clamp AS cr, f.penalty AS pf, r.penalty AS pr FROM ok f JOIN ok r ON r.target_id = f.target_id AND f.side = 'f' AND r.side = 'r'
 WHERE abs(f.tm - r.tm) <= 5 AND {_RULES[mode]}),
hr AS MATERIALIZED (SELECT *, {run_sql('right(fs,8)', 'right(rs,8)')} AS h3 FROM pr), hh AS MATERIALIZED (SELECT *, {run_sql('fs', 'rs')} AS h FROM hr WHERE h3 < 4),
pn AS (SELECT *, floor((pf + pr + greatest(0, h - 4) * 3 + greatest(0, h3 - 2) * 7 + abs(tf - tr) / 2) * 10.0e0 + 0.5e0) / 10.0e0 AS pen, {_AMP.get(mode, 'r_end - f_start')} AS amp FROM hh),
sc AS (SELECT *, floor((-(abs(tf-60)+abs(tr-60)) - (abs(gf-50)+abs(gr-50))/10 + (cf+cr)*2 - abs(amp - ({_WANTED.get(mode, '475')}))/100.0e0 - pen/8 - {_EXTRA[mode]})*100.0e0+0.5e0)/100.0e0 AS score FROM pn WHERE pen <= 30)
SELECT target_id, CAST(rank AS INT) AS rank, fs AS fw_seq, CAST(f_start AS BIGINT) AS fw_start, rs AS rev_seq, CAST(r_start AS BIGINT) AS rev_start, CAST(r_end AS BIGINT) AS rev_end, CAST(amp AS BIGINT) AS amp, score
 FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, {_TIES.get(mode, 'f_start, f_len, r_start, r_len')}) AS rank FROM sc) WHERE rank <= 5""")


def short_targets(spark, sf, mode: str) -> pr.Targets:
    n, t = _TARGETS[mode]
    df = view(spark, sf, "fx_sequences").select(F.col("seq_id").alias("target_id"), F.substring("seq", 1, n).alias("seq"), *[F.expr(f"CAST({x} AS BIGINT)").alias(c) for c, x in t.items()])
    return {"flanking": lambda: pr.flanking_targets(df, "a", "b"), "centred": lambda: pr.centred_targets(df, "a"),
            "outside": lambda: pr.outside_targets(df, "a", "b"), "screen": lambda: pr.screen_targets(df, "a", "b")}[mode]()


_COLUMNS = ["target_id", "rank", "fw_seq", "fw_start", "rev_seq", "rev_start", "rev_end", "amp", "score"]


@query("join_7_flanking_short", pair_sql("flanking"))
def join_7(spark, sf):
    return pr.ranked_pairs(short_targets(spark, sf, "flanking")).select(*_COLUMNS)


@query("join_8_outside_short", pair_sql("outside"))
def join_8(spark, sf):
    return pr.ranked_pairs(short_targets(spark, sf, "outside")).select(*_COLUMNS)


@query("join_9_centred_short", pair_sql("centred"))
def join_9(spark, sf):
    return pr.ranked_pairs(short_targets(spark, sf, "centred")).select(*_COLUMNS)


@query("join_10_deletion_screen_short", pair_sql("screen"))
def join_10(spark, sf):
    return pr.ranked_pairs(short_targets(spark, sf, "screen")).select(*_COLUMNS)


@query("win_8_candidate_cap_short", pair_sql("outside").split("pr AS MATERIALIZED")[0].rstrip().rstrip(",") + """
SELECT target_id, side, CAST(start AS BIGINT) AS start, CAST(len AS INT) AS len, s AS p, CAST(i AS INT) AS rank FROM ok WHERE i <= 10""")
def win_8(spark, sf):
    """The candidates of each side that a search limited to ten looks at, in search order."""
    from pyspark.sql import Window
    c = pr.primer_candidates(short_targets(spark, sf, "outside")).select("target_id", "side", "c.placing", "c.start", "c.len", "c.p")
    w = Window.partitionBy("target_id", "side").orderBy("placing", "start", "len")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("target_id", "side", "start", F.col("len").cast("int").alias("len"), "p", "rank")
