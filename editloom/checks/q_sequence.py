"""Sequence functions over oligos and windows taken from every fixture sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as sq
from ..functions.fixed import CODON_TO_AA, NN_PARAMS
from ..functions.oligo import oligo_tm
from .fixtures import view, with_views
from .registry import query

# Oligos: every whole sequence tiled in steps of 20, length 18-26, paired with its mirror tile; some turned
# into repeats, runs and hairpins.
_OLIGO_SQL = """, o AS MATERIALIZED (SELECT seq_id, p, CASE p % 11 WHEN 0 THEN repeat(substr(seq, p+1, 2), 10) WHEN 1 THEN substr(seq, p+1, 8) || repeat(substr(seq, p+9, 1), 5) || substr(seq, p+20, 8)
 WHEN 2 THEN substr(seq, p+1, 9) || 'TTT' || translate(reverse(substr(seq, p+1, 9)), 'ACGT', 'TGCA') ELSE substr(seq, p+1, CAST(18 + p % 9 AS INT)) END AS s,
 substr(seq, CAST(length(seq) - p - 25 AS INT), CAST(18 + p % 9 AS INT)) AS s2 FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 26, 20)) AS p FROM fx_sequences))
"""


def oligos(spark, sf):
    df = view(spark, sf, "fx_sequences").select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 27, F.lit(20))).alias("p"))
    p, s = F.col("p"), F.col("seq")
    cut = lambda start, n: F.substring(s, start + 1, n if not isinstance(n, int) else F.lit(n))
    size = 18 + p % 9
    text = (F.when(p % 11 == 0, F.repeat(cut(p, 2), 10))
            .when(p % 11 == 1, F.concat(cut(p, 8), F.repeat(cut(p + 8, 1), 5), cut(p + 19, 8)))
            .when(p % 11 == 2, F.concat(cut(p, 9), F.lit("TTT"), sq.revcomp(cut(p, 9)))).otherwise(cut(p, size)))
    return df.select("seq_id", F.col("p").cast("bigint").alias("p"), text.alias("s"), cut(F.length("seq") - p - 26, size).alias("s2"))


def mixed(spark, sf):
    """The same oligos with a third in lower case and a third in mixed case: measures must not depend on it."""
    s, k = F.col("s"), F.col("p") % 3
    half = F.concat(F.lower(F.substring("s", 1, 9)), F.substring(s, F.lit(10), F.length(s)))
    return oligos(spark, sf).withColumns({"s": F.when(k == 1, F.lower(s)).when(k == 2, half).otherwise(s), "s2": F.when(k == 2, F.lower("s2")).otherwise(F.col("s2"))})


def _o(body):
    return with_views("fx_sequences", _OLIGO_SQL + body)


_GC = "(length({0})-length(translate({0},'GC','')))"
_GCP = "floor((length(s)-length(translate(s,'GC','')))/length(s)*1000.0+0.5)/10.0"
_H = "CASE substr(s,i,2) " + " ".join(f"WHEN '{p}' THEN {h}" for p, (h, _) in NN_PARAMS.items()) + " ELSE 0 END"
_S = "CASE substr(s,i,2) " + " ".join(f"WHEN '{p}' THEN {round(10 * x)}" for p, (_, x) in NN_PARAMS.items()) + " ELSE 0 END"
_RUN4 = "(contains(s,'AAAA') OR contains(s,'CCCC') OR contains(s,'GGGG') OR contains(s,'TTTT'))"
_LOW = ("((length(s) >= 20 AND len(list_distinct(string_split(s,''))) <= 2) OR regexp_matches(s,'^((AT)+|(TA)+|(GC)+|(CG)+)$') OR "
        + " OR ".join(f"contains(s, repeat('{a}{b}',4))" for a in "ACGT" for b in "ACGT") + ")")


def run_sql(left: str, right: str) -> str:
    """Longest shared run of ``left`` and the reverse complement of ``right``, by trying every substring."""
    return (f"coalesce(list_max(list_transform(range(1, length({left})+1), lambda k: CASE WHEN len(list_filter(range(1, length({left})-k+2),"
            f" lambda i: contains(translate(reverse({right}),'ACGT','TGCA'), substr({left}, i, k)))) > 0 THEN k ELSE 0 END)), 0)")


_HAIR = ("coalesce(list_max(list_transform(range(1, 12), lambda k: CASE WHEN len(list_filter(range(1, greatest(1, length(s)-2*k-1)),"
         " lambda i: contains(substr(s, i+k+3), translate(reverse(substr(s, i, k)),'ACGT','TGCA')))) > 0 THEN k ELSE 0 END)), 0)")
_QC = f""", q0 AS MATERIALIZED (SELECT DISTINCT s FROM o),
q1 AS MATERIALIZED (SELECT s, {_GCP} AS gc, {_RUN4} AS run4, {_LOW} AS low, {run_sql('s', 's')} AS self_run, {run_sql('right(s,8)', 'right(s,8)')} AS self_three,
 {_HAIR} AS hairpin, list_sum(list_transform(range(1, length(s)), lambda i: {_H})) AS h, list_sum(list_transform(range(1, length(s)), lambda i: {_S})) AS d,
 list_sum(list_transform(range(length(s)-4, length(s)), lambda i: {_H})) AS h3, list_sum(list_transform(range(length(s)-4, length(s)), lambda i: {_S})) AS d3,
 {_GC.format('right(s,3)')} AS clamp, {_GC.format('right(s,5)')} AS gc5 FROM q0),
q2 AS MATERIALIZED (SELECT *, floor((h3 - 310.15e0 * (d3 / 10.0e0)) / 1000.0e0 * 100.0e0 + 0.5e0) / 100.0e0 AS dg3,
 1.0e0 / ((200.0e0 + h) / ((-57.0e0 + d) / 10.0e0 + 1.987e0 * ln(250e-9 / 4))) + 3.92e-5 - 9.11e-6 * ln(1.5e-3)
 + ({_GC.format('s')} / CAST(length(s) AS DOUBLE)) * (6.26e-5 + 1.42e-5 * ln(1.5e-3)) + (1.0e0 / (2.0e0 * (length(s)-1))) * (-4.82e-4 + 5.25e-4 * ln(1.5e-3) + 8.31e-5 * ln(1.5e-3) * ln(1.5e-3)) AS inv FROM q1),
q3 AS MATERIALIZED (SELECT *, floor((1.0e0/inv - 273.15e0) * 10.0e0 + 0.5e0) / 10.0e0 AS tm FROM q2),
q AS MATERIALIZED (SELECT *, floor((abs(gc-50)/4 + abs(tm-60)/3 + CASE WHEN run4 THEN 8 ELSE 0 END + CASE WHEN low THEN 10 ELSE 0 END + CASE WHEN dg3 > -1 THEN 6 WHEN dg3 < -10 THEN 4 ELSE 0 END
 + greatest(0, self_run-3)*2.5e0 + greatest(0, self_three-2)*5 + greatest(0, hairpin-3)*3)*10.0e0 + 0.5e0)/10.0e0 AS penalty FROM q3)
"""


def assessed(spark, sf):
    return sq.with_assessment(mixed(spark, sf), "s")


@query("seq_1_reverse_complement", _o("SELECT seq_id, p, translate(reverse(s),'ACGT','TGCA') AS rc, 'N' || translate(reverse(s),'ACGT','TGCA') AS rc_n FROM o"))
def seq_1(spark, sf):
    s = F.col("s")
    return oligos(spark, sf).select("seq_id", "p", sq.revcomp(s).alias("rc"), sq.revcomp(F.concat(s, F.lit("x"))).alias("rc_n"))


_AA = "CASE c " + " ".join(f"WHEN '{c}' THEN '{'Stop' if a == '*' else a}'" for c, a in sorted(CODON_TO_AA.items())) + " ELSE '?' END"


@query("seq_2_translate", _o(f"SELECT seq_id, p, array_to_string(list_transform(list_transform(range(0, length(s)//3), lambda i: substr(s, CAST(3*i+1 AS INT), 3)), lambda c: {_AA}), '') AS aa FROM o"))
def seq_2(spark, sf):
    return oligos(spark, sf).select("seq_id", "p", F.array_join(sq.residues(F.col("s")), "").alias("aa"))


@query("seq_3_gc", _o(f"SELECT seq_id, p, {_GCP} AS gc, CAST(floor({_GC.format('s')}/length(s)*100.0+0.5) AS BIGINT) AS gc_int, {_GC.format('s')} AS gc_count FROM o"))
def seq_3(spark, sf):
    s = F.col("s")
    return mixed(spark, sf).select("seq_id", "p", sq.gc_percent(s).alias("gc"), sq.gc_percent_int(s).alias("gc_int"),
                                    sq.gc_count(s).alias("gc_count"))


@query("seq_4_melting_temperature", _o(_QC + "SELECT seq_id, p, tm FROM o JOIN q USING (s)"))
def seq_4(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", oligo_tm(F.col("s")).alias("tm"))


@query("seq_5_three_prime_dg", _o(_QC + "SELECT seq_id, p, dg3 FROM o JOIN q USING (s)"))
def seq_5(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.three_prime_dg(F.col("s")).alias("dg3"))


@query("seq_6_homopolymer", _o(f"SELECT seq_id, p, {_RUN4} AS run4 FROM o"))
def seq_6(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.has_homopolymer(F.col("s")).alias("run4"))


@query("seq_7_three_prime_clamp", _o(_QC + "SELECT seq_id, p, clamp, gc5 FROM o JOIN q USING (s)"))
def seq_7(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.clamp_count(F.col("s")).alias("clamp"), sq.three_prime_gc(F.col("s")).alias("gc5"))


@query("seq_8_low_complexity", _o(f"SELECT seq_id, p, {_LOW} AS low FROM o"))
def seq_8(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.low_complexity(F.col("s")).alias("low"))


@query("seq_9_complement_run", _o(f"SELECT seq_id, p, {run_sql('s', 's2')} AS run FROM o"))
def seq_9(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.complement_run(F.col("s"), F.col("s2")).alias("run"))


@query("seq_10_three_prime_run", _o(f"SELECT seq_id, p, {run_sql('right(s,8)', 'right(s2,8)')} AS run FROM o"))
def seq_10(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.three_prime_complement_run(F.col("s"), F.col("s2")).alias("run"))


@query("seq_11_hairpin_run", _o(f"SELECT seq_id, p, {_HAIR} AS run FROM o"))
def seq_11(spark, sf):
    return mixed(spark, sf).select("seq_id", "p", sq.hairpin_run(F.col("s")).alias("run"))


@query("seq_12_primer_penalty", _o(_QC + "SELECT seq_id, p, penalty FROM o JOIN q USING (s)"))
def seq_12(spark, sf):
    return assessed(spark, sf).select("seq_id", "p", "penalty")


_WARN = """array_to_string(list_filter([CASE WHEN run4 THEN 'homopolymer run' END, CASE WHEN low THEN 'low complexity' END, CASE WHEN self_three >= 4 THEN '3'' self-dimer risk' END,
 CASE WHEN self_run >= 6 THEN 'self-dimer risk' END, CASE WHEN hairpin >= 5 THEN 'hairpin risk' END, CASE WHEN dg3 > -1 THEN 'weak 3'' clamp' END, CASE WHEN dg3 < -10 THEN 'over-stable 3'' end' END], lambda x: x IS NOT NULL), '; ')"""


@query("seq_13_primer_assessment", _o(_QC + f"""SELECT seq_id, p, s, length(s) AS len, gc, tm, dg3, clamp, self_run, self_three, hairpin, penalty,
 CASE WHEN penalty <= 6 THEN 'high' WHEN penalty <= 14 THEN 'medium' ELSE 'review' END AS status, {_WARN} AS warnings FROM o JOIN q USING (s)"""))
def seq_13(spark, sf):
    return assessed(spark, sf).select("seq_id", "p", F.upper("s").alias("s"), "len", "gc", "tm", "dg3", "clamp", "self_run", "self_three", "hairpin",
                                      "penalty", "status", F.array_join("warnings", "; ").alias("warnings"))


_PAIR = f""", o2 AS (SELECT a.seq_id, a.p, a.s AS f, b.s AS r FROM o a JOIN o b ON b.seq_id = a.seq_id AND b.p = a.p + 80),
pq AS MATERIALIZED (SELECT seq_id, p, f, r, {run_sql('f', 'r')} AS hetero, {run_sql('right(f,8)', 'right(r,8)')} AS hetero_three FROM o2),
pp AS MATERIALIZED (SELECT x.*, a.tm AS tf, b.tm AS tr, a.gc AS gf, b.gc AS gr, a.clamp AS cf, b.clamp AS cr,
 floor((a.penalty + b.penalty + greatest(0, hetero-4)*3 + greatest(0, hetero_three-2)*7 + abs(a.tm-b.tm)/2)*10.0e0+0.5e0)/10.0e0 AS pen FROM pq x JOIN q a ON a.s = x.f JOIN q b ON b.s = x.r)
"""


def oligo_pairs(spark, sf):
    o = mixed(spark, sf)
    left = o.select("seq_id", "p", F.col("s").alias("fw_seq"))
    right = o.select("seq_id", (F.col("p") - 80).alias("p"), F.col("s").alias("rev_seq"))
    from ..operators.primers import with_quality
    return with_quality(left.join(right, ["seq_id", "p"]))


@query("seq_14_pair_quality", _o(_QC + _PAIR + """SELECT seq_id, p, hetero, hetero_three, pen AS pair_penalty, floor(abs(tf-tr)*10.0e0+0.5e0)/10.0e0 AS tm_delta,
 CASE WHEN pen <= 14 THEN 'high' WHEN pen <= 26 THEN 'medium' ELSE 'review' END AS confidence FROM pp"""))
def seq_14(spark, sf):
    return oligo_pairs(spark, sf).select("seq_id", "p", "hetero", "hetero_three", "pair_penalty", "tm_delta", "confidence")


@query("seq_15_pair_score", _o(_QC + _PAIR + """SELECT seq_id, p, floor((-(abs(tf-60)+abs(tr-60)) - (abs(gf-50)+abs(gr-50))/10 + (cf+cr)*2 - abs(480-475)/100.0e0 - pen/8 - 0.4e0)*100.0e0+0.5e0)/100.0e0 AS score FROM pp"""))
def seq_15(spark, sf):
    c = F.col
    return oligo_pairs(spark, sf).select("seq_id", "p", sq.pair_score(
        c("fw_tm"), c("rev_tm"), c("fw_gc"), c("rev_gc"), c("fw_clamp"), c("rev_clamp"), F.lit(480), F.lit(475),
        c("pair_penalty"), F.lit(0.4)).alias("score"))


@query("seq_16_simple_primer_score", _o(f"""SELECT seq_id, p, abs({_GC.format('s')}/CAST(length(s) AS DOUBLE)*100.0e0 - 50) + CASE WHEN regexp_matches(s,'A{{5}}|C{{5}}|G{{5}}|T{{5}}') THEN 20 ELSE 0 END
 + CASE WHEN contains(s,'AAAA') OR contains(s,'TTTT') THEN 6 ELSE 0 END + CASE WHEN right(s,1) IN ('G','C') THEN 0 ELSE 4 END AS score FROM o"""))
def seq_16(spark, sf):
    return oligos(spark, sf).select("seq_id", "p", sq.simple_primer_score(F.col("s")).alias("score"))


@query("seq_17_suffix_match", with_views("fx_hsps", """SELECT hsp_id, CASE WHEN length(qseq) <> length(hseq) THEN 0 ELSE coalesce(list_min(list_filter(range(1, length(qseq)+1),
 lambda i: substr(reverse(qseq), i, 1) <> substr(reverse(hseq), i, 1))) - 1, length(qseq)) END AS suffix FROM fx_hsps"""))
def seq_17(spark, sf):
    return view(spark, sf, "fx_hsps").select("hsp_id", sq.suffix_match(F.col("qseq"), F.col("hseq")).cast("bigint").alias("suffix"))


@query("seq_18_apply_edits", _o("SELECT seq_id, p, substr(s,1,4) || 'A' || substr(s,6,3) || 'C' || substr(s,10) AS edited, substr(s,1,6) || 'GGTACC' || substr(s,7) AS inserted FROM o"))
def seq_18(spark, sf):
    s = F.col("s")
    edits = F.array(*[F.struct(F.lit(g).alias("gp"), F.lit(b).alias("base")) for g, b in ((104, "A"), (108, "C"), (400, "T"))])
    from ..operators.donors import apply_to_arm
    return oligos(spark, sf).select("seq_id", "p", apply_to_arm(s, F.lit(100), edits).alias("edited"),
                                    sq.put_insert(s, F.lit(6), F.lit("GGTACC")).alias("inserted"))


@query("seq_19_differences", _o("""SELECT seq_id, p, array_to_string(list_filter(range(0, 18), lambda i: substr(s, CAST(i+1 AS INT), 1) <> substr(s2, CAST(i+1 AS INT), 1)), ',') AS bases,
 array_to_string(list_filter(range(0, 6), lambda i: substr(s, CAST(3*i+1 AS INT), 3) <> substr(s2, CAST(3*i+1 AS INT), 3)), ',') AS codons FROM o WHERE length(s) >= 18"""))
def seq_19(spark, sf):
    a, b = F.left(F.col("s"), F.lit(18)), F.left(F.col("s2"), F.lit(18))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return oligos(spark, sf).where(F.length("s") >= 18).select(
        "seq_id", "p", text(sq.diff_positions(a, b)).alias("bases"), text(sq.diff_items(sq.codons(a), sq.codons(b))).alias("codons"))


@query("seq_20_mirror_positions", _o("""SELECT seq_id, p, CAST(length(s) - 1 - (p % 7) AS VARCHAR) || ',' || CAST(length(s) - 1 AS VARCHAR) AS mirrored,
 length(s) - 12 AS site_start, length(s) - 2 AS site_end FROM o WHERE p % 7 > 0"""))
def seq_20(spark, sf):
    n = F.length("s")
    return oligos(spark, sf).where("p % 7 > 0").select(
        "seq_id", "p", F.array_join(sq.mirror_positions(F.array(F.lit(0).cast("bigint"), F.col("p") % 7), n).cast("array<string>"), ",").alias("mirrored"),
        (n - 12).alias("site_start"), (n - 2).alias("site_end"))


@query("seq_21_arm_regions", _o("""SELECT seq_id, p, CASE WHEN p % 127 < 91 THEN '91 bp arm' ELSE '36 bp arm' END AS ordered, CASE WHEN p % 127 < 36 THEN '36 bp arm' ELSE '91 bp arm' END AS opposite FROM o"""))
def seq_21(spark, sf):
    at = F.col("p") % 127
    return oligos(spark, sf).select("seq_id", "p", sq.region_of(at, sq.arm_regions(F.lit(127), True)).alias("ordered"),
                                    sq.region_of(at, sq.arm_regions(F.lit(127), False)).alias("opposite"))


@query("seq_22_arm_side", _o("SELECT seq_id, p, CASE WHEN (CASE WHEN p % 2 = 0 THEN 900 > p ELSE 900 < p END) THEN 'PROX' ELSE 'DIST' END AS side FROM o"))
def seq_22(spark, sf):
    strand = F.when(F.col("p") % 2 == 0, "+").otherwise("-")
    return oligos(spark, sf).select("seq_id", "p", sq.arm_side(strand, F.col("p"), F.lit(900)).alias("side"))


@query("seq_23_locus_key", with_views("fx_hsps", "SELECT hsp_id, accession || ':' || CAST(least(hit_from, hit_to) AS VARCHAR) || '-' || CAST(greatest(hit_from, hit_to) AS VARCHAR) AS locus FROM fx_hsps"))
def seq_23(spark, sf):
    return view(spark, sf, "fx_hsps").select("hsp_id", sq.locus_key(F.col("accession"), F.col("hit_from"), F.col("hit_to")).alias("locus"))


@query("prj_6_clean_dna", """SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^ACGT]', '', 'g') AS dna, regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^ACGTN]', '', 'g') AS dna_n FROM documents""")
def prj_6(spark, sf):
    from .fixtures import table
    plain = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf, "documents").select("doc_id", sq.clean_dna(plain).alias("dna"), sq.clean_dna(plain, True).alias("dna_n"))


@query("flt_3_candidate_filter", _o(_QC + f"""SELECT seq_id, p FROM o JOIN q USING (s) WHERE length(s) BETWEEN 18 AND 26 AND NOT contains(s,'N') AND gc BETWEEN 38 AND 67 AND NOT run4
 AND tm BETWEEN 55 AND 67 AND self_three < 4 AND hairpin < 6 AND penalty <= 22"""))
def flt_3(spark, sf):
    return assessed(spark, sf).where(
        "len between 18 and 26 and not contains(s, 'N') and gc between 38 and 67 and not run4 and tm between 55 and 67 "
        "and self_three < 4 and hairpin < 6 and penalty <= 22").select("seq_id", "p")
