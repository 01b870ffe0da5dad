"""Coordinates, guide sites, guide choice, pairs, blocking edits and donors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..functions.fixed import CODON_TO_AA
from ..operators import donors as dn
from ..operators import genome as gn
from ..operators import guides as gd
from ..session import staging_folder
from ..sources import dims
from ..sources import models as md
from .fixtures import models, table, view, with_views
from .registry import query

_RC = "translate(reverse({x}),'ACGT','TGCA')"
_AA = "CASE {c} " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in sorted(CODON_TO_AA.items())) + " ELSE '?' END"

SITES = """, w AS MATERIALIZED (SELECT seq_id, p AS ps, substr(seq, CAST(p+1 AS INT), 23) AS w FROM (SELECT seq_id, seq, unnest(range(0, length(seq)-22)) AS p FROM fx_sequences)),
sites AS MATERIALIZED (SELECT *, CAST(floor((20-length(translate(spacer,'GC','')))/20.0*100+0.5) AS INT) AS gc FROM (
 SELECT seq_id, ps, '+' AS strand, substr(w,1,20) AS spacer, substr(w,21,3) AS pam, ps + 17 AS cut FROM w WHERE regexp_matches(substr(w,21,3), '^[ACGT]GG$')
 UNION ALL SELECT seq_id, ps, '-', translate(reverse(substr(w,4,20)),'ACGT','TGCA'), translate(reverse(substr(w,1,3)),'ACGT','TGCA'), ps + 6 FROM w WHERE regexp_matches(substr(w,1,3), '^CC[ACGT]$'))
 WHERE NOT contains(spacer,'TTTTT') AND NOT contains(spacer,'AAAAA'))
"""
CODING = f""", seg AS MATERIALIZED (SELECT seq_id, seg_idx, seg_start, seg_end, coalesce(sum(seg_end-seg_start) OVER (PARTITION BY seq_id ORDER BY seg_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM fx_cds_segments),
cod AS MATERIALIZED (SELECT seq_id, CAST(seg_start + i AS BIGINT) AS gp, CAST(cum + i AS BIGINT) AS cp, substr(seq, CAST(seg_start + i + 1 AS INT), 1) AS base, CAST((cum + i) // 3 + 1 AS INT) AS residue, CAST((cum + i) % 3 AS INT) AS frame
 FROM (SELECT s.*, f.seq, unnest(range(0, seg_end - seg_start)) AS i FROM seg s JOIN fx_sequences f USING (seq_id))),
codon AS MATERIALIZED (SELECT seq_id, residue, codon, {_AA.format(c='codon')} AS aa, g0 FROM (SELECT seq_id, residue, string_agg(base, '' ORDER BY cp) AS codon, min(gp) AS g0 FROM cod GROUP BY seq_id, residue HAVING count(*) = 3)),
cds AS MATERIALIZED (SELECT seq_id, string_agg(base, '' ORDER BY cp) AS cds FROM cod GROUP BY seq_id)
"""
# The four design targets of every sequence: stop codon, start codon, residue 50, site after residue 155.
TARGETS = """, tgt AS MATERIALIZED (SELECT seq_id, 'ct' AS kind, CAST(1517 AS BIGINT) AS target FROM fx_sequences UNION ALL SELECT seq_id, 'nt', 300 FROM fx_sequences
 UNION ALL SELECT seq_id, 'pm', gp FROM cod WHERE cp = 147 UNION ALL SELECT seq_id, 'it', gp FROM cod WHERE cp = 465),
near AS MATERIALIZED (SELECT t.seq_id, t.kind, t.target, s.* EXCLUDE (seq_id), cut - target AS d, abs(cut - target) AS dist FROM tgt t JOIN sites s ON s.seq_id = t.seq_id AND abs(s.cut - t.target) <= 30),
win AS (SELECT seq_id, kind, min(CASE WHEN dist <= 10 THEN 10 WHEN dist <= 20 THEN 20 ELSE 30 END) AS win FROM near GROUP BY seq_id, kind),
inw AS (SELECT n.*, w.win, row_number() OVER (PARTITION BY n.seq_id, n.kind ORDER BY dist, ps, strand) AS r, row_number() OVER (PARTITION BY n.seq_id, n.kind, strand ORDER BY dist, ps) AS rs,
 count(DISTINCT strand) OVER (PARTITION BY n.seq_id, n.kind) AS strands FROM near n JOIN win w USING (seq_id, kind) WHERE dist <= win),
pick AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id, kind ORDER BY CASE WHEN strands = 2 THEN CASE WHEN strand = '+' THEN 0 ELSE 1 END ELSE r END) AS gno FROM inw WHERE CASE WHEN strands = 2 THEN rs = 1 ELSE r <= 2 END)
"""
_ALL = "fx_sequences fx_cds_segments"


def g_sql(body, ctes=""):
    return with_views("fx_sequences fx_cds_segments fx_exons", ctes + body)


@query("gen_1_cds_assembly", g_sql("SELECT seq_id, cds, CAST(length(cds)//3 - 1 AS INT) AS protein_length FROM cds", CODING))
def gen_1(spark, sf):
    return models(spark, sf).select("seq_id", "cds", "protein_length")


@query("gen_2_coding_to_genomic", g_sql("SELECT seq_id, cp, gp FROM cod UNION ALL SELECT seq_id, 660, NULL FROM fx_sequences", CODING))
def gen_2(spark, sf):
    df = models(spark, sf).select("seq_id", "segs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("cds").cast("bigint"))).alias("cp"))
    return df.select("seq_id", "cp", gn.coding_to_genomic(F.col("segs"), F.col("cp")).alias("gp"))


@query("gen_3_genomic_to_residue", g_sql("SELECT s.seq_id, s.cut, c.residue FROM (SELECT DISTINCT seq_id, cut FROM sites) s LEFT JOIN cod c ON c.seq_id = s.seq_id AND c.gp = s.cut", SITES + CODING))
def gen_3(spark, sf):
    cuts = gn.scan_sequences(view(spark, sf, "fx_sequences")).select("seq_id", "cut").distinct()
    return cuts.join(models(spark, sf).select("seq_id", "segs"), "seq_id").select(
        "seq_id", "cut", gn.genomic_to_residue(F.col("segs"), F.col("cut")).alias("residue"))


@query("gen_4_codon_at_residue", g_sql("SELECT seq_id, residue, codon, aa, g0 FROM codon", CODING))
def gen_4(spark, sf):
    df = models(spark, sf).select("seq_id", "cds", "segs", F.explode(F.sequence(F.lit(1), F.floor(F.length("cds") / 3).cast("int"))).alias("residue"))
    r = F.col("residue")
    return df.select("seq_id", "residue", gn.codon_at(F.col("cds"), r).alias("codon"), gn.residue_at(F.col("cds"), r).alias("aa"),
                     gn.coding_to_genomic(F.col("segs"), (r - 1).cast("bigint") * 3).alias("g0"))


@query("gen_5_exon_for_segment", g_sql("""SELECT seq_id, seg_idx, exon_number FROM (SELECT s.seq_id, s.seg_idx, e.exon_number, row_number() OVER (PARTITION BY s.seq_id, s.seg_idx ORDER BY
 CASE WHEN e.exon_start <= s.seg_start - shift AND e.exon_end >= s.seg_end - shift THEN 0 ELSE 1 END, e.exon_start) AS r FROM (SELECT *, seq_id % 5 * 60 AS shift FROM fx_cds_segments) s JOIN fx_exons e ON e.seq_id = s.seq_id
 AND e.exon_end > s.seg_start - shift AND e.exon_start < s.seg_end - shift) WHERE r = 1"""))
def gen_5(spark, sf):
    shift = F.col("seq_id") % 5 * 60
    seg = view(spark, sf, "fx_cds_segments").join(models(spark, sf).select("seq_id", "exons"), "seq_id")
    x = gn.exon_for_segment(F.col("exons"), F.col("seg_start") - shift, F.col("seg_end") - shift)
    return seg.select("seq_id", "seg_idx", x["exon_number"].alias("exon_number")).where("exon_number is not null")


@query("gen_6_guide_scan", g_sql("SELECT seq_id, spacer, pam, strand, cut, gc, ps FROM sites", SITES))
def gen_6(spark, sf):
    return gn.scan_sequences(view(spark, sf, "fx_sequences")).select("seq_id", "spacer", "pam", "strand", "cut", "gc", "ps")


@query("gen_6_stored_tiles", g_sql("SELECT seq_id, spacer, pam, strand, cut, gc, ps FROM sites", SITES))
def gen_6b(spark, sf):
    """The scan from a stored tile table, as for sequences of chromosome size."""
    path = staging_folder(spark, "tiles")
    gn.write_tiles(view(spark, sf, "fx_sequences"), path)
    return gn.scan_tiles(spark.read.parquet(path)).select("seq_id", "spacer", "pam", "strand", "cut", "gc", "ps")


@query("join_4_tile_windows", g_sql("SELECT t.seq_id, t.kind, greatest(0, target - 300) AS bases_start, substr(seq, CAST(greatest(0, target - 300) + 1 AS INT), CAST(least(2016, target + 300) - greatest(0, target - 300) AS INT)) AS bases FROM tgt t JOIN fx_sequences USING (seq_id)", SITES + CODING + TARGETS))
def join_4b(spark, sf):
    """Reference windows around design targets, cut from stored tiles."""
    path = staging_folder(spark, "tiles")
    gn.write_tiles(view(spark, sf, "fx_sequences"), path)
    t = targets(models(spark, sf)).select("seq_id", "kind", "target")
    return gn.tile_windows(spark.read.parquet(path), t, 300).select("seq_id", "kind", "bases_start", "bases")


_ANY = """, anys AS (SELECT seq_id, ps, '+' AS strand, substr(w,1,20) AS spacer, ps + 17 AS cut FROM w WHERE substr(w,22,2) = 'GG' UNION ALL
 SELECT seq_id, ps, '-', translate(reverse(substr(w,4,20)),'ACGT','TGCA'), ps + 6 FROM w WHERE substr(w,1,2) = 'CC'),
want AS (SELECT seq_id, spacer, rn FROM (SELECT seq_id, spacer, row_number() OVER (PARTITION BY seq_id ORDER BY md5(spacer), spacer) AS rn FROM (SELECT DISTINCT seq_id, spacer FROM anys)) WHERE rn <= 5
 UNION ALL SELECT seq_id, substr(translate(md5(CAST(seq_id AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20), 6 FROM fx_sequences)"""


def wanted_spacers(spark, sf):
    """Five spacers of every sequence, chosen by hash, and one that (nearly always) does not occur."""
    seqs = view(spark, sf, "fx_sequences")
    own = gn.scan_sequences(seqs, any_pam=True, drop_runs=False).select("seq_id", "spacer").distinct()
    w = Window.partitionBy("seq_id").orderBy(F.md5("spacer"), "spacer")
    own = own.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    alien = F.substring(F.translate(F.md5(F.col("seq_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 20)
    # Asked spacers are a table of their own in use; here they are derived, so they are written once.
    path = staging_folder(spark, "spacers")
    own.unionByName(seqs.select("seq_id", alien.alias("spacer"), F.lit(6).alias("rn"))).write.parquet(path)
    return spark.read.parquet(path)


@query("gen_7_spacer_match", g_sql("SELECT a.seq_id, a.spacer, rn, strand, cut, ps FROM want JOIN anys a USING (seq_id, spacer)", SITES + _ANY))
def gen_7(spark, sf):
    return gn.match_spacers(view(spark, sf, "fx_sequences"), wanted_spacers(spark, sf)).select("seq_id", "spacer", "rn", "strand", "cut", "ps")


_CTX = """, ex AS (SELECT *, lead(exon_start) OVER (PARTITION BY seq_id ORDER BY exon_start) AS nxt, lead(exon_number) OVER (PARTITION BY seq_id ORDER BY exon_start) AS nn FROM fx_exons),
aso AS (SELECT s.*, e.exon_number, e.exon_start, e.exon_end, e.nxt, e.nn FROM sites s LEFT JOIN ex e ON e.seq_id = s.seq_id AND s.cut >= e.exon_start AND (e.nxt IS NULL OR s.cut < e.nxt)),
ctx AS MATERIALIZED (SELECT seq_id, ps, strand, cut, CASE WHEN exon_number IS NULL THEN 'upstream of CDS' WHEN cut < exon_end THEN 'exon ' || CAST(exon_number AS VARCHAR) WHEN nxt IS NOT NULL THEN 'intron between exon ' || CAST(exon_number AS VARCHAR) || ' and exon ' || CAST(nn AS VARCHAR) ELSE 'downstream of CDS' END AS label,
 CASE WHEN exon_number IS NULL THEN CAST(250 - cut AS VARCHAR) || ' bp upstream of exon 1' WHEN cut < exon_end THEN CAST(cut - exon_start AS VARCHAR) || ' bp into exon ' || CAST(exon_number AS VARCHAR)
  WHEN nxt IS NULL OR cut - exon_end <= nxt - cut THEN CAST(cut - exon_end AS VARCHAR) || ' bp downstream of exon ' || CAST(exon_number AS VARCHAR) ELSE CAST(nxt - cut AS VARCHAR) || ' bp upstream of exon ' || CAST(nn AS VARCHAR) END AS detail FROM aso)
"""


def sites_with_regions(spark, sf):
    sites = gn.scan_sequences(view(spark, sf, "fx_sequences"))
    return sites.join(models(spark, sf).select("seq_id", gn.regions_of(F.col("exons"), F.col("segs")).alias("regions")), "seq_id")


@query("gen_8_cut_context", g_sql("SELECT seq_id, ps, strand, label, detail FROM ctx", SITES + _CTX))
def gen_8(spark, sf):
    return sites_with_regions(spark, sf).withColumn("c", gn.cut_context(F.col("regions"), F.col("cut"))).select(
        "seq_id", "ps", "strand", "c.label", "c.detail")


_PLACE = """, ov AS (SELECT s.seq_id, s.ps, s.strand, count(e.exon_number) AS n, min(e.exon_number) AS e1, max(e.exon_number) AS e2, bool_and(s.ps >= e.exon_start AND s.ps + 23 <= e.exon_end) AS inside
 FROM sites s LEFT JOIN fx_exons e ON e.seq_id = s.seq_id AND s.ps < e.exon_end AND s.ps + 23 > e.exon_start GROUP BY ALL),
place AS MATERIALIZED (SELECT seq_id, ps, strand, CASE WHEN n = 1 AND inside THEN 'exonic (exon ' || CAST(e1 AS VARCHAR) || ')' WHEN n = 1 THEN 'crosses exon ' || CAST(e1 AS VARCHAR) || ' boundary' WHEN n > 1 THEN 'crosses exon boundary'
 WHEN ps + 23 <= 250 THEN 'upstream of CDS' WHEN ps >= 1700 THEN 'downstream of CDS' ELSE 'intronic' END AS label,
 CASE WHEN n = 1 AND inside THEN 'Guide spans 23 bp within exon ' || CAST(e1 AS VARCHAR) || '.' WHEN n = 1 THEN 'Guide overlaps exon ' || CAST(e1 AS VARCHAR) || ' and adjacent noncoding sequence.'
 WHEN n > 1 THEN 'Guide spans exon ' || CAST(e1 AS VARCHAR) || ' to exon ' || CAST(e2 AS VARCHAR) || '.' WHEN ps + 23 <= 250 THEN 'Guide lies upstream of exon 1.' WHEN ps >= 1700 THEN 'Guide lies downstream of exon 4.'
 ELSE 'Guide lies in the intron between exon ' || (SELECT CAST(max(exon_number) AS VARCHAR) FROM fx_exons e WHERE e.seq_id = ov.seq_id AND e.exon_end <= ov.ps) || ' and exon ' || (SELECT CAST(min(exon_number) AS VARCHAR) FROM fx_exons e WHERE e.seq_id = ov.seq_id AND e.exon_start >= ov.ps + 23) || '.' END AS detail FROM ov)
"""


@query("gen_9_guide_placement", g_sql("SELECT seq_id, ps, strand, label, detail FROM place", SITES + _PLACE))
def gen_9(spark, sf):
    return sites_with_regions(spark, sf).withColumn("c", gn.guide_placement(F.col("regions"), F.col("ps"))).select(
        "seq_id", "ps", "strand", "c.label", "c.detail")


# --- near targets --------------------------------------------------------------------------------

def targets(m):
    gp = lambda cp: gn.coding_to_genomic(F.col("segs"), F.lit(cp).cast("bigint"))
    last = F.element_at("segs", -1)["end"] - 3
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("target")) for k, t in (
        ("ct", last), ("nt", F.get("segs", F.lit(0))["start"]), ("pm", gp(147)), ("it", gp(465)))])
    return m.select("*", F.inline(kinds))


def near_picks(spark, sf):
    """Targets with their chosen guides, reference window and model columns."""
    t = targets(models(spark, sf))
    low = F.greatest(F.lit(0).cast("bigint"), F.col("target") - 250)
    t = t.withColumns({"bases_start": low, "bases": F.substring("seq", low.cast("int") + 1, F.lit(500))}).drop("seq")
    ref = gd.Reference(F.col("bases"), F.col("bases_start"), F.col("seq_len"))
    return gd.with_insert_guides(t, ref, F.col("target")), ref


def near_guides(spark, sf):
    df, ref = near_picks(spark, sf)
    out = df.select("*", F.posexplode("guides").alias("gno", "g")).withColumn("gno", F.col("gno") + 1)
    return out, ref


@query("join_4_guides_near_target", g_sql("SELECT seq_id, kind, target, ps, strand, cut, d FROM near", SITES + CODING + TARGETS))
def join_4(spark, sf):
    t = targets(models(spark, sf)).select("seq_id", "kind", "target")
    return gd.guides_near_targets(gn.scan_sequences(view(spark, sf, "fx_sequences")), t, 30).select(
        "seq_id", "kind", "target", "ps", "strand", "cut", "d")


@query("join_5_widening_windows", g_sql("""SELECT t.seq_id, t.kind, CAST(w.win AS INT) AS guide_window, CASE w.win WHEN 10 THEN 'preferred' WHEN 20 THEN 'fallback' WHEN 30 THEN 'distant fallback' END AS guide_tier
 FROM tgt t LEFT JOIN win w USING (seq_id, kind)""", SITES + CODING + TARGETS))
def join_5(spark, sf):
    return near_picks(spark, sf)[0].select("seq_id", "kind", "guide_window", "guide_tier")


@query("win_5_best_by_strand", g_sql("SELECT seq_id, kind, CAST(gno AS INT) AS gno, spacer, pam, strand, cut, d, gc FROM pick", SITES + CODING + TARGETS))
def win_5(spark, sf):
    return near_guides(spark, sf)[0].select("seq_id", "kind", "gno", "g.spacer", "g.pam", "g.strand", "g.cut", "g.d", "g.gc")


@query("prj_19_guide_notes", g_sql("""SELECT p.seq_id, p.kind, CAST(gno AS INT) AS gno, 'Cut ' || CAST(dist AS VARCHAR) || ' bp ' || CASE WHEN d < 0 THEN '5-prime' ELSE '3-prime' END || ' of stop | ' || tw AS insert_note,
 'Cut-to-edit distance ' || CAST(dist AS VARCHAR) || ' bp | ' || tw AS edit_note, 'Cut-to-insert distance ' || CAST(dist AS VARCHAR) || ' bp | ' || tw || ' | ' || l.label || ': ' || l.detail AS internal_note
 FROM (SELECT *, CASE win WHEN 10 THEN 'preferred window' WHEN 20 THEN 'fallback window' ELSE 'distant fallback' END || ' <=' || CAST(win AS VARCHAR) || ' bp' AS tw FROM pick) p
 JOIN place l ON l.seq_id = p.seq_id AND l.ps = p.ps AND l.strand = p.strand""", SITES + CODING + TARGETS + _PLACE))
def prj_19(spark, sf):
    from ..functions import norm
    df, _ = near_guides(spark, sf)
    g, t, w = F.col("g"), F.col("guide_tier"), F.col("guide_window")
    place = gn.guide_placement(gn.regions_of(F.col("exons"), F.col("segs")), g["ps"])
    return df.withColumn("pl", place).select(
        "seq_id", "kind", "gno", norm.insert_guide_note(g["d"], F.lit("stop"), t, w).alias("insert_note"),
        norm.edit_guide_note(g["d"], t, w).alias("edit_note"),
        F.concat(norm.internal_guide_note(g["d"], t, w), F.lit(" | "), F.col("pl.label"), F.lit(": "), F.col("pl.detail")).alias("internal_note"))


@query("join_16_replacement_overlap", g_sql("SELECT seq_id, kind, CAST(gno AS INT) AS gno, ps < target + 3 AND ps + 23 > target AS overlaps FROM pick", SITES + CODING + TARGETS))
def join_16(spark, sf):
    return near_guides(spark, sf)[0].select("seq_id", "kind", "gno", gd.overlaps_span(F.col("g"), F.col("target"), F.col("target") + 3).alias("overlaps"))


# --- knockout pairs ------------------------------------------------------------------------------

PAIRS = """, ks AS (SELECT s.seq_id, s.seg_idx - 1 AS seg_no, s.seg_start, s.seg_end, g.spacer, g.strand, g.cut, g.gc, g.ps, (100 - g.gc) * 1000000 + g.ps * 2 + CASE WHEN strand = '+' THEN 0 ELSE 1 END AS ord
 FROM fx_cds_segments s JOIN sites g ON g.seq_id = s.seq_id AND abs(g.cut - (s.seg_start + s.seg_end) // 2) <= (s.seg_end - s.seg_start) // 2 + 10 AND g.cut BETWEEN s.seg_start - 25 AND s.seg_end + 25 WHERE s.seg_idx IN (2, 3)),
prs AS MATERIALIZED (SELECT a.seq_id, a.seg_no, a.seg_start, a.seg_end, a.spacer AS l_spacer, b.spacer AS r_spacer, a.cut AS l_cut, b.cut AS r_cut, a.ps AS l_ps, b.ps AS r_ps, a.strand AS l_strand, b.strand AS r_strand, b.cut - a.cut AS spacing, b.cut - a.cut BETWEEN 40 AND 140 AS preferred,
 a.strand <> b.strand AS opposite, a.gc + b.gc AS pair_score, least(a.ord, b.ord) AS o1, greatest(a.ord, b.ord) AS o2 FROM ks a JOIN ks b ON a.seq_id = b.seq_id AND a.seg_no = b.seg_no AND b.cut BETWEEN a.cut AND a.cut + 140 AND (b.cut > a.cut OR a.ord < b.ord)),
bp AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, seg_no ORDER BY preferred DESC, opposite DESC, pair_score DESC, CASE WHEN preferred THEN abs(spacing - 90) ELSE -spacing END, o1, o2) AS r FROM prs) WHERE r = 1),
bs AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY opposite DESC, seg_end - seg_start DESC, pair_score DESC, spacing, seg_no) AS r2 FROM bp) WHERE r2 = 1)
"""


@query("join_6_knockout_pairs", g_sql("SELECT seq_id, seg_no, l_ps, l_strand, r_ps, r_strand, spacing, preferred, opposite, pair_score FROM prs", SITES + PAIRS))
def join_6(spark, sf):
    return gd.segment_pairs(gd.segment_sites(gd.knockout_segments(models(spark, sf)))).select(
        "seq_id", "seg_no", "l_ps", "l_strand", "r_ps", "r_strand", "spacing", "preferred", "opposite", "pair_score")


@query("win_6_best_pair", g_sql("SELECT seq_id, seg_no, l_spacer, r_spacer, spacing, pair_score FROM bp", SITES + PAIRS))
def win_6(spark, sf):
    return gd.best_pair_per_segment(gd.segment_pairs(gd.segment_sites(gd.knockout_segments(models(spark, sf))))).select(
        "seq_id", "seg_no", "l_spacer", "r_spacer", "spacing", "pair_score")


@query("win_7_best_segment", g_sql("SELECT seq_id, seg_no, seg_start, seg_end, CAST(seg_no + 1 AS INT) AS exon_number, l_spacer, r_spacer, spacing FROM bs", SITES + PAIRS))
def win_7(spark, sf):
    return gd.knockout_targets(models(spark, sf)).select("seq_id", "seg_no", "seg_start", "seg_end", "exon_number", "l_spacer", "r_spacer", "spacing")


@query("agg_6_pair_summary", g_sql("SELECT seq_id, CAST(floor((l_cut + r_cut) / 2.0 + 0.5) AS BIGINT) AS cut_center, spacing, spacing > 1000 AS long_deletion FROM bs", SITES + PAIRS))
def agg_6(spark, sf):
    from ..plans.designs import pair_summary
    return pair_summary(gd.knockout_targets(models(spark, sf))).select("seq_id", "cut_center", "spacing", "long_deletion")


# --- custom guides -------------------------------------------------------------------------------

CUSTOM = """, cw AS (SELECT seq_id AS request_id, 1 AS guide_no, CASE WHEN seq_id % 3 = 0 THEN substr(translate(md5(CAST(seq_id AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) ELSE spacer END AS spacer FROM pick WHERE kind = 'pm' AND gno = 1
 UNION ALL SELECT seq_id, 2, CASE WHEN seq_id % 4 = 0 THEN 'ACGT' ELSE spacer END FROM pick WHERE kind = 'pm' AND gno = 2),
cm AS (SELECT c.*, a.ps, a.strand, a.cut, abs(a.cut - 626) AS dist, row_number() OVER (PARTITION BY request_id, guide_no ORDER BY abs(a.cut - 626), a.cut) AS r FROM cw c LEFT JOIN anys a ON a.seq_id = c.request_id AND a.spacer = c.spacer AND abs(a.cut - 626) <= 30),
ce AS (SELECT request_id, guide_no, ps, dist, CASE WHEN length(spacer) <> 20 THEN 'Custom gRNA "' || spacer || '" must be a 20 nt spacer.' WHEN ps IS NULL THEN 'Custom gRNA ' || spacer || ' does not map within 30 bp of the target site.' END AS e FROM cm WHERE r = 1)
"""


@query("join_14_custom_guides", g_sql("""SELECT request_id, coalesce(max(CASE WHEN guide_no = 1 THEN e END), max(CASE WHEN guide_no = 2 THEN e END)) AS err,
 CASE WHEN count(e) = 0 THEN string_agg(CAST(ps AS VARCHAR), ',' ORDER BY guide_no) END AS sites FROM ce GROUP BY request_id""", SITES + CODING + TARGETS + _ANY + CUSTOM))
def join_14(spark, sf):
    return custom_choice(spark, sf).select("request_id", "err", F.when(F.col("err").isNull(), F.array_join(
        F.transform("guides", lambda g: g["ps"].cast("string")), ",")).alias("sites"))


def custom_choice(spark, sf):
    g, _ = near_guides(spark, sf)
    g = g.where("kind = 'pm'")
    alien = F.substring(F.translate(F.md5(F.col("seq_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 20)
    spacer = F.when((F.col("gno") == 1) & (F.col("seq_id") % 3 == 0), alien).when((F.col("gno") == 2) & (F.col("seq_id") % 4 == 0), "ACGT").otherwise(F.col("g.spacer"))
    wanted = g.select("seq_id", F.col("seq_id").alias("request_id"), F.col("gno").alias("guide_no"), spacer.alias("spacer"), "target")
    found = gn.match_spacers(view(spark, sf, "fx_sequences"), wanted)
    return gd.resolve_custom_guides(found, wanted.drop("seq_id"), 30)


@query("agg_10_custom_window", g_sql("SELECT request_id, CASE WHEN count(e) = 0 THEN CAST(max(dist) AS INT) END AS guide_window FROM ce GROUP BY request_id", SITES + CODING + TARGETS + _ANY + CUSTOM))
def agg_10(spark, sf):
    return custom_choice(spark, sf).select("request_id", "guide_window")


# --- codons and blocking edits -------------------------------------------------------------------

@query("win_14_mutant_codon", g_sql(f""", aas AS (SELECT DISTINCT {_AA.format(c='c')} AS aa FROM (SELECT a || b || d AS c FROM (VALUES ('A'),('C'),('G'),('T')) x(a), (VALUES ('A'),('C'),('G'),('T')) y(b), (VALUES ('A'),('C'),('G'),('T')) z(d))),
allc AS (SELECT c, {_AA.format(c='c')} AS aa FROM (SELECT a || b || d AS c FROM (VALUES ('A'),('C'),('G'),('T')) x(a), (VALUES ('A'),('C'),('G'),('T')) y(b), (VALUES ('A'),('C'),('G'),('T')) z(d))),
ask AS (SELECT seq_id, residue, codon, (['R','K','S','W','L','*'])[residue % 6 + 1] AS mut FROM codon)
SELECT seq_id, residue, mut, c AS mutant FROM (SELECT a.*, l.c, row_number() OVER (PARTITION BY seq_id, residue ORDER BY hamming(a.codon, l.c), l.c) AS r FROM ask a JOIN allc l ON l.aa = a.mut) WHERE r = 1""", CODING))
def win_14(spark, sf):
    df = models(spark, sf).select("seq_id", "cds", F.explode(F.sequence(F.lit(1), F.floor(F.length("cds") / 3).cast("int"))).alias("residue"))
    mut = F.element_at(F.array(*[F.lit(a) for a in "RKSWL*"]), F.col("residue") % 6 + 1)
    df = df.withColumns({"codon": gn.codon_at(F.col("cds"), F.col("residue")), "mut": mut})
    return df.select("seq_id", "residue", "mut", gd.mutant_codon(F.col("codon"), F.col("mut")).alias("mutant"))


BLOCK = f""", bsite AS (SELECT p.seq_id, p.kind, p.gno, p.ps, p.strand, o AS ord, CASE WHEN o < 2 THEN CASE WHEN strand = '+' THEN ps + 21 + o ELSE ps + o END
  ELSE CASE WHEN strand = '+' THEN ps + si ELSE ps + 22 - si END END AS gp, CASE WHEN o < 2 THEN 'PAM' WHEN o < 12 THEN 'Seed pos ' || CAST(si + 1 AS VARCHAR) || '/20' ELSE 'Guide pos ' || CAST(si + 1 AS VARCHAR) || '/20' END AS lab
 FROM (SELECT *, CASE WHEN o < 12 THEN o + 8 ELSE o - 12 END AS si FROM (SELECT *, unnest(range(0, 22)) AS o FROM pick)) p),
bopt AS MATERIALIZED (SELECT b.*, n.nb, c.cp, c.residue, c.frame, k.codon, k.aa, substr(f.seq, CAST(b.gp+1 AS INT), 1) AS ob, CASE WHEN k.codon IS NOT NULL THEN substr(k.codon, 1, frame) || n.nb || substr(k.codon, frame + 2) END AS nc, f.seq
 FROM bsite b JOIN fx_sequences f USING (seq_id) CROSS JOIN (VALUES ('A'),('C'),('G'),('T')) n(nb) LEFT JOIN cod c ON c.seq_id = b.seq_id AND c.gp = b.gp LEFT JOIN codon k ON k.seq_id = b.seq_id AND k.residue = c.residue),
bok AS (SELECT *, {_AA.format(c='nc')} AS na FROM bopt WHERE nb <> ob),
"""


def block_sql(name, allow, extra=""):
    return f"""{name} AS MATERIALIZED (SELECT seq_id, kind, gno, gp, nb, CASE WHEN codon IS NULL THEN 'noncoding' ELSE 'p.' || aa || CAST(residue AS VARCHAR) || aa END AS label, coalesce(codon, ob) AS old, coalesce(nc, nb) AS new,
 CASE WHEN ord < 2 THEN 'PAM ' || CASE WHEN strand = '+' THEN substr(seq, CAST(ps+21 AS INT), 3) ELSE translate(reverse(substr(seq, CAST(ps+1 AS INT), 3)),'ACGT','TGCA') END || '->' ||
  CASE WHEN strand = '+' THEN substr(seq, CAST(ps+21 AS INT), CAST(ord+1 AS INT)) || nb || CASE WHEN ord = 0 THEN substr(seq, CAST(ps+23 AS INT), 1) ELSE '' END
   ELSE translate(reverse(CASE WHEN ord = 0 THEN nb || substr(seq, CAST(ps+2 AS INT), 2) ELSE substr(seq, CAST(ps+1 AS INT), 1) || nb || substr(seq, CAST(ps+3 AS INT), 1) END),'ACGT','TGCA') END ELSE lab END || CASE WHEN codon IS NULL THEN ' outside CDS' ELSE '' END AS purpose
 FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, kind, gno ORDER BY ord, nb) AS r FROM bok b WHERE (CASE WHEN codon IS NULL THEN {allow} ELSE na = aa END) {extra}) WHERE r = 1)"""


@query("win_15_blocking_edit", g_sql("SELECT *, true AS loose FROM loose UNION ALL SELECT *, false FROM strict", SITES + CODING + TARGETS + BLOCK + block_sql("loose", "true") + ", " + block_sql("strict", "false")))
def win_15(spark, sf):
    df, ref = near_guides(spark, sf)
    none = F.array().cast("array<bigint>")
    both = [gd.blocking_edit(ref, F.col("g"), F.col("cds"), F.col("segs"), none, loose) for loose in (True, False)]
    rows = F.array(*[F.struct(F.lit(l).alias("loose"), b.alias("b")) for l, b in zip((True, False), both)])
    out = df.select("seq_id", "kind", F.col("gno").cast("bigint").alias("gno"), F.inline(rows)).where("b is not null")
    return out.select("seq_id", "kind", "gno", "b.gp", F.col("b.base").alias("nb"), "b.label", "b.old", "b.new", "b.purpose", "loose")


# --- donors --------------------------------------------------------------------------------------

_START = "greatest(0, least(2016 - 127, CASE WHEN strand = '+' THEN cut - 36 ELSE cut - 91 END))"
_FLIP = "CASE WHEN strand = '+' THEN translate(reverse({x}),'ACGT','TGCA') ELSE {x} END"


def _overlay(x, i, b):
    return f"CASE WHEN {b} IS NOT NULL AND {i} BETWEEN 0 AND length({x}) - 1 THEN substr({x}, 1, CAST({i} AS INT)) || {b} || substr({x}, CAST({i} + 2 AS INT)) ELSE {x} END"


DON1 = f""", dw AS (SELECT p.*, {_START} AS ds, f.seq FROM pick p JOIN fx_sequences f USING (seq_id)),
d1 AS (SELECT dw.*, substr(dw.seq, CAST(ds+1 AS INT), 127) AS wt, s.gp AS sgp, s.nb AS snb FROM dw LEFT JOIN strict s USING (seq_id, kind, gno)),
d2 AS (SELECT *, {_overlay('wt', '(target - ds)', "'A'")} AS e1 FROM d1),
d3 AS MATERIALIZED (SELECT *, {_overlay('e1', '(coalesce(sgp, -1) - ds)', 'snb')} AS sense FROM d2)
"""


@query("don_1_edit_oligo", g_sql(f"""SELECT seq_id, kind, CAST(gno AS INT) AS gno, {_FLIP.format(x='sense')} AS donor, {_FLIP.format(x='wt')} AS wild_type,
 len(list_filter(range(1, 128), lambda i: substr(sense, i, 1) <> substr(wt, i, 1))) AS n_diffs, ps - ds AS site_start FROM d3""",
                               SITES + CODING + TARGETS + BLOCK + block_sql("strict", "false") + DON1))
def don_1(spark, sf):
    df, ref = near_guides(spark, sf)
    silent = gd.blocking_edit(ref, F.col("g"), F.col("cds"), F.col("segs"), F.array().cast("array<bigint>"), False)
    change = F.array(F.struct(F.col("target").alias("gp"), F.lit("").alias("wt"), F.lit("A").alias("alt")))
    df = df.withColumn("b", silent)
    df = df.withColumn("o", dn.edit_oligo(ref, F.col("g"), change, F.col("b"), F.col("cds"), F.col("segs")))
    return df.select("seq_id", "kind", "gno", "o.donor", "o.wild_type", F.size("o.diffs").cast("bigint").alias("n_diffs"),
                     F.col("o.site_start").cast("bigint").alias("site_start"))


_INS = "GACCGCGTGCGCGCCGTGAGCCATTGGAGCAGC"


@query("don_2_insert_oligo", g_sql(f""", x AS (SELECT *, substr(wt, 1, CAST(target - ds AS INT)) || '{_INS}' || substr(wt, CAST(target - ds + 1 AS INT)) AS raw, coalesce(sgp, -1) - ds + CASE WHEN sgp >= target THEN 33 ELSE 0 END AS si FROM d1),
y AS (SELECT *, {_overlay('raw', 'si', 'snb')} AS sense2 FROM x)
SELECT seq_id, kind, CAST(gno AS INT) AS gno, {_FLIP.format(x='sense2')} AS donor, CASE WHEN strand = '+' THEN 160 - (target - ds) - 33 ELSE target - ds END AS insert_start FROM y""",
                                 SITES + CODING + TARGETS + BLOCK + block_sql("strict", "true") + DON1))
def don_2(spark, sf):
    df, ref = near_guides(spark, sf)
    df = df.withColumn("b", gd.blocking_edit(ref, F.col("g"), F.col("cds"), F.col("segs"), F.array().cast("array<bigint>"), True))
    df = df.withColumn("o", dn.insert_oligo(ref, F.col("g"), F.col("target"), F.lit(_INS), F.col("b")))
    return df.select("seq_id", "kind", "gno", "o.donor", F.col("o.insert_start").cast("bigint").alias("insert_start"))


@query("gen_10_coding_donor_window", g_sql("""SELECT seq_id, kind, CAST(gno AS INT) AS gno, coalesce(string_agg(base, '' ORDER BY cp), '') AS coding_wt, coalesce(string_agg(pb, '' ORDER BY cp), '') AS coding_donor FROM (
 SELECT d.seq_id, d.kind, d.gno, c.cp, c.base, substr(d.pay, CAST(c.gp - d.ds + 1 AS INT), 1) AS pb, min(c.cp) OVER (PARTITION BY d.seq_id, d.kind, d.gno) AS c0, count(c.cp) OVER (PARTITION BY d.seq_id, d.kind, d.gno) AS n
 FROM (SELECT *, translate(wt, 'ACGT', 'CATG') AS pay FROM d1) d LEFT JOIN cod c ON c.seq_id = d.seq_id AND c.gp >= d.ds AND c.gp < d.ds + 127)
 WHERE cp IS NULL OR (cp - c0 >= (3 - c0 % 3) % 3 AND cp - c0 - (3 - c0 % 3) % 3 < ((n - (3 - c0 % 3) % 3) // 3) * 3) GROUP BY seq_id, kind, gno""",
                                          SITES + CODING + TARGETS + BLOCK + block_sql("strict", "false") + DON1))
def gen_10(spark, sf):
    df, ref = near_guides(spark, sf)
    start = dn.oligo_start(F.col("g"), F.col("seq_len"))
    df = df.withColumn("ds", start).withColumn("pay", F.translate(ref.slice(F.col("ds"), 127), "ACGT", "CATG"))
    df = df.withColumn("c", gn.coding_window(F.col("segs"), F.col("cds"), F.col("ds"), F.col("ds") + 127, F.col("pay")))
    return df.select("seq_id", "kind", "gno", "c.coding_wt", "c.coding_donor")


@query("win_16_offsets_and_gaps", g_sql("""SELECT s.seq_id, s.seg_idx, CAST(s.cum AS BIGINT) AS cum, lead(seg_start) OVER (PARTITION BY seq_id ORDER BY seg_start) - seg_end AS gap FROM seg s""", CODING))
def win_16(spark, sf):
    df = models(spark, sf).select("seq_id", "segs", F.posexplode("segs").alias("i", "s"))
    return df.select("seq_id", (F.col("i") + 1).alias("seg_idx"), "s.cum", (F.get("segs", F.col("i") + 1)["start"] - F.col("s.end")).alias("gap"))


@query("win_16_index_ranges", g_sql("""SELECT seq_id, min(gp) AS start, max(gp) + 1 AS "end" FROM (SELECT seq_id, gp, gp - row_number() OVER (PARTITION BY seq_id ORDER BY gp) AS g FROM
 (SELECT DISTINCT seq_id, gp FROM cod WHERE base IN ('A','C','G'))) GROUP BY seq_id, g""", CODING))
def win_16b(spark, sf):
    cod = gn.coding_positions(models(spark, sf)).where(F.col("base").isin("A", "C", "G"))
    return dn.index_ranges(cod, ["seq_id"], "gp")


# --- cassettes and insert checks -----------------------------------------------------------------

def values(rows, names):
    lit = lambda v: "NULL" if v is None else (str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'")
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


_INSERTS = values(dims.insert_rows(), "insert_name, terminus, insert_seq, insert_order")
_SEGS = values(dims.segment_rows(), "insert_name, terminus, seg_no, label, role, seg_start, seg_seq, protein_label, protein")
_N = len(dims.cassette_names())
_DES = f""", ins AS MATERIALIZED {_INSERTS}, sg AS MATERIALIZED {_SEGS},
dr AS (SELECT f.seq_id AS request_id, e.terminus, n.insert_name, f.seq FROM fx_sequences f CROSS JOIN (VALUES ('ct'),('nt')) e(terminus) JOIN (SELECT DISTINCT insert_name, insert_order FROM ins) n ON n.insert_order = f.seq_id % {_N})
"""


def insert_requests(spark, sf):
    names = F.array(*[F.lit(n) for n in dims.cassette_names()])
    df = view(spark, sf, "fx_sequences").withColumn("insert_name", F.get(names, (F.col("seq_id") % _N).cast("int")))
    return df.select(F.col("seq_id").alias("request_id"), "insert_name", F.explode(F.array(F.lit("ct"), F.lit("nt"))).alias("terminus"), "seq")


@query("join_15_cassette_lookup", g_sql("SELECT request_id, terminus, insert_name, insert_seq, length(insert_seq) AS insert_length FROM dr LEFT JOIN ins USING (insert_name, terminus)", _DES))
def join_15(spark, sf):
    from ..plans.designs import with_insert
    return with_insert(insert_requests(spark, sf), dims.insert_table(spark)).select(
        "request_id", "terminus", "insert_name", "insert_seq", F.length("insert_seq").cast("bigint").alias("insert_length"))


_TRANS = f"array_to_string(list_transform(list_transform(range(0, length({{x}})//3), lambda i: substr({{x}}, CAST(3*i+1 AS INT), 3)), lambda c: {_AA.format(c='c').replace(chr(39)+'*'+chr(39), chr(39)+'*'+chr(39))}), '')"
_BROKEN = "CASE WHEN request_id % 3 = 0 THEN substr(insert_seq, 1, 10) || CASE substr(insert_seq, 11, 1) WHEN 'A' THEN 'C' ELSE 'A' END || substr(insert_seq, 12) WHEN request_id % 3 = 1 THEN substr(insert_seq, 2) ELSE insert_seq END"


def designed_inserts(spark, sf):
    """Inserts as designed: a third intact, a third with one base changed, a third out of frame."""
    from ..plans.designs import with_insert
    df = with_insert(insert_requests(spark, sf), dims.insert_table(spark)).where("insert_seq is not null")
    s, k = F.col("insert_seq"), F.col("request_id") % 3
    changed = sq.put_base(s, F.lit(10), F.when(F.substring(s, 11, 1) == "A", "C").otherwise("A"))
    return df.withColumn("actual", F.when(k == 0, changed).when(k == 1, F.expr("substring(insert_seq, 2)")).otherwise(s))


@query("don_3_insert_validation", g_sql(f""", a AS (SELECT *, {_BROKEN} AS actual FROM dr JOIN ins USING (insert_name, terminus)), t AS (SELECT *, {_TRANS.format(x='actual')} AS aa FROM a),
u AS (SELECT *, CASE WHEN terminus = 'ct' THEN contains(substr(aa, 1, greatest(length(aa) - 1, 0)), '*') ELSE contains(aa, '*') END AS bad, terminus = 'ct' AND right(aa, 1) = '*' AS term FROM t)
SELECT request_id, terminus, actual = insert_seq AS matches_preset, bad AS unexpected_stop, term AS terminal_stop_present, length(actual) > 0 AND length(actual) % 3 = 0 AND NOT bad AND (terminus = 'nt' OR term) AS frame_preserved FROM u""", _DES))
def don_3(spark, sf):
    df = designed_inserts(spark, sf)
    check = lambda stop: dn.check_insert(F.col("insert_seq"), F.col("actual"), stop)
    df = df.withColumn("v", F.when(F.col("terminus") == "ct", check(True)).otherwise(check(False)))
    return df.select("request_id", "terminus", "v.matches_preset", "v.unexpected_stop", "v.terminal_stop_present", "v.frame_preserved")


@query("don_3_segment_checks", g_sql(f""", a AS (SELECT *, {_BROKEN} AS actual FROM dr JOIN ins USING (insert_name, terminus)),
p AS (SELECT a.request_id, a.terminus, s.seg_no, s.protein_label AS label, s.protein, substr(actual, CAST(seg_start+1 AS INT), length(seg_seq)) AS part FROM a JOIN sg s USING (insert_name, terminus) WHERE s.protein IS NOT NULL)
SELECT request_id, seg_no, label, {_TRANS.format(x='part').replace("THEN '*'", "THEN 'Stop'")} = protein AS matches FROM p""", _DES))
def don_3b(spark, sf):
    return dn.segment_checks(designed_inserts(spark, sf).withColumn("made", F.col("actual")), dims.segment_table(spark), "made").select(
        "request_id", "seg_no", "label", "matches")


@query("don_4_cassette_segments", g_sql("SELECT request_id, terminus, count(*) AS segments, string_agg(role, '-' ORDER BY seg_no) AS roles, CAST(sum(length(seg_seq)) AS BIGINT) AS bases FROM dr JOIN sg USING (insert_name, terminus) GROUP BY request_id, terminus", _DES))
def don_4(spark, sf):
    df = insert_requests(spark, sf).join(F.broadcast(dims.segment_table(spark)), ["insert_name", "terminus"])
    roles = F.array_sort(F.collect_list(F.struct("seg_no", "role")))
    return df.groupBy("request_id", "terminus").agg(F.count("*").alias("segments"), F.array_join(F.transform(roles, lambda r: r["role"]), "-").alias("roles"),
                                                    F.sum(F.length("seg_seq")).alias("bases"))


_CONS = values(dims.construct_rows(), "terminus, group_no, architecture, position, cassette")


@query("src_13_dimensions", g_sql(f""", cons AS {_CONS}
SELECT request_id, terminus, insert_name, coalesce(architecture, 'fusion') AS architecture, coalesce(cassette, CASE terminus WHEN 'nt' THEN 'N:EGFP-Linker' ELSE 'dTAG-V5' END) AS cassette FROM dr
 LEFT JOIN cons c ON c.terminus = dr.terminus AND c.cassette = dr.insert_name""".replace("SELECT request_id, terminus,", "SELECT request_id, dr.terminus,").replace("CASE terminus", "CASE dr.terminus"), _DES))
def src_13(spark, sf):
    from ..plans.designs import construct_choice
    return construct_choice(insert_requests(spark, sf), dims.construct_table(spark)).select("request_id", "terminus", "insert_name", "architecture", "cassette")


# --- raw references and payloads -----------------------------------------------------------------

@query("src_7_raw_reference", g_sql("""SELECT seq_id, greatest(0, 300 + seq_id % 5 - 1) AS seg_start, least(2016, CASE WHEN seq_id % 4 = 0 THEN 5000 ELSE 1520 END) AS seg_end,
 CASE WHEN seq_id % 2 = 0 THEN 2 ELSE 1 END AS exons, CAST((least(2016, CASE WHEN seq_id % 4 = 0 THEN 5000 ELSE 1520 END) - (300 + seq_id % 5 - 1)) // 3 - 1 AS INT) AS protein_length FROM fx_sequences"""))
def src_7(spark, sf):
    raw = view(spark, sf, "fx_sequences").select(
        "seq_id", "gene", F.concat(F.lit("> x\n 1 "), F.lower("seq")).alias("raw_sequence"), (F.col("seq_id") % 5 + 300).cast("string").alias("cds_start"),
        F.when(F.col("seq_id") % 4 == 0, "5000").otherwise("1520").alias("cds_end"),
        F.when(F.col("seq_id") % 2 == 0, "251-421, 9-5\n601:841").otherwise("").alias("exon_coordinates"))
    m = md.raw_models(raw)
    return m.select("seq_id", F.get("segs", F.lit(0))["start"].alias("seg_start"), F.get("segs", F.lit(0))["end"].alias("seg_end"),
                    F.size("exons").alias("exons"), "protein_length")


@query("src_8_transcript_payloads", g_sql("""SELECT f.seq_id, gene, 'T' || CAST(f.seq_id AS VARCHAR) AS transcript_id, CASE WHEN f.seq_id % 2 = 0 THEN 'ensembl' ELSE 'ncbi' END AS source, CAST(CASE WHEN f.seq_id % 3 = 0 THEN 77 ELSE 219 END AS INT) AS protein_length, cds
 FROM fx_sequences f JOIN cds USING (seq_id)""", CODING))
def src_8(spark, sf):
    m = models(spark, sf)
    body = lambda key, tid, cds: F.to_json(F.struct(
        F.col("gene").alias(key), F.concat(F.lit("T"), F.col("seq_id").cast("string")).alias(tid), F.lower("seq").alias("sequence"), cds,
        F.when(F.col("seq_id") % 3 == 0, 77).alias("proteinLength"), F.transform("exons", lambda x: F.struct(x["start"], x["end"])).alias("exons")))
    extra = F.struct(F.lit(5).alias("start"), F.lit(5).alias("end"))
    pairs = F.transform(F.reverse("segs"), lambda s: F.array(s["start"], s["end"])).alias("cdsSegments")
    structs = F.concat(F.array(extra), F.transform("segs", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))).alias("cds")
    read = lambda df, provider: md.payload_models(df.select("seq_id", F.from_json("j", md.PAYLOAD_SCHEMA).alias("p")).select("seq_id", "p.*"), provider)
    a = read(m.where("seq_id % 2 = 0").select("seq_id", body("geneSymbol", "stableId", pairs).alias("j")), "ensembl")
    b = read(m.where("seq_id % 2 = 1").select("seq_id", body("symbol", "accession", structs).alias("j")), "ncbi")
    return a.unionByName(b).select("seq_id", "gene", "transcript_id", "source", "protein_length", "cds")


@query("flt_7_interval_clean", g_sql("""SELECT f.seq_id, string_agg(CAST(seg_start AS VARCHAR) || '-' || CAST(seg_end - f.seq_id % 2 * 130 AS VARCHAR), ',' ORDER BY seg_start) AS kept FROM fx_sequences f JOIN fx_cds_segments s USING (seq_id)
 WHERE seg_end - f.seq_id % 2 * 130 > seg_start GROUP BY f.seq_id"""))
def flt_7(spark, sf):
    m = models(spark, sf)
    moved = F.transform(F.reverse("segs"), lambda s: F.struct(s["start"].alias("start"), (s["end"] - F.col("seq_id") % 2 * 130).alias("end")))
    return m.select("seq_id", F.array_join(F.transform(md.clean_intervals(moved), lambda s: F.concat(
        s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("kept"))
