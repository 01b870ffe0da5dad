"""Design jobs, their orders, checks, maps and primers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import norm
from ..functions.seq import gc_flag
from ..operators import genome as gn
from ..operators import guides as gd
from ..operators import library as lib
from ..operators import primers as pr
from ..plans import designs as ds
from ..plans import orders as od
from ..plans import review as rv
from ..sources import dims
from ..session import staging_folder
from .fixtures import models, table, view, with_views
from .q_genome import BLOCK, CODING, PAIRS, SITES, TARGETS, _AA, _CTX, _INSERTS, _PLACE, block_sql, g_sql
from .registry import query


def requests(m):
    """One request per sequence, its class by number; every 35th mutation names a residue that is not there."""
    k, n = F.col("seq_id") % 5, F.col("seq_id")
    at = lambda r: gn.residue_at(F.col("cds"), F.lit(r))
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    kind = F.when(k == 0, "ko").when(k == 1, "pm").when(k == 2, "it").when(k == 3, "ct").otherwise("nt")
    mutation = F.when(n % 35 == 1, "J32R").when(k == 1, F.concat(at(50), F.lit("50R"))).when(k == 2, F.concat(F.lit("after "), at(155), F.lit("155"))).otherwise("")
    tag = F.when(k == 2, pick(["SPOT", "alphaBtx"])).when(k == 3, pick(fx.CT_CASSETTES)).when(k == 4, pick(fx.NT_CASSETTES)).otherwise("")
    return m.select(n.alias("request_id"), "seq_id", kind.alias("project_type"), mutation.alias("mutation"), tag.alias("tag"), F.lit("250").alias("homology_arm"))


def all_designs(spark, sf):
    m = models(spark, sf)
    return m, ds.dispatch(m, requests(m))


def one(spark, sf, kind):
    m = models(spark, sf)
    r = requests(m).where(F.col("project_type") == kind)
    job = {"ko": ds.knockout_designs, "pm": ds.mutation_designs, "it": ds.internal_designs,
           "ct": lambda a, b: ds.terminal_designs(a, b, "ct"), "nt": lambda a, b: ds.terminal_designs(a, b, "nt")}[kind]
    return m, job(m, r)


def note(i):
    return F.get("guides", F.lit(i))["note"]


@query("des_1_knockout", g_sql("""SELECT seq_id AS request_id, 'Exon ' || CAST(seg_no + 1 AS VARCHAR) || ' (' || CAST(seg_start + 1 AS VARCHAR) || '-' || CAST(seg_end AS VARCHAR) || ', ' || CAST(seg_end - seg_start AS VARCHAR) || ' bp)' AS exon,
 CAST(spacing AS BIGINT) AS spacing, 'GENE' || CAST(seq_id AS VARCHAR) || '_KO_gRNA1' AS name1, 'Cut at ' || CAST(l_cut + 1 AS VARCHAR) || ', ' || c1.label || ' (' || c1.detail || ') | ' || p1.label || ': ' || p1.detail || ' | pair spacing ' || CAST(spacing AS VARCHAR) || ' bp' AS note1,
 'Cut at ' || CAST(r_cut + 1 AS VARCHAR) || ', ' || c2.label || ' (' || c2.detail || ') | ' || p2.label || ': ' || p2.detail || ' | pair spacing ' || CAST(spacing AS VARCHAR) || ' bp' AS note2
 FROM bs JOIN ctx c1 USING (seq_id) JOIN ctx c2 USING (seq_id) JOIN place p1 USING (seq_id) JOIN place p2 USING (seq_id) WHERE seq_id % 5 = 0 AND c1.ps = l_ps AND c1.strand = l_strand AND c2.ps = r_ps AND c2.strand = r_strand
 AND p1.ps = l_ps AND p1.strand = l_strand AND p2.ps = r_ps AND p2.strand = r_strand""", SITES + PAIRS + _CTX + _PLACE))
def des_1(spark, sf):
    d = one(spark, sf, "ko")[1]
    return d.select("request_id", "exon", "spacing", F.get("guides", F.lit(0))["name"].alias("name1"), note(0).alias("note1"), note(1).alias("note2"))


_PM = f""", mc AS MATERIALIZED (SELECT * FROM (SELECT k.seq_id, k.codon, k.aa, c.c AS mut, row_number() OVER (PARTITION BY seq_id ORDER BY hamming(k.codon, c.c), c.c) AS r FROM codon k, (VALUES ('AGA'),('AGG'),('CGA'),('CGC'),('CGG'),('CGT')) c(c) WHERE residue = 50 AND seq_id % 5 = 1 AND seq_id % 35 <> 1 AND k.aa <> '*') WHERE r = 1),
chg AS MATERIALIZED (SELECT c.seq_id, c.gp, substr(m.mut, frame + 1, 1) AS alt FROM cod c JOIN mc m USING (seq_id) WHERE cp BETWEEN 147 AND 149 AND c.base <> substr(m.mut, frame + 1, 1))
"""
_PMB = block_sql("pmb", "false", "AND kind = 'pm' AND NOT EXISTS (SELECT 1 FROM chg x WHERE x.seq_id = b.seq_id AND x.gp = b.gp)")
_START = "greatest(0, least(2016 - 127, CASE WHEN strand = '+' THEN cut - 36 ELSE cut - 91 END))"


@query("des_2_point_mutation", g_sql(f""", dw AS (SELECT p.seq_id, p.gno, p.strand, p.d, {_START} AS dst, f.seq FROM pick p JOIN mc USING (seq_id) JOIN fx_sequences f USING (seq_id) WHERE kind = 'pm'),
pos AS (SELECT *, unnest(range(0, 127)) AS i FROM dw),
don AS (SELECT p.seq_id, p.gno, any_value(p.strand) AS strand, any_value(p.d) AS d, string_agg(coalesce(c.alt, b.nb, substr(p.seq, CAST(dst + i + 1 AS INT), 1)), '' ORDER BY i) AS sense, any_value(b.label) AS silent FROM pos p LEFT JOIN chg c ON c.seq_id = p.seq_id AND c.gp = p.dst + i
 LEFT JOIN pmb b ON b.seq_id = p.seq_id AND b.gno = p.gno AND b.gp = p.dst + i GROUP BY p.seq_id, p.gno)
SELECT d.seq_id AS request_id, CAST(gno AS INT) AS guide_no, CASE WHEN strand = '+' THEN translate(reverse(sense),'ACGT','TGCA') ELSE sense END AS donor, d, silent, m.mut AS new_codon, m.aa AS wt_aa FROM don d JOIN mc m USING (seq_id)""",
                                   SITES + CODING + TARGETS + _PM + BLOCK + _PMB))
def des_2(spark, sf):
    d = one(spark, sf, "pm")[1].where("err is null")
    e = d.select("request_id", "new_codon", "wt_aa", "guides", "edits", F.explode("oligos").alias("o"))
    silent = F.get(F.filter("edits", lambda x: x["guide_no"] == F.col("o.guide_no")), F.lit(0))["edit"]["label"]
    return e.select("request_id", F.col("o.guide_no").alias("guide_no"), F.col("o.oligo.donor").alias("donor"), F.get("guides", F.col("o.guide_no") - 1)["d"].alias("d"),
                    silent.alias("silent"), "new_codon", "wt_aa")


_BOX = "CASE kind WHEN 'ct' THEN gp >= 1267 AND gp < 1770 AND NOT (gp >= 1517 AND gp < 1520) ELSE gp >= 50 AND gp < 553 END"
_ENDS = (BLOCK + block_sql("b1", "true", "AND gno = 1 AND kind IN ('ct','nt')") + f", acc1 AS MATERIALIZED (SELECT * FROM b1 WHERE {_BOX}), "
         + block_sql("b2", "true", "AND gno = 2 AND kind IN ('ct','nt') AND NOT EXISTS (SELECT 1 FROM acc1 a WHERE a.seq_id = b.seq_id AND a.kind = b.kind AND a.gp = b.gp)")
         + f", ed AS MATERIALIZED (SELECT seq_id, kind, gno, gp, nb FROM acc1 UNION ALL SELECT seq_id, kind, gno, gp, nb FROM b2 WHERE {_BOX})")


def _terminal_sql(kind, names, rest):
    site, lo, hi = (1517, 1267, 1770) if kind == "ct" else (300, 50, 553)
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return g_sql(f""", ins AS {_INSERTS}, rq AS (SELECT seq_id, seq, ({listed})[CAST(seq_id % {len(names)} + 1 AS INT)] AS tag FROM fx_sequences WHERE seq_id % 5 = {rest} AND seq_id IN (SELECT seq_id FROM win WHERE kind = '{kind}')),
pos AS (SELECT *, unnest(range({lo}, {hi})) AS gp FROM rq),
arm AS (SELECT p.seq_id, string_agg(coalesce(e.nb, substr(seq, CAST(p.gp + 1 AS INT), 1)), '' ORDER BY p.gp) FILTER (p.gp < {site}) AS a5, string_agg(coalesce(e.nb, substr(seq, CAST(p.gp + 1 AS INT), 1)), '' ORDER BY p.gp) FILTER (p.gp >= {site + 3}) AS a3
 FROM pos p LEFT JOIN (SELECT seq_id, gp, any_value(nb) AS nb FROM ed WHERE kind = '{kind}' GROUP BY seq_id, gp) e ON e.seq_id = p.seq_id AND e.gp = p.gp GROUP BY p.seq_id)
SELECT r.seq_id AS request_id, r.tag, a5 || i.insert_seq || a3 AS donor, length(i.insert_seq) AS insert_length, CAST(w.win AS INT) AS guide_window, (SELECT count(*) FROM ed e WHERE e.seq_id = r.seq_id AND e.kind = '{kind}') AS edits
FROM rq r JOIN arm USING (seq_id) JOIN ins i ON i.insert_name = r.tag AND i.terminus = '{kind}' JOIN win w ON w.seq_id = r.seq_id AND w.kind = '{kind}'""", SITES + CODING + TARGETS + _ENDS)


def _terminal(spark, sf, kind):
    d = one(spark, sf, kind)[1].where("err is null")
    return d.select("request_id", "tag", "donor", F.col("insert_length").cast("bigint").alias("insert_length"), "guide_window", F.size("edits").cast("bigint").alias("edits"))


@query("des_3_c_terminal_insert", _terminal_sql("ct", fx.CT_CASSETTES, 3))
def des_3(spark, sf):
    return _terminal(spark, sf, "ct")


@query("des_4_n_terminal_insert", _terminal_sql("nt", fx.NT_CASSETTES, 4))
def des_4(spark, sf):
    return _terminal(spark, sf, "nt")


_IT = (BLOCK + block_sql("i1", "true", "AND gno = 1 AND kind = 'it'") + ", "
       + block_sql("i2", "true", "AND gno = 2 AND kind = 'it' AND NOT EXISTS (SELECT 1 FROM i1 a WHERE a.seq_id = b.seq_id AND a.gp = b.gp)"))
_SPOT, _BTX = fx.INTERNAL_TAGS["SPOT"][0], fx.INTERNAL_TAGS["alphaBtx"][0]


@query("des_5_internal_tag", g_sql(f""", ie AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2), dw AS (SELECT p.seq_id, p.gno, p.strand, p.target, {_START} AS dst, f.seq, CASE WHEN p.seq_id % 2 = 0 THEN '{_SPOT}' ELSE '{_BTX}' END AS ins
 FROM pick p JOIN fx_sequences f USING (seq_id) WHERE kind = 'it' AND seq_id % 5 = 2 AND NOT EXISTS (SELECT 1 FROM codon k WHERE k.seq_id = p.seq_id AND residue = 155 AND aa = '*')), pos AS (SELECT *, unnest(range(0, 127)) AS i FROM dw),
don AS (SELECT p.seq_id, p.gno, any_value(strand) AS strand, any_value(p.target - dst) AS ofs, any_value(ins) AS ins, string_agg(coalesce(b.nb, substr(p.seq, CAST(dst + i + 1 AS INT), 1)), '' ORDER BY i) AS s FROM pos p LEFT JOIN ie b ON b.seq_id = p.seq_id AND b.gno = p.gno AND b.gp = dst + i GROUP BY p.seq_id, p.gno),
d2 AS (SELECT *, substr(s, 1, CAST(ofs AS INT)) || ins || substr(s, CAST(ofs + 1 AS INT)) AS sense FROM don)
SELECT seq_id AS request_id, CAST(gno AS INT) AS guide_no, CASE WHEN strand = '+' THEN translate(reverse(sense),'ACGT','TGCA') ELSE sense END AS donor FROM d2""", SITES + CODING + TARGETS + _IT))
def des_5(spark, sf):
    d = one(spark, sf, "it")[1].where("err is null")
    return d.select("request_id", F.explode("insert_oligos").alias("o")).select("request_id", F.col("o.guide_no").alias("guide_no"), F.col("o.oligo.donor").alias("donor"))


_STATUS = f""", st AS (SELECT seq_id AS request_id, CASE seq_id % 5 WHEN 0 THEN 'ko' WHEN 1 THEN 'pm' WHEN 2 THEN 'it' WHEN 3 THEN 'ct' ELSE 'nt' END AS type,
 CASE WHEN seq_id % 35 = 1 THEN 'Expected J at position 32 but found ' || (SELECT aa || ' (' || codon || ').' FROM codon k WHERE k.seq_id = f.seq_id AND residue = 32)
 WHEN seq_id % 5 = 1 AND EXISTS (SELECT 1 FROM codon k WHERE k.seq_id = f.seq_id AND residue = 50 AND aa = '*') THEN 'Cannot parse mutation. Use WT-position-mutant format such as G96S or p.G96S.'
 WHEN seq_id % 5 = 2 AND EXISTS (SELECT 1 FROM codon k WHERE k.seq_id = f.seq_id AND residue = 155 AND aa = '*') THEN 'Use an internal insertion site such as P155 or 155.'
 WHEN seq_id % 5 = 0 THEN CASE WHEN seq_id IN (SELECT seq_id FROM bs) THEN NULL ELSE 'No gRNA pair found with cut-site spacing up to 140 bp across non-terminal coding exons, preferentially exons 2-4, including exon-intron boundaries.' END
 WHEN EXISTS (SELECT 1 FROM win w WHERE w.seq_id = f.seq_id AND w.kind = CASE f.seq_id % 5 WHEN 1 THEN 'pm' WHEN 2 THEN 'it' WHEN 3 THEN 'ct' ELSE 'nt' END) THEN NULL
 WHEN seq_id % 5 = 1 THEN 'No gRNAs found with cut sites within 30 bp of the mutation site.' WHEN seq_id % 5 = 2 THEN 'No gRNAs found with cut sites within 30 bp of the internal insertion site.'
 WHEN seq_id % 5 = 3 THEN 'No SpCas9 gRNAs found with cut sites within 30 bp of the stop codon.' ELSE 'No gRNAs found with cut sites within 30 bp of the start codon.' END AS err FROM fx_sequences f
 UNION ALL SELECT seq_id + 5000000, CASE seq_id % 5 WHEN 0 THEN 'ko' WHEN 1 THEN 'pm' WHEN 2 THEN 'it' WHEN 3 THEN 'ct' ELSE 'nt' END, 'Upload a GenBank file first.' FROM fx_sequences)
"""


def results(spark, sf):
    m = models(spark, sf)
    r = requests(m)
    lost = r.withColumns({"request_id": F.col("request_id") + 5000000, "seq_id": F.col("seq_id") + 5000000})
    return ds.batch_results(r.unionByName(lost), m, ds.dispatch(m, r))


@query("des_9_dispatch", g_sql("SELECT request_id, type, err, CASE WHEN err IS NULL THEN 'success' ELSE 'error' END AS status FROM st", SITES + CODING + TARGETS + PAIRS + _STATUS))
def des_9(spark, sf):
    return results(spark, sf).select("request_id", "type", "err", "status")


@query("join_17_error_rows", g_sql("SELECT request_id, err FROM st WHERE err IS NOT NULL", SITES + CODING + TARGETS + PAIRS + _STATUS))
def join_17(spark, sf):
    return results(spark, sf).where("status = 'error'").select("request_id", "err")


@query("agg_7_batch_status", g_sql("SELECT type, CAST(count_if(err IS NULL) AS BIGINT) AS ready, CAST(count_if(err IS NOT NULL) AS BIGINT) AS review FROM st GROUP BY type", SITES + CODING + TARGETS + PAIRS + _STATUS))
def agg_7(spark, sf):
    return results(spark, sf).groupBy("type").agg(F.count_if(F.col("status") == "success").alias("ready"), F.count_if(F.col("status") == "error").alias("review"))


@query("agg_9_protein_previews", g_sql(f"""SELECT f.seq_id AS request_id, (SELECT string_agg(aa, '' ORDER BY residue) FROM codon k WHERE k.seq_id = f.seq_id AND residue BETWEEN 148 AND 155) AS wt_prefix,
 (SELECT string_agg(aa, '' ORDER BY residue) FROM codon k WHERE k.seq_id = f.seq_id AND residue BETWEEN 156 AND 163) AS wt_suffix, (SELECT string_agg(CASE aa WHEN '*' THEN 'Stop' ELSE aa END, '' ORDER BY residue) FROM codon k WHERE k.seq_id = f.seq_id AND residue BETWEEN 212 AND 219) AS tail,
 (SELECT string_agg(CASE aa WHEN '*' THEN 'Stop' ELSE aa END, '' ORDER BY residue) FROM codon k WHERE k.seq_id = f.seq_id AND residue BETWEEN 1 AND 8) AS head FROM fx_sequences f""", CODING))
def agg_9(spark, sf):
    m = models(spark, sf)
    p = ds.internal_preview(F.col("cds"), F.col("protein_length"), F.lit(155), F.lit("DRV"))
    end = lambda t: F.array_join(ds.knockin_preview(F.col("cds"), F.col("protein_length"), t, F.lit("GCATAA"))["wt"], "")
    return m.select(F.col("seq_id").alias("request_id"), p["wt_prefix"].alias("wt_prefix"), p["wt_suffix"].alias("wt_suffix"), end("ct").alias("tail"), end("nt").alias("head"))


# --- designs with their primers, for orders, checks and maps ---------------------------------------

_WRITTEN: dict = {}


def finished(spark, sf, kind):
    """Designs of one class with their best primers, written once per session: orders, checks and maps are separate
    jobs over the design table, as they are in use."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _WRITTEN:
        path = staging_folder(spark, "designs-" + kind)
        _finish(spark, sf, kind).write.parquet(path)
        _WRITTEN[key] = path
    return models(spark, sf), spark.read.parquet(_WRITTEN[key])


def _finish(spark, sf, kind):
    m, d = one(spark, sf, kind)
    path = staging_folder(spark, "base-" + kind)
    d.write.parquet(path)
    d = spark.read.parquet(path)
    if kind in ("ct", "nt"):
        pairs = ds.terminal_design_primers(d, m)
    elif kind == "ko":
        pairs = ds.knockout_design_primers(d, m)
    else:
        pairs = ds.centred_design_primers(d, m)
    site = F.concat(F.lit("AFTER_"), F.col("wt_aa"), F.col("position").cast("string")) if kind == "it" else F.lit("x50R") if kind == "pm" else F.lit("")
    tag = F.col("tag") if kind in ("it", "ct", "nt") else F.lit("")
    out = ds.with_best_pair(d, pairs, site, tag)
    if kind in ("ct", "nt"):
        out = out.withColumn("primer_warning", pr.outside_warning(F.col("arm_start"), F.col("arm_end"), F.col("seq_len"), F.col("fw_seq").isNotNull(), F.coalesce("is_fallback", F.lit(False))))
    return out.withColumns({"slot": F.col("request_id"), "file_name": F.lit("ref.gb"), "reference_source": F.lit("genbank"), "notes": F.lit("")})


def planned(spark, sf, kind):
    """Designs of one class whose primers come from a given table instead of a pair search: one pair per document. Written
    once per session, as in ``finished``."""
    n = F.col("doc_id")
    dna = lambda word: F.substring(F.translate(F.md5(F.concat(F.lit(word), n.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 20)
    pairs = table(spark, sf, "documents").select(n.alias("target_id"), F.lit(1).alias("rank"), dna("fw").alias("fw_seq"), dna("rev").alias("rev_seq"), (n % 100 + 400).alias("amp"),
                                                 F.lit(None).cast("bigint").alias("wt_amp"), F.lit(None).cast("bigint").alias("del_amp"),
                                                 F.lit("outside" if kind in ("ct", "nt") else "centred").alias("mode"), F.lit(False).alias("is_fallback")).where(n % 11 != 5)
    key = (spark.sparkContext.applicationId, sf, "planned-" + kind)
    if key in _WRITTEN:
        return models(spark, sf), spark.read.parquet(_WRITTEN[key])
    m, d = one(spark, sf, kind)
    out = ds.with_best_pair(d.where("err is null"), pairs, F.lit(""), F.col("tag") if kind in ("it", "ct", "nt") else F.lit(""))
    third = F.col("request_id") % 3
    out = out.withColumns({"slot": F.col("request_id"), "file_name": F.when(third != 1, F.concat(F.lit("ref"), F.col("request_id").cast("string"), F.lit(".gb"))).otherwise(""),
                               "reference_source": F.when(third == 1, "raw").otherwise("genbank"), "notes": F.when(F.col("request_id") % 2 == 0, "").otherwise("kept")})
    path = staging_folder(spark, "planned-" + kind)
    out.write.parquet(path)
    _WRITTEN[key] = path
    return m, spark.read.parquet(path)


def union_of(spark, sf, fn, kinds=("ko", "pm", "it", "ct", "nt")):
    out = None
    for k in kinds:
        m, d = finished(spark, sf, k)
        part = fn(m, d.where("err is null"))
        out = part if out is None else out.unionByName(part)
    return out


# Knockouts with given primers: one row per design, then its guides and primers.
_KO = SITES + PAIRS + _CTX + _PLACE + """, dk AS MATERIALIZED (SELECT b.*, 'GENE' || CAST(seq_id AS VARCHAR) AS gene, 'Exon ' || CAST(seg_no + 1 AS VARCHAR) || ' (' || CAST(seg_start + 1 AS VARCHAR) || '-' || CAST(seg_end AS VARCHAR) || ', ' || CAST(seg_end - seg_start AS VARCHAR) || ' bp)' AS exon,
 CASE WHEN seq_id % 3 = 1 THEN '' ELSE 'ref' || CAST(seq_id AS VARCHAR) || '.gb' END AS file_name, seq_id % 11 <> 5 AS has, '~' || CAST(seq_id % 100 + 400 AS VARCHAR) || ' bp' AS amplicon,
 substr(translate(md5('fw' || CAST(seq_id AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) AS fw, substr(translate(md5('rev' || CAST(seq_id AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) AS rev FROM bs b WHERE seq_id % 5 = 0),
kg AS MATERIALIZED (SELECT k.*, i, s.spacer, s.pam, s.strand, s.gc, s.cut, gene || '_KO_gRNA' || CAST(i AS VARCHAR) AS name, 'Cut at ' || CAST(s.cut + 1 AS VARCHAR) || ', ' || c.label || ' (' || c.detail || ') | ' || p.label || ': ' || p.detail || ' | pair spacing ' || CAST(spacing AS VARCHAR) || ' bp' AS note
 FROM (SELECT *, unnest([1, 2]) AS i FROM dk) k JOIN sites s ON s.seq_id = k.seq_id AND s.ps = CASE i WHEN 1 THEN l_ps ELSE r_ps END AND s.strand = CASE i WHEN 1 THEN l_strand ELSE r_strand END
 JOIN ctx c ON c.seq_id = s.seq_id AND c.ps = s.ps AND c.strand = s.strand JOIN place p ON p.seq_id = s.seq_id AND p.ps = s.ps AND p.strand = s.strand),
ki AS MATERIALIZED (SELECT seq_id AS slot, gene || ' knockout' AS design_label, gene, 'Knockout' AS design_type, CASE WHEN file_name = '' THEN 'Raw DNA + CDS coordinates' ELSE file_name END AS reference_file, 'gRNA' AS item_type, name, spacer AS sequence, spacer, pam, strand, 20 AS len, '' AS linked_guide, 'Yes' AS recommended, note AS notes FROM kg
 UNION ALL SELECT seq_id, gene || ' knockout', gene, 'Knockout', CASE WHEN file_name = '' THEN 'Raw DNA + CDS coordinates' ELSE file_name END, 'Primer', gene || '_KO_' || e.e, CASE e.e WHEN 'Fw' THEN fw ELSE rev END, '', '', '', 20, '', 'Yes', 'Validation primer' FROM dk, (VALUES ('Fw'),('Rev')) e(e) WHERE has)
"""
_STRATEGY = "NHEJ-mediated frameshift using Cas9 RNP. Screen by Sanger sequencing plus ICE/TIDE, then confirm protein loss."


@query("set_1_knockout_items", g_sql("""SELECT slot, design_label, gene, design_type, reference_file, item_type, name, sequence, spacer, pam, strand, CAST(len AS INT) AS length, linked_guide, recommended, notes FROM ki""", _KO))
def set_1c(spark, sf):
    """All items of knockouts with given primers."""
    return od.order_items(planned(spark, sf, "ko")[1])


_SHEET = ", ".join(f'nullif({c}, \'\') AS "{h}"' for c, h in zip(
    ["CAST(slot AS VARCHAR)", "design_label", "gene", "design_type", "reference_file", "item_type", "name", "sequence", "spacer", "pam", "strand", "CAST(len AS VARCHAR)", "linked_guide", "recommended", "notes"],
    fx.ORDER_HEADERS))


@query("snk_1_knockout_sheet", g_sql(f"SELECT {_SHEET} FROM ki", _KO))
def snk_1b(spark, sf):
    path = staging_folder(spark, "orders")
    od.write_order_sheet(od.order_items(planned(spark, sf, "ko")[1]), path)
    return spark.read.csv(path, header=True, quote='"', escape='"')


@query("snk_2_knockout_vendor_tables", g_sql("""SELECT CASE item_type WHEN 'gRNA' THEN 'crispr' ELSE 'oligo' END AS "table", name AS "Name", sequence AS "Sequence", CASE item_type WHEN 'gRNA' THEN '2nmol' ELSE '25nm' END AS "Scale" FROM ki""", _KO))
def snk_2b(spark, sf):
    v = od.vendor_tables(od.order_items(planned(spark, sf, "ko")[1]), {"crispr_scale": "2nmol", "oligo_scale": "25nm"})
    rows = [v[k].select(F.lit(k).alias("table"), "Name", "Sequence", "Scale") for k in v]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("snk_5_knockout_summary", g_sql(f"""SELECT seq_id AS request_id, 'Design: ' || gene || ' knockout' || chr(10) || 'Target exon: ' || exon || chr(10) || 'Pair spacing: ' || CAST(CAST(spacing AS BIGINT) AS VARCHAR) || ' bp' || chr(10) || 'Strategy: {_STRATEGY}' AS summary FROM dk""", _KO))
def snk_5b(spark, sf):
    return planned(spark, sf, "ko")[1].select("request_id", od.design_summary(planned(spark, sf, "ko")[1]).alias("summary"))


@query("prj_17_knockout_snapshot", g_sql("""SELECT seq_id AS request_id, CAST(i AS INT) AS item_no, ['Edit class', 'Primary target', 'Guide pair', 'Primers'][i + 1] AS label,
 ['Knockout', exon, '2 guides · ' || CAST(CAST(spacing AS BIGINT) AS VARCHAR) || ' bp', CASE WHEN has THEN amplicon ELSE 'Pending' END][i + 1] AS value, ['accent', 'default', 'success', CASE WHEN has THEN 'success' ELSE 'warm' END][i + 1] AS tone
 FROM (SELECT *, unnest(range(0, 4)) AS i FROM dk)""", _KO))
def prj_17b(spark, sf):
    return rv.snapshot_items(planned(spark, sf, "ko")[1])


@query("qc_1_knockout_review", g_sql("""SELECT seq_id AS request_id, CAST(1 AS INT) AS item_no, 'check' AS level, 'Record transcript assumptions, exon numbering assumptions, and delivery method before final sign-off.' AS text FROM dk WHERE seq_id % 2 = 0
 UNION ALL SELECT seq_id, 2, 'warning', 'Guide GC content is atypical for ' || CAST(count(*) AS VARCHAR) || CASE count(*) WHEN 1 THEN ' guide' ELSE ' guides' END || '; review activity and synthesis risk manually.' FROM kg WHERE gc < 30 OR gc > 80 GROUP BY seq_id
 UNION ALL SELECT seq_id, 16, 'check', 'Validate the expected deletion by junction PCR and confirm frameshift or protein loss in established clones.' FROM dk""", _KO))
def qc_1b(spark, sf):
    return rv.review_items(planned(spark, sf, "ko")[1])


@query("qc_3_knockout_readiness", g_sql("""SELECT seq_id AS request_id, CAST([0, 5, 6, 7][i] AS INT) AS check_no, ['Reference anchored', 'Guide pair ready', 'Sequence-backed geometry', 'Primer strategy ready'][i] AS label, CASE WHEN i = 4 AND NOT has THEN 'warn' ELSE 'pass' END AS status,
 ['Design is anchored to a concrete reference sequence or validated lookup.', 'Two knockout guides are selected with local spacing and primer design.', 'Cut spacing and exon context were calculated on the uploaded reference.',
  CASE WHEN has THEN 'Validation primers are ready (' || amplicon || ').' ELSE 'Validation primers are incomplete.' END][i] AS detail FROM (SELECT *, unnest(range(1, 5)) AS i FROM dk)""", _KO))
def qc_3b(spark, sf):
    return rv.readiness_checks(planned(spark, sf, "ko")[1])


@query("flt_4_atypical_guide_gc", g_sql("SELECT seq_id, ps, strand, spacer, gc, CASE WHEN gc < 30 THEN 'low' ELSE 'high' END AS flag FROM sites WHERE gc < 30 OR gc > 80", SITES))
def flt_4(spark, sf):
    sites = gn.scan_sequences(view(spark, sf, "fx_sequences"))
    return sites.select("seq_id", "ps", "strand", "spacer", "gc", gc_flag(F.col("gc")).alias("flag")).where("flag is not null")


_PICKED = """SELECT p.seq_id AS request_id, CAST(gno AS INT) AS guide_no, spacer, gc FROM pick p WHERE (kind = 'ct' AND seq_id % 5 = 3) OR (kind = 'nt' AND seq_id % 5 = 4)
 UNION ALL SELECT seq_id, CAST(i AS INT), spacer, gc FROM kg"""


@query("flt_4_design_guide_flags", g_sql(f"SELECT *, CASE WHEN gc < 30 THEN 'low' ELSE 'high' END AS flag FROM ({_PICKED}) WHERE gc < 30 OR gc > 80", _KO + CODING + TARGETS))
def flt_4b(spark, sf):
    """Flags of the guides that designs took: knockouts and both terminal classes."""
    out = None
    for kind in ("ko", "ct", "nt"):
        part = rv.guide_gc_flags(planned(spark, sf, kind)[1])
        out = part if out is None else out.unionByName(part)
    return out.select("request_id", "guide_no", "spacer", "gc", "flag")


@query("flt_4_review_counts", g_sql(f"""SELECT request_id, CAST(count(*) AS BIGINT) AS guides, 'Guide GC content is atypical for ' || CAST(count(*) AS VARCHAR) || CASE count(*) WHEN 1 THEN ' guide' ELSE ' guides' END || '; review activity and synthesis risk manually.' AS text
 FROM ({_PICKED}) WHERE gc < 30 OR gc > 80 GROUP BY request_id""", _KO + CODING + TARGETS))
def flt_4c(spark, sf):
    """The review row of each design beside the number of its flagged guides."""
    out = None
    for kind in ("ko", "ct", "nt"):
        d = planned(spark, sf, kind)[1]
        counts = rv.guide_gc_flags(d).groupBy("request_id").agg(F.count("*").alias("guides"))
        part = rv.review_items(d).where(F.contains("text", F.lit("Guide GC content"))).join(counts, "request_id", "full").select("request_id", "guides", "text")
        out = part if out is None else out.unionByName(part)
    return out


@query("set_4_fallback_pairs", g_sql("""SELECT target_id, mode, fw_start, rev_end, fw_seq, rev_seq, amp, CAST(-999 AS DOUBLE) AS score, true AS is_fallback FROM (
 SELECT seq_id AS target_id, 'centred' AS mode, s AS fw_start, s + 475 AS rev_end, substr(q, CAST(s + 1 AS INT), 24) AS fw_seq, translate(reverse(substr(q, CAST(s + 475 - 23 AS INT), 24)),'ACGT','TGCA') AS rev_seq, CAST(475 AS BIGINT) AS amp FROM (SELECT seq_id, translate(seq,'CG','AT') AS q, greatest(0, least(2016 - 475, CAST(floor(c - 237.5 + 0.5) AS BIGINT))) AS s FROM (SELECT *, seq_id % 2016 AS c FROM fx_sequences))
 UNION ALL SELECT seq_id, 'flanking', s, s + 475, substr(q, CAST(s + 1 AS INT), 24), translate(reverse(substr(q, CAST(s + 475 - 23 AS INT), 24)),'ACGT','TGCA'), 475 FROM (SELECT seq_id, translate(seq,'CG','AT') AS q, greatest(0, least(2016 - 475, CAST(floor((c + c + 40) / 2.0 - 237.5 + 0.5) AS BIGINT))) AS s FROM (SELECT *, seq_id % 2016 AS c FROM fx_sequences))
 UNION ALL SELECT seq_id, 'outside', 676, 1274, substr(q, 677, 24), translate(reverse(substr(q, 1251, 24)),'ACGT','TGCA'), 598 FROM (SELECT seq_id, translate(seq,'CG','AT') AS q FROM fx_sequences)
 UNION ALL SELECT seq_id, 'screen', 150, 1706, substr(q, 151, 24), translate(reverse(substr(q, 1683, 24)),'ACGT','TGCA'), 250 + 256 FROM (SELECT seq_id, translate(seq,'CG','AT') AS q FROM fx_sequences))"""))
def set_4(spark, sf):
    """Sequences without G and C have no candidate at all, so every target takes the fallback."""
    seqs = view(spark, sf, "fx_sequences").select(F.col("seq_id").alias("target_id"), F.translate("seq", "CG", "AT").alias("seq"))
    at = F.col("target_id") % 2016
    big = lambda x: F.lit(x).cast("bigint")
    jobs = [pr.centred_targets(seqs.withColumn("center", at)), pr.flanking_targets(seqs.withColumns({"anchor_start": at, "anchor_end": at + 40})),
            pr.outside_targets(seqs.withColumns({"arm_start": big(700), "arm_end": big(1250)})), pr.screen_targets(seqs.withColumns({"left_cut": big(400), "right_cut": big(1450)}))]
    out = None
    for t in jobs:
        p = pr.design_pairs(t)
        out = p if out is None else out.unionByName(p)
    return out.select("target_id", "mode", "fw_start", "rev_end", "fw_seq", "rev_seq", "amp", "score", "is_fallback")


def _targets(spark, sf):
    return view(spark, sf, "fx_sequences").select(F.col("seq_id").alias("target_id"), "seq")


_PAIR_COLS = ["target_id", "rank", "fw_seq", "fw_start", "rev_seq", "rev_start", "rev_end", "amp", "amp_gc", "score", "is_fallback"]


@query("join_7_flanking_pairs")
def join_7(spark, sf):
    t = _targets(spark, sf).withColumns({"anchor_start": F.lit(1000).cast("bigint"), "anchor_end": F.lit(1050).cast("bigint")})
    return pr.design_pairs(pr.flanking_targets(t)).select(*_PAIR_COLS)


@query("join_8_outside_arm_pairs")
def join_8(spark, sf):
    m, d = one(spark, sf, "ct")
    return ds.terminal_design_primers(d, m).select(*_PAIR_COLS)


@query("join_8_outside_arm_pairs_n")
def join_8n(spark, sf):
    m, d = one(spark, sf, "nt")
    return ds.terminal_design_primers(d, m).select(*_PAIR_COLS)


@query("join_8_outside_arm_pairs_90")
def join_8b(spark, sf):
    """With the candidate limit of one interactive design."""
    m, d = one(spark, sf, "ct")
    return ds.terminal_design_primers(d, m, per_side=pr.OUTSIDE_LIMIT).select(*_PAIR_COLS)


@query("join_9_centred_pairs")
def join_9(spark, sf):
    t = _targets(spark, sf).withColumn("center", F.lit(626).cast("bigint"))
    return pr.design_pairs(pr.centred_targets(t)).select(*_PAIR_COLS)


@query("join_10_deletion_screen_pairs")
def join_10(spark, sf):
    t = _targets(spark, sf).withColumns({"left_cut": F.lit(400).cast("bigint"), "right_cut": F.lit(1450).cast("bigint")})
    return pr.design_pairs(pr.screen_targets(t)).select(*_PAIR_COLS, "wt_amp", "del_amp")


@query("win_8_candidate_cap")
def win_8(spark, sf):
    t = _targets(spark, sf).withColumns({"arm_start": F.lit(700).cast("bigint"), "arm_end": F.lit(1250).cast("bigint")})
    from pyspark.sql import Window
    c = pr.primer_candidates(pr.outside_targets(t), pr.OUTSIDE_LIMIT).select("target_id", "side", "c.placing", "c.start", "c.len", "c.p")
    w = Window.partitionBy("target_id", "side").orderBy("placing", "start", "len")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pr.OUTSIDE_LIMIT)


@query("win_9_knockout_pairs_ranked")
def win_9(spark, sf):
    m, d = one(spark, sf, "ko")
    q = pr.with_quality(ds.knockout_design_primers(d, m))
    return q.select(*_PAIR_COLS, "confidence", "pair_penalty", "tm_delta", F.array_join("pair_warnings", "; ").alias("warnings"))


@query("des_6_primer_panel")
def des_6(spark, sf):
    n = F.col("seq_id") % 3
    r = view(spark, sf, "fx_sequences").select(F.col("seq_id").alias("request_id"), F.col("seq").alias("sequence"), F.when(n == 0, "centered").when(n == 1, "flanking").otherwise("deletion").alias("mode"),
                                               F.lit(701).alias("a"), F.when(F.col("seq_id") % 10 == 4, 9000).otherwise(1000).alias("b"))
    out = ds.primer_panel(r)
    pairs = out["pairs"].select("request_id", "rank", "fw_seq", "rev_seq", "amp", F.lit(None).cast("string").alias("err"))
    return pairs.unionByName(out["errors"].select("request_id", "err"), allowMissingColumns=True)


@query("des_6_panel_errors", g_sql("""SELECT seq_id AS request_id, CASE seq_id % 4 WHEN 0 THEN 'Paste a DNA sequence or upload a GenBank file first.' WHEN 1 THEN 'Centered primer mode needs a valid 1-based target position between 1 and 2016.'
 WHEN 2 THEN 'Deletion screen mode needs two valid 1-based cut positions within 1-2016.' ELSE 'Unsupported primer design mode: other.' END AS err FROM fx_sequences"""))
def des_6b(spark, sf):
    k = F.col("seq_id") % 4
    r = view(spark, sf, "fx_sequences").select(F.col("seq_id").alias("request_id"), F.when(k == 0, "...").otherwise(F.col("seq")).alias("sequence"),
                                               F.when(k == 2, "deletion").when(k == 3, "other").otherwise("centered").alias("mode"), F.lit(9999).alias("a"), F.lit(5).alias("b"))
    return ds.primer_panel(r)["errors"]


@query("set_1_order_items", g_sql("""SELECT seq_id AS slot, 'GENE' || CAST(seq_id AS VARCHAR) || ' knockout' AS design_label, k AS item_type, 'GENE' || CAST(seq_id AS VARCHAR) || '_KO_' || n AS name, CASE n WHEN 'gRNA1' THEN l_spacer ELSE r_spacer END AS sequence
 FROM bs, (VALUES ('gRNA','gRNA1'),('gRNA','gRNA2')) v(k, n) WHERE seq_id % 5 = 0""", SITES + PAIRS))
def set_1(spark, sf):
    """Guide items; primer items come from the pair search, which SQL cannot run (see set_1_all_classes)."""
    return od.order_items(finished(spark, sf, "ko")[1]).where("item_type = 'gRNA'").select("slot", "design_label", "item_type", "name", "sequence")


@query("set_1_all_classes")
def set_1b(spark, sf):
    return union_of(spark, sf, lambda m, d: od.order_items(d))


@query("snk_2_vendor_tables")
def snk_2(spark, sf):
    items = union_of(spark, sf, lambda m, d: od.order_items(d))
    v = od.vendor_tables(items, {"crispr_scale": "2nmol", "oligo_scale": "25nm", "oligo_purification": "STD", "hdr_scale": "4nmUltramer", "hdr_modification": "none"})
    rows = [v[k].select(F.lit(k).alias("table"), "Name", "Sequence", "Scale") for k in v]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("snk_5_design_summary")
def snk_5(spark, sf):
    return union_of(spark, sf, lambda m, d: d.select("request_id", od.design_summary(d).alias("summary")))


@query("qc_1_review_items")
def qc_1(spark, sf):
    segments = dims.segment_table(spark)
    return union_of(spark, sf, lambda m, d: rv.review_items(d, _reporters(spark, d) if "made_insert" in d.columns else None, segments))


def _reporters(spark, d):
    from ..operators.donors import segment_checks
    x = d.select("request_id", F.col("tag").alias("insert_name"), F.col("type").alias("terminus"), "made_insert")
    return segment_checks(x, dims.segment_table(spark), "made_insert")


@query("qc_2_knockin_checks")
def qc_2(spark, sf):
    return union_of(spark, sf, lambda m, d: rv.knockin_checks(d, _reporters(spark, d) if "made_insert" in d.columns else None), ("it", "ct", "nt"))


@query("qc_3_readiness")
def qc_3(spark, sf):
    return union_of(spark, sf, lambda m, d: rv.readiness_checks(d, _reporters(spark, d) if "made_insert" in d.columns else None))


@query("qc_4_outside_primer_warning", g_sql("""SELECT seq_id, CASE WHEN u THEN '' WHEN a < 18 AND 2016 - b < 18 THEN 'Outside-homology-arm validation primers need at least 18 bp of reference sequence upstream of the 5'' homology arm and downstream of the 3'' homology arm. Upload a reference with additional flank or shorten the homology arms.'
 WHEN a < 18 THEN 'Outside-homology-arm validation primers need at least 18 bp of reference sequence upstream of the 5'' homology arm. Upload a reference with additional flank or shorten the homology arms.'
 WHEN 2016 - b < 18 THEN 'Outside-homology-arm validation primers need at least 18 bp of reference sequence downstream of the 3'' homology arm. Upload a reference with additional flank or shorten the homology arms.'
 ELSE 'No validated primer pair could be placed outside both homology arms; review this locus manually.' END AS warning, CASE WHEN u THEN 'validated-outside-homology-arms' ELSE 'outside-homology-arms-unavailable' END AS strategy FROM (SELECT seq_id, seq_id % 40 AS a, 2016 - seq_id % 30 AS b, seq_id % 7 = 0 AS u FROM fx_sequences)"""))
def qc_4(spark, sf):
    a, b, u = F.col("seq_id") % 40, F.lit(2016) - F.col("seq_id") % 30, F.col("seq_id") % 7 == 0
    return view(spark, sf, "fx_sequences").select("seq_id", pr.outside_warning(a, b, F.length("seq"), u, F.lit(False)).alias("warning"), pr.outside_strategy(u, F.lit(False)).alias("strategy"))


@query("qc_6_edit_notes", g_sql(""", n AS (SELECT seq_id, gp, alt, row_number() OVER (PARTITION BY seq_id ORDER BY gp) AS r FROM chg)
SELECT n.seq_id AS request_id, 'Desired edit ' || CAST(r AS VARCHAR) || ': genomic position ' || CAST(n.gp + 1 AS VARCHAR) || ', ' || c.base || '->' || alt AS note FROM n JOIN cod c ON c.seq_id = n.seq_id AND c.gp = n.gp WHERE n.seq_id IN (SELECT seq_id FROM win WHERE kind = 'pm')
UNION ALL SELECT seq_id, 'GENE' || CAST(seq_id AS VARCHAR) || '_' || m.aa || '50R_gRNA' || CAST(gno AS VARCHAR) || ': ' || label || ' (' || old || ' -> ' || new || ') | ' || purpose FROM pmb JOIN mc m USING (seq_id)""", SITES + CODING + TARGETS + _PM + BLOCK + _PMB))
def qc_6(spark, sf):
    return rv.edit_notes(one(spark, sf, "pm")[1]).select("request_id", "note")


@query("prj_17_snapshot_items")
def prj_17(spark, sf):
    return union_of(spark, sf, lambda m, d: rv.snapshot_items(d))


def _windows(spark, sf, kind, source=finished):
    m, d = source(spark, sf, kind)
    d = d.where("err is null")
    have = [c for c in ("seq_len",) if c in d.columns]
    return rv.locus_window(d.drop(*have, "segs").join(m.select("seq_id", "seq_len", "exons", "segs", "seq"), "seq_id"))


@query("gen_11_locus_window", g_sql("""SELECT seq_id AS request_id, greatest(0, c - 260) AS win_start, least(2016, greatest(0, c - 260) + 520) AS win_end FROM (SELECT seq_id, CAST(floor((l_cut + r_cut) / 2.0 + 0.5) AS BIGINT) AS c FROM bs WHERE seq_id % 5 = 0)""", SITES + PAIRS))
def gen_11(spark, sf):
    return _windows(spark, sf, "ko").select("request_id", "win_start", "win_end")


@query("gen_12_locus_items")
def gen_12(spark, sf):
    out = None
    for k in ("ko", "pm", "it", "ct", "nt"):
        part = rv.locus_items(_windows(spark, sf, k))
        out = part if out is None else out.unionByName(part)
    return out


@query("gen_12_knockout_map", g_sql("""SELECT request_id, kind, label, start, "end", (greatest(start, win_start) - win_start) / CAST(win_end - win_start AS DOUBLE) * 100 AS "left",
 greatest(CASE WHEN kind = 'cut' THEN 2.0e0 ELSE 1.0e0 END, (least("end", win_end) - greatest(start, win_start)) / CAST(win_end - win_start AS DOUBLE) * 100) AS width FROM (
 SELECT seq_id AS request_id, greatest(0, c - 260) AS win_start, least(2016, greatest(0, c - 260) + 520) AS win_end, kind, label, start, "end" FROM (SELECT seq_id, CAST(floor((l_cut + r_cut) / 2.0 + 0.5) AS BIGINT) AS c FROM dk) JOIN (
 SELECT seq_id, 'exon' AS kind, 'Exon ' || CAST(exon_number AS VARCHAR) AS label, CAST(exon_start AS BIGINT) AS start, CAST(exon_end AS BIGINT) AS "end" FROM fx_exons
 UNION ALL SELECT seq_id, 'intron', 'Intron ' || CAST(exon_number AS VARCHAR) || '-' || CAST(nn AS VARCHAR), exon_end, nxt FROM (SELECT *, lead(exon_start) OVER (PARTITION BY seq_id ORDER BY exon_start) AS nxt, lead(exon_number) OVER (PARTITION BY seq_id ORDER BY exon_start) AS nn FROM fx_exons) WHERE nxt > exon_end
 UNION ALL SELECT seq_id, 'cut', 'gRNA' || CAST(i AS VARCHAR), cut, cut + 1 FROM kg) x USING (seq_id)) WHERE "end" > win_start AND start < win_end""", _KO))
def gen_12b(spark, sf):
    """Exons, introns and cuts around knockouts; the given primers lie on no reference."""
    return rv.locus_items(_windows(spark, sf, "ko", planned))


@query("gen_13_donor_annotations")
def gen_13(spark, sf):
    return union_of(spark, sf, lambda m, d: rv.donor_annotations(d, dims.segment_table(spark)), ("ct", "nt"))


@query("seq_20_strand_views")
def seq_20b(spark, sf):
    d = one(spark, sf, "pm")[1].where("err is null")
    rows = d.select("request_id", "guides", F.explode("oligos").alias("x")).select(
        "request_id", F.col("x.guide_no").alias("guide_no"), F.get("guides", F.col("x.guide_no") - 1)["strand"].alias("strand"), F.col("x.oligo").alias("o"))
    v = rv.strand_views(rows)
    return v.select("request_id", "guide_no", "view", "title", "donor", F.array_join(F.col("diffs").cast("array<string>"), ",").alias("diffs"), "guide.site_start", "guide.site_end")


@query("prj_16_guide_and_primer_rows")
def prj_16b(spark, sf):
    m, d = finished(spark, sf, "pm")
    from ..functions import seq as sq
    rows = sq.with_assessment(d.where("err is null").select("request_id", F.inline(F.array(*[F.struct(F.col(p + "_name").alias("name"), F.col(p + "_seq").alias("seq")) for p in ("fw", "rev")]))), "seq")
    return rows.select("request_id", "name", "seq", F.concat(F.col("len").cast("string"), F.lit(" nt")).alias("length"), F.concat(F.format_number("tm", 1), F.lit(" C")).alias("tm_text"),
                       F.concat(F.col("clamp").cast("string"), F.lit("/3")).alias("clamp_text"))


# --- remapped reference guides -------------------------------------------------------------------

def chosen_reference(spark, sf):
    """Three library-like guides per knockout sequence, taken from its own sites by hash order."""
    from pyspark.sql import Window
    sites = gn.scan_sequences(view(spark, sf, "fx_sequences"))
    w = Window.partitionBy("seq_id").orderBy(F.md5("spacer"), "spacer", "ps")
    top = sites.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    detail = F.concat(F.lit("Brunello reference guide | Rule Set 2 0.5"), F.when(F.col("rank") == 2, F.lit(" | Exon 9")).otherwise(""))
    return sites, top.select("seq_id", F.col("seq_id").alias("request_id"), F.col("rank").alias("guide_no"), "spacer", "pam", detail.alias("detail"),
                             F.lit(None).cast("int").alias("exon_hint"), F.lit(None).cast("bigint").alias("cut_hint"))


_REMAP = """, lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY md5(spacer), spacer, ps) AS rank FROM sites) WHERE rank <= 3),
lm AS MATERIALIZED (SELECT * FROM (SELECT l.seq_id, l.rank, l.spacer, s.cut, s.strand, x.label, x.detail, 'Brunello reference guide | Rule Set 2 0.5' || CASE WHEN l.rank = 2 THEN ' | Exon 9' ELSE '' END AS det,
 row_number() OVER (PARTITION BY l.seq_id, l.rank ORDER BY s.cut) AS r FROM lg l JOIN sites s ON s.seq_id = l.seq_id AND s.spacer = l.spacer AND s.pam = l.pam JOIN ctx x ON x.seq_id = s.seq_id AND x.ps = s.ps AND x.strand = s.strand) WHERE r = 1)
"""


@query("des_8_remapped_knockout", g_sql("""SELECT a.seq_id AS request_id, a.rank AS guide_no, a.cut, abs(b.cut - a.cut) AS spacing, a.det || ' | Cut at ' || CAST(a.cut + 1 AS VARCHAR) || ', ' || a.label || ' (' || a.detail || ') | pair spacing ' || CAST(abs(b.cut - a.cut) AS VARCHAR) || ' bp' AS note
 FROM lm a JOIN lm b ON b.seq_id = a.seq_id AND b.rank = 3 - a.rank WHERE a.rank <= 2""", SITES + _CTX + _REMAP))
def des_8(spark, sf):
    sites, chosen = chosen_reference(spark, sf)
    return ds.remapped_knockout(None, sites, models(spark, sf), chosen.where("guide_no <= 2")).select("request_id", F.col("guide_no").alias("guide_no"), "cut", "spacing", "note")


_LOCALPAIRS = """, ex2 AS (SELECT *, CASE WHEN rank = 2 THEN 9 ELSE CAST(nullif(regexp_extract(label || ' ' || detail, '(?i)exon\\s+(\\d+)', 1), '') AS INT) END AS exon FROM lm),
jp AS MATERIALIZED (SELECT a.seq_id AS request_id, 'Brunello-' || CAST(a.rank AS VARCHAR) || '-' || CAST(b.rank AS VARCHAR) AS id, abs(b.cut - a.cut) AS spacing, CASE WHEN a.exon = b.exon AND abs(b.cut - a.cut) BETWEEN 40 AND 140 THEN 'nearby' WHEN a.exon = b.exon THEN 'local'
 WHEN abs(b.cut - a.cut) > 1000 THEN 'deletion-screen' ELSE 'cross-exon' END AS mode FROM ex2 a JOIN ex2 b ON b.seq_id = a.seq_id AND a.rank < b.rank)
"""


def local_pairs(spark, sf):
    sites, chosen = chosen_reference(spark, sf)
    mapped = ds.remapped_knockout(None, sites, models(spark, sf), chosen)
    return lib.reference_pairs(mapped.withColumn("rank", F.col("guide_no")), "Brunello", has_reference=True)


@query("join_13_remapped_pairs", g_sql("SELECT request_id, id, spacing, mode FROM jp", SITES + _CTX + _REMAP + _LOCALPAIRS))
def join_13(spark, sf):
    return local_pairs(spark, sf).select("request_id", "id", "spacing", "mode")


@query("set_5_included_and_filtered", g_sql("""SELECT request_id, id, mode, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE mode WHEN 'nearby' THEN 9 WHEN 'local' THEN 1 WHEN 'cross-exon' THEN 2 ELSE 3 END, abs(spacing - 90), id) AS INT) AS pair_rank FROM jp""", SITES + _CTX + _REMAP + _LOCALPAIRS))
def set_5(spark, sf):
    p = local_pairs(spark, sf)
    a = lib.rank_reference_pairs(p).select("request_id", "id", "mode", "pair_rank")
    return a.unionByName(lib.filtered_pairs(p).select("request_id", "id", "mode", F.lit(None).cast("int").alias("pair_rank")))


@query("des_10_replace_primers", g_sql("""SELECT seq_id AS request_id, seq_id % 2 = 0 AS replaced, CASE WHEN seq_id % 2 = 0 THEN 'validated-centered | Centered around position 9' ELSE 'validated-centered' END AS primer_strategy
 FROM bs WHERE seq_id % 5 = 0""", SITES + PAIRS))
def des_10(spark, sf):
    d = finished(spark, sf, "ko")[1]
    panel = d.where("request_id % 2 = 0").select("request_id", F.lit("ACGTACGTACGTACGTAC").alias("fw_seq"), F.lit("TTGACCATGCATGCATGC").alias("rev_seq"), F.lit("~475 bp").alias("amplicon"),
                                                 F.lit("validated-centered").alias("strategy"), F.lit("Centered around position 9").alias("target_summary"))
    return ds.replace_primers(d.where("err is null"), panel).select("request_id", (F.col("fw_seq") == "ACGTACGTACGTACGTAC").alias("replaced"), "primer_strategy")
