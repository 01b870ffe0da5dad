"""Guide library, off-target database, reporters, reference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import norm
from ..operators import library as lib
from ..operators import reporters as rep
from ..session import staging_folder
from ..sources.stored import read_genes, store_by_gene
from .fixtures import oracle_view, table, view, with_views
from .registry import query

_LIB = "upper(trim(target_gene_symbol)) AS gene, upper(trim(spacer)) AS spacer, upper(trim(pam)) AS pam, exon, rule_set2, strand, cut_position, line_id"
_TOP = f""", lib AS (SELECT {_LIB} FROM fx_guide_library),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY rule_set2 DESC, exon, spacer, line_id) AS rank FROM lib) WHERE rank <= 3)
"""


def library(spark, sf):
    df = view(spark, sf, "fx_guide_library")
    return df.select("line_id", norm.gene_query(F.col("target_gene_symbol")).alias("gene"),
                     norm.gene_query(F.col("spacer")).alias("spacer"), norm.gene_query(F.col("pam")).alias("pam"),
                     "exon", "rule_set2", "strand", "cut_position")


def genes(spark, sf):
    """Requested genes: those of the orders' customers, a part of which the library does not know, plus one alias."""
    return table(spark, sf, "orders").select(F.concat(
        F.lit(" gene"), (F.col("o_custkey") % 700).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("gene"))


_GENES = "asked AS (SELECT DISTINCT 'GENE' || CAST(o_custkey % 700 AS VARCHAR) AS requested_gene FROM orders)"


@query("win_1_top_guides_per_gene", with_views("fx_guide_library", _TOP + "SELECT gene, spacer, pam, exon, rule_set2, line_id, rank FROM top"))
def win_1(spark, sf):
    return lib.top_library_guides(library(spark, sf)).select("gene", "spacer", "pam", "exon", "rule_set2", "line_id", "rank")


@query("join_1_library_lookup", with_views("fx_guide_library", _TOP + f", {_GENES}" + f"""
SELECT a.requested_gene, a.requested_gene AS library_gene, t.spacer, t.pam, t.rule_set2, t.rank,
 count(t.rank) OVER (PARTITION BY a.requested_gene) AS total_guides,
 CASE WHEN t.rank IS NULL THEN '{fx.LIBRARY_NONE_NOTE}' ELSE '' END AS note
FROM asked a LEFT JOIN top t ON t.gene = a.requested_gene"""))
def join_1(spark, sf):
    return lib.lookup_library(genes(spark, sf), library(spark, sf)).select(
        "requested_gene", "library_gene", "spacer", "pam", "rule_set2", "rank", "total_guides", "note")


@query("agg_1_guides_per_gene", with_views("fx_guide_library", _TOP + "SELECT gene, count(*) AS guides, string_agg(spacer, '|' ORDER BY rank) AS spacers FROM top GROUP BY gene"))
def agg_1(spark, sf):
    top = lib.top_library_guides(library(spark, sf))
    listed = F.array_sort(F.collect_list(F.struct("rank", "spacer")))
    return top.groupBy("gene").agg(F.count("*").alias("guides"), F.array_join(
        F.transform(listed, lambda s: s["spacer"]), "|").alias("spacers"))


@query("prj_1_gene_query", with_views("fx_guide_library", "SELECT line_id, upper(trim(target_gene_symbol)) AS gene FROM fx_guide_library"))
def prj_1(spark, sf):
    return view(spark, sf, "fx_guide_library").select("line_id", norm.gene_query(F.col("target_gene_symbol")).alias("gene"))


# --- off-target database -------------------------------------------------------------------------

def targets(spark, sf):
    df = view(spark, sf, "fx_cas_targets")
    return lib.summarize_targets(df.select(
        "id", "gene", "sequence", "chromosome", "position", "strand", "coverage", "oof_score",
        F.create_map(F.lit("a"), F.col("cds_pct_a"), F.lit("b"), F.col("cds_pct_b")).alias("cds_percentages"),
        F.array(F.col("off0").cast("bigint"), F.col("off1").cast("bigint"), F.col("off2").cast("bigint")).alias("offtarget_counts")))


_T = """, t AS MATERIALIZED (SELECT *, substr(sequence,1,20) AS spacer, substr(sequence,21) AS pam,
 CASE WHEN chromosome <> '' AND position <> '' THEN chromosome || ':' || position || ':' || strand ELSE '' END AS location,
 CAST(off0 AS BIGINT) AS f0, CAST(off1 AS BIGINT) AS f1, coalesce(CAST(off2 AS BIGINT), 9007199254740991) AS f2,
 CASE WHEN cds_pct_a BETWEEN 5 AND 50 AND cds_pct_b BETWEEN 5 AND 50 THEN CASE WHEN abs(cds_pct_b-27.5) < abs(cds_pct_a-27.5) THEN cds_pct_b ELSE cds_pct_a END
  WHEN cds_pct_a BETWEEN 5 AND 50 THEN cds_pct_a WHEN cds_pct_b BETWEEN 5 AND 50 THEN cds_pct_b
  WHEN abs(cds_pct_b-27.5) < abs(cds_pct_a-27.5) THEN cds_pct_b ELSE cds_pct_a END AS best_cds,
 max(coverage) OVER (PARTITION BY gene) AS topcov FROM fx_cas_targets),
tt AS MATERIALIZED (SELECT *, CASE WHEN NOT (gcp BETWEEN 20 AND 80) OR contains(spacer,'TTTT') THEN NULL
  WHEN f0 <= 1 AND f1 <= 0 AND f2 <= 0 AND coverage = topcov AND oof_score >= 60 AND (cds_pct_a BETWEEN 5 AND 50 OR cds_pct_b BETWEEN 5 AND 50) THEN 1
  WHEN f0 <= 1 AND f1 <= 0 AND f2 <= 0 AND oof_score >= 40 AND (cds_pct_a BETWEEN 5 AND 80 OR cds_pct_b BETWEEN 5 AND 80) THEN 2 ELSE 3 END AS tier
 FROM (SELECT *, floor((length(spacer)-length(translate(spacer,'GC','')))/20.0*100+0.5) AS gcp FROM t)),
pick AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY gene) AS gt,
 row_number() OVER (PARTITION BY gene ORDER BY tier, f0, f1, f2, coverage DESC, oof_score DESC, abs(best_cds-27.5), id) AS rank
 FROM tt WHERE tier IS NOT NULL) WHERE tier = gt AND rank <= 3)
"""


@query("prj_5_target_summary", with_views("fx_cas_targets", _T + "SELECT id, spacer, pam, location, f0 AS off0, f1 AS off1, f2 AS off2, best_cds, CAST(2 AS INT) AS transcript_count FROM t"))
def prj_5(spark, sf):
    return targets(spark, sf).select("id", "spacer", "pam", "location", "off0", "off1", "off2", "best_cds", "transcript_count")


@query("flt_1_filter_tiers", with_views("fx_cas_targets", _T + "SELECT gene, id, tier FROM tt"))
def flt_1(spark, sf):
    return lib.with_filter_tier(targets(spark, sf)).select("gene", "id", "tier")


@query("win_2_rank_targets", with_views("fx_cas_targets", _T + """SELECT gene, id, rank FROM (SELECT gene, id,
 row_number() OVER (PARTITION BY gene ORDER BY f0, f1, f2, coverage DESC, oof_score DESC, abs(best_cds-27.5), id) AS rank FROM t) WHERE rank <= 3"""))
def win_2(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("gene").orderBy(*lib.target_order())
    return targets(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("gene", "id", "rank")


@query("win_3_first_tier", with_views("fx_cas_targets", _T + """SELECT gene, tier, count(*) AS total_targets FROM
 (SELECT gene, tier, min(tier) OVER (PARTITION BY gene) AS gt FROM tt WHERE tier IS NOT NULL) WHERE tier = gt GROUP BY gene, tier"""))
def win_3(spark, sf):
    return lib.tier_counts(lib.with_filter_tier(targets(spark, sf))).select("gene", "tier", "total_targets")


_DES12 = with_views("fx_cas_targets", _T + f""", asked AS (SELECT DISTINCT 'GENE' || CAST(p_partkey % 150 AS VARCHAR) AS gene_query FROM part),
cnt AS (SELECT gene, tier, count(*) AS n FROM tt GROUP BY gene, tier)
SELECT a.gene_query, p.id, p.rank, p.spacer, coalesce(c.n, 0) AS total_targets,
 CASE p.tier WHEN 1 THEN 'strict' WHEN 2 THEN 'balanced' WHEN 3 THEN 'broad' END AS tier_id,
 CASE WHEN a.gene_query NOT IN (SELECT gene FROM t) THEN '{fx.TARGETS_NO_GENE_NOTE}' WHEN p.rank IS NULL THEN '{fx.TARGETS_NONE_NOTE}'
  WHEN p.tier = 1 THEN '{fx.TARGETS_STRICT_NOTE}' ELSE 'Results required the ' || CASE p.tier WHEN 2 THEN 'balanced' ELSE 'broad' END
  || ' fallback filters because the stricter filters returned no targets.' END AS note
FROM asked a LEFT JOIN pick p ON p.gene = a.gene_query LEFT JOIN cnt c ON c.gene = p.gene AND c.tier = p.tier""")


@query("des_12_target_lookup", _DES12)
def des_12(spark, sf):
    asked = table(spark, sf, "part").select(F.concat(F.lit("gene"), (F.col("p_partkey") % 150).cast("string")).alias("gene"))
    tg = targets(spark, sf)
    return lib.lookup_targets(asked, tg.select("gene").distinct(), tg).select(
        "gene_query", "id", "rank", "spacer", "total_targets", "tier_id", "note")


_STORED: dict = {}


@query("des_12_stored_lookup", _DES12)
def des_12b(spark, sf):
    """The same lookup against a table stored by gene (written once per session): only the folders of asked genes are read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = staging_folder(spark, "targets-by-gene")
        store_by_gene(targets(spark, sf).drop("full_sequence"), path)
        _STORED[key] = path
    asked = table(spark, sf, "part").select(F.concat(F.lit("gene"), (F.col("p_partkey") % 150).cast("string")).alias("gene"))
    found = read_genes(spark, _STORED[key], asked.select(norm.gene_query(F.col("gene")).alias("gene")))
    return lib.lookup_targets(asked, found.select("gene").distinct(), found).select("gene_query", "id", "rank", "spacer", "total_targets", "tier_id", "note")


_RESULTS = """SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'ensg' ELSE 'gene' END || CAST(l_suppkey AS STRING) AS query,
 ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS pos, l_partkey AS id,
 'Gene' || CAST(l_partkey % 97 AS STRING) AS symbol, 'ENSG' || CAST(l_partkey % 89 AS STRING) AS ensembl_id FROM {lineitem}"""


@query("join_3_gene_match", f"""SELECT query, id, match_kind FROM (SELECT *, CASE k WHEN 1 THEN 'symbol' WHEN 2 THEN 'ensembl' ELSE 'first' END AS match_kind,
 row_number() OVER (PARTITION BY query ORDER BY k, pos) AS r FROM (SELECT upper(query) AS query, pos, id,
 CASE WHEN upper(symbol) = upper(query) THEN 1 WHEN upper(ensembl_id) = upper(query) THEN 2 ELSE 3 END AS k FROM ({_RESULTS.replace('{lineitem}', 'lineitem')}))) WHERE r = 1""")
def join_3(spark, sf):
    return lib.match_genes(spark.sql(_RESULTS, lineitem=table(spark, sf, "lineitem"))).select("query", "id", "match_kind")


# --- reference pairs and knockout shortlists -------------------------------------------------------

def library_overrides(spark, sf):
    top = lib.top_library_guides(library(spark, sf)).withColumn("transcript", F.concat(F.lit("NM_"), F.col("rank").cast("string")))
    return lib.library_override(top).withColumn("request_id", F.col("gene"))


def target_overrides(spark, sf):
    return lib.target_override(lib.best_tier_targets(lib.with_filter_tier(targets(spark, sf)))).withColumn("request_id", F.col("gene"))


_NUM = "regexp_replace(CAST(rule_set2 AS VARCHAR), '\\.0$', '')"
_OV = f""", ov AS (SELECT gene, rank, spacer, exon, cut_position - 1 AS cut, CAST(floor((20-length(translate(spacer,'GC','')))/20.0*100+0.5) AS BIGINT) AS gc,
 'Brunello reference guide | Rule Set 2 ' || {_NUM} || ' | Exon ' || exon || ' | NM_' || CAST(rank AS VARCHAR) AS detail FROM top)
"""
_PAIR = """, rp AS (SELECT a.gene AS request_id, 'Brunello-' || CAST(a.rank AS VARCHAR) || '-' || CAST(b.rank AS VARCHAR) AS id,
 a.detail || ' | Reference-only KO mode. Upload GenBank to calculate pair spacing and centered primers.' AS l_note,
 CAST(a.exon AS INT) AS l_exon, CAST(b.exon AS INT) AS r_exon, a.exon = b.exon AS source_same_exon,
 CAST(abs(CAST(b.exon AS INT) - CAST(a.exon AS INT)) AS BIGINT) AS source_exon_gap FROM ov a JOIN ov b ON a.gene = b.gene AND a.rank < b.rank),
rr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN source_same_exon THEN 0 ELSE 1 END, source_exon_gap, id) AS pair_rank FROM rp)
"""


@query("prj_18_guide_overrides", with_views("fx_guide_library fx_cas_targets", _TOP + _OV + _T.replace(", t AS", ", t AS", 1) + """
SELECT 'library' AS source, gene, rank, spacer, gc, cut, detail FROM ov UNION ALL
SELECT 'targets', gene, rank, spacer, CAST(gcp AS BIGINT), NULL, 'Cas-Database reference guide | OOF ' || printf('%.2f', oof_score) || ' | off-targets ' ||
 CAST(f0 AS VARCHAR) || '/' || CAST(f1 AS VARCHAR) || '/' || CAST(f2 AS VARCHAR) || CASE WHEN location <> '' THEN ' | ' || location ELSE '' END FROM pick"""))
def prj_18(spark, sf):
    cols = ["gene", "rank", "spacer", "gc", "cut", "detail"]
    a = library_overrides(spark, sf).select(F.lit("library").alias("source"), *cols)
    return a.unionByName(target_overrides(spark, sf).select(F.lit("targets").alias("source"), *cols))


@query("win_13_reference_pairs", with_views("fx_guide_library", _TOP + _OV + _PAIR + "SELECT request_id, id, l_note, l_exon, r_exon, source_same_exon, source_exon_gap, pair_rank FROM rr"))
def win_13(spark, sf):
    pairs = lib.reference_pairs(library_overrides(spark, sf), "Brunello", has_reference=False)
    return lib.rank_reference_pairs(pairs).select("request_id", "id", "l_note", "l_exon", "r_exon", "source_same_exon",
                                                  "source_exon_gap", "pair_rank")


_PAIR_T = """, tp AS (SELECT a.gene AS request_id, 'Cas-Database-' || CAST(a.rank AS VARCHAR) || '-' || CAST(b.rank AS VARCHAR) AS id,
 row_number() OVER (PARTITION BY a.gene ORDER BY a.rank, b.rank) AS pair_rank FROM pick a JOIN pick b ON a.gene = b.gene AND a.rank < b.rank),
asked AS (SELECT DISTINCT 'GENE' || CAST(p_partkey % 700 AS VARCHAR) AS request_id FROM part),
best AS (SELECT a.request_id, coalesce(r.id, tp.id) AS id, CASE WHEN r.id IS NOT NULL THEN 'Brunello' WHEN tp.id IS NOT NULL THEN 'Cas-Database' END AS source,
 r.l_exon, r.r_exon FROM asked a LEFT JOIN rr r ON r.request_id = a.request_id AND r.pair_rank = 1 LEFT JOIN tp ON tp.request_id = a.request_id AND tp.pair_rank = 1)
"""


def _sources(spark, sf):
    asked = table(spark, sf, "part").select(F.concat(F.lit("GENE"), (F.col("p_partkey") % 700).cast("string")).alias("request_id")).distinct()
    asked = asked.withColumn("gene", F.col("request_id"))
    # The library lacks genes with an odd number here, so both sources and the error row occur.
    first = lib.rank_reference_pairs(lib.reference_pairs(library_overrides(spark, sf), "Brunello", False), 1)
    second = lib.rank_reference_pairs(lib.reference_pairs(target_overrides(spark, sf), "Cas-Database", False), 1)
    return asked, first, second


@query("set_6_source_preference", with_views("fx_guide_library fx_cas_targets", _TOP + _OV + _PAIR + _T + _PAIR_T + """
SELECT request_id, id, source, CASE WHEN id IS NULL THEN 'No Brunello or Cas-Database guide pair was available for ' || request_id || '.' END AS error FROM best"""))
def set_6(spark, sf):
    return lib.prefer_source(*_sources(spark, sf)).select("request_id", "id", "source", "error")


@query("des_7_reference_only_knockout", with_views("fx_guide_library fx_cas_targets", _TOP + _OV + _PAIR + _T + _PAIR_T + """
SELECT request_id, id, 'n/a' AS amp, CASE WHEN l_exon = r_exon THEN 'Reference exon shortlist: exon ' || CAST(l_exon AS VARCHAR) ELSE 'Reference-only KO shortlist' END AS exon,
 source || ' reference-guide shortlist; upload GenBank to calculate pair spacing and centered primers.' AS strategy FROM best WHERE id IS NOT NULL"""))
def des_7(spark, sf):
    chosen = lib.prefer_source(*_sources(spark, sf)).where("error is null")
    return lib.reference_only_designs(chosen).select("request_id", "id", "amp", "exon", "strategy")


# --- reporters -----------------------------------------------------------------------------------

_REP = """, m AS (SELECT pos, page, name, CASE WHEN ex_max <> '' THEN ex_max ELSE default_state_ex_max END AS ex_max, organism FROM fx_reporters),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY page, pos) AS r FROM m WHERE trim(name) <> '') WHERE r = 1)
"""


def reporters(spark, sf):
    df = view(spark, sf, "fx_reporters").withColumn("default_state__ex_max", F.col("default_state_ex_max"))
    return rep.map_reporters(df)


@query("prj_3_reporter_mapper", with_views("fx_reporters", _REP + "SELECT pos, name, ex_max, organism, CAST(0 AS INT) AS aa_length FROM m"))
def prj_3(spark, sf):
    return reporters(spark, sf).select("pos", "name", "ex_max", "organism", "aa_length")


@query("set_2_reporter_dedupe", with_views("fx_reporters", _REP + "SELECT pos, name, ex_max FROM d"))
def set_2(spark, sf):
    return rep.dedupe_reporters(reporters(spark, sf)).select("pos", "name", "ex_max")


@query("win_17_reporter_limit", with_views("fx_reporters", _REP + "SELECT pos, name FROM d WHERE page < 8 ORDER BY page, pos LIMIT 200"))
def win_17(spark, sf):
    return rep.limit_reporters(reporters(spark, sf), 200, 8).select("pos", "name")


@query("prj_4_absolute_url", """SELECT page_id, CASE WHEN r = '' THEN '' WHEN regexp_matches(r, '^https?://[^/]+$') THEN r || '/' WHEN starts_with(r, 'http') THEN r
 WHEN starts_with(r, '/') THEN 'https://www.fpbase.org' || r ELSE 'https://www.fpbase.org/' || r END AS url FROM
 (SELECT page_id, CASE CAST(page_id AS BIGINT) % 4 WHEN 0 THEN url WHEN 1 THEN '/protein/p' || CAST(page_id AS VARCHAR) || '/' WHEN 2 THEN 'protein/x' || CAST(page_id AS VARCHAR) ELSE '' END AS r FROM pages)""")
def prj_4(spark, sf):
    n = F.col("page_id").cast("bigint") % 4
    raw = (F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("/protein/p"), F.col("page_id").cast("string"), F.lit("/")))
           .when(n == 2, F.concat(F.lit("protein/x"), F.col("page_id").cast("string"))).otherwise(""))
    return table(spark, sf, "pages").select("page_id", norm.absolute_url(raw).alias("url"))


@query("prj_16_reporter_summary", with_views("fx_reporters", _REP + """SELECT pos, 'Ex/Em ' || ex_max || '/' || ex_max || CASE WHEN pos % 2 = 0 THEN ' • Brightness ' || CAST(pos AS VARCHAR) ELSE '' END || ' • ' || organism AS summary FROM m"""))
def prj_16(spark, sf):
    df = reporters(spark, sf)
    bright = F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string"))
    return df.select("pos", norm.reporter_summary(F.col("ex_max"), F.col("ex_max"), bright, F.lit(""), F.col("organism")).alias("summary"))
