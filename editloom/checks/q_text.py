"""Request parsing, names and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import norm
from ..functions import text as tx
from ..sources.dims import cassette_names
from .fixtures import table, view, with_views
from .registry import query

_L = ", l AS (SELECT request_id, line FROM fx_requests UNION ALL SELECT request_id + 1000000000, line FROM fx_requests_wide)\n"


def lines(spark, sf):
    a = view(spark, sf, "fx_requests").select("request_id", "line")
    b = view(spark, sf, "fx_requests_wide").select((F.col("request_id") + 1000000000).alias("request_id"), "line")
    return a.unionByName(b)


def _l(body):
    return with_views("fx_requests fx_requests_wide", _L + body)


_CELL = r"regexp_extract({t}, '\b[A-Za-z]{{2,10}}\d{{3}}-A(?:-[A-Za-z0-9]+)?\b')"
_MUT = (r"upper(regexp_extract({t}, '\b([A-Za-z])\s*-?(\d+)\s*-?([A-Za-z])\b', 1)) || regexp_extract({t}, '\b([A-Za-z])\s*-?(\d+)\s*-?([A-Za-z])\b', 2)"
        r" || upper(regexp_extract({t}, '\b([A-Za-z])\s*-?(\d+)\s*-?([A-Za-z])\b', 3))")
_SITE = (r"upper(CASE WHEN regexp_matches({t}, '(?i)\bafter\s+([A-Za-z]\d+|\d+)\b') THEN regexp_extract({t}, '(?i)\bafter\s+([A-Za-z]\d+|\d+)\b', 1)"
         r" WHEN regexp_matches({t}, '(?i)\b(internal|in-frame|inframe)\b') THEN regexp_extract({t}, '(?i)\b([A-Za-z]\d+|\d+)\b', 1) ELSE '' END)")
_SQ = "regexp_replace(lower({t}), '[^a-z0-9]+', '', 'g')"


def _squash(x):
    return "".join(c for c in x.lower() if c.isalnum())


def mention_sql(t):
    sq = _SQ.format(t=t)
    return "CASE " + " ".join(f"WHEN contains({sq}, '{a}') THEN '{k}'" for a, k in fx.REPORTER_NAMES.items()) + " ELSE '' END"


def hint_sql(t):
    return (rf"CASE WHEN regexp_matches(lower({t}), '\bp2a\b') THEN 'p2a' WHEN regexp_matches(lower({t}), '\bt2a\b') THEN 't2a'"
            rf" WHEN regexp_matches(lower({t}), '\bfusion\b|\blink(er)?\b|\bdirect\b') THEN 'fusion' ELSE '' END")


def resolve_sql(end, key, hint):
    parts = []
    for name, ends in fx.REPORTER_CASSETTES.items():
        options = ends[0 if end == "nt" else 1]
        for h, word in (("fusion", "Linker"), ("t2a", "T2A"), ("p2a", "P2A")):
            hit = [o for o in options if word in o]
            if hit:
                parts.append(f"WHEN {key} = '{name}' AND {hint} = '{h}' THEN '{hit[0]}'")
        if len(options) == 1:
            parts.append(f"WHEN {key} = '{name}' AND {hint} = '' THEN '{options[0]}'")
    return "CASE " + " ".join(parts) + " ELSE '' END"


def cassette_sql(sq, end, resolved="''"):
    parts = [f"WHEN {sq} = '{a}' THEN '{k}'" for a, k in fx.CASSETTE_ALIASES.items()]
    if end in ("nt", "ct"):
        parts.append(f"WHEN {resolved} <> '' THEN {resolved}")
    if end in ("", "it"):
        parts += [f"WHEN contains({sq}, '{_squash(k)}') THEN '{k}'" for k in sorted(fx.INTERNAL_TAGS, key=len, reverse=True)]
    for k in sorted(cassette_names(), key=len, reverse=True):
        full = _squash(k)
        if end in ("", "it") or (end == "nt" and k in fx.NT_CASSETTES) or (end == "ct" and k in fx.CT_CASSETTES):
            parts.append(f"WHEN contains({sq}, '{full}') THEN '{k}'")
        if end == "nt" and k.startswith("N:"):
            parts.append(f"WHEN contains({sq}, '{full[1:]}') THEN '{k}'")
    return "CASE " + " ".join(parts) + " ELSE '' END"


_STOP = ", ".join(f"'{w}'" for w in fx.GENE_STOP_WORDS)
_REPS = ", ".join(f"'{w}'" for w in fx.REPORTER_NAMES)
_NORMG = r"coalesce(list_extract(string_split_regex(trim(regexp_replace(regexp_replace(trim(upper({g})), '[-_\s]*(ENSG|NM_|NCBI)\S*', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), '\s+'), 1), '')"
_P1 = f""", p0 AS (SELECT request_id, trim(line) AS t FROM l WHERE trim(line) <> ''),
p1 AS MATERIALIZED (SELECT *, {_SQ.format(t='t')} AS sq, {_CELL.format(t='t')} AS cell_line, {_MUT.format(t='t')} AS mut, {_SITE.format(t='t')} AS site,
 {mention_sql('t')} AS mention, {hint_sql('t')} AS hint FROM p0),
p2 AS MATERIALIZED (SELECT *, {cassette_sql('sq', '')} AS first_key, {resolve_sql('nt', 'mention', 'hint')} AS rnt, {resolve_sql('ct', 'mention', 'hint')} AS rct FROM p1),
p3 AS MATERIALIZED (SELECT *, {cassette_sql('sq', 'nt', 'rnt')} AS key_nt, {cassette_sql('sq', 'ct', 'rct')} AS key_ct, {cassette_sql('sq', 'it')} AS key_it,
 CASE WHEN regexp_matches(lower(t), '\\b(ko|knockout)\\b') THEN 'ko' WHEN regexp_matches(lower(t), '\\b(internal|in-frame|inframe)\\b') THEN 'it'
  WHEN regexp_matches(lower(t), '\\b(c[\\s-]?(?:term(?:inal|inus)?)|ct)\\b') THEN 'ct' WHEN regexp_matches(lower(t), '\\b(n[\\s-]?(?:term(?:inal|inus)?)|nt)\\b') THEN 'nt'
  WHEN site <> '' AND first_key IN ('SPOT','alphaBtx') THEN 'it' WHEN starts_with(first_key, 'N:') THEN 'nt' WHEN first_key <> '' THEN 'ct' WHEN mut <> '' THEN 'pm'
  WHEN regexp_matches(t, '^[A-Za-z0-9._-]+$') THEN 'ko' ELSE 'pm' END AS kind FROM p2),
p4 AS MATERIALIZED (SELECT *, CASE kind WHEN 'nt' THEN CASE WHEN key_nt <> '' THEN key_nt ELSE first_key END WHEN 'ct' THEN CASE WHEN key_ct <> '' THEN key_ct ELSE first_key END
  WHEN 'it' THEN CASE WHEN key_it <> '' THEN key_it ELSE first_key END ELSE first_key END AS key FROM p3),
p5 AS MATERIALIZED (SELECT *, trim(regexp_replace(t, '[,;]+', ' ', 'g')) AS raw, string_split_regex(lower(key), '[^a-z0-9]+') AS pieces FROM p4),
tok AS MATERIALIZED (SELECT request_id, i, w, regexp_matches(w, '[A-Za-z]') AND lower(w) NOT IN ({_STOP}) AND NOT (cell_line <> '' AND lower(w) = lower(cell_line))
 AND NOT (mut <> '' AND lower(w) = lower(mut)) AND NOT list_contains(pieces, lower(w)) AND regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') NOT IN ({_REPS}) AS ok
 FROM (SELECT *, 0 AS i, regexp_extract(raw, '(?i)\\bof\\s+([A-Za-z0-9._-]+)\\b', 1) AS w FROM p5
  UNION ALL SELECT *, unnest(range(1, len(string_split_regex(raw, '\\s+')) + 1)) AS i, unnest(string_split_regex(raw, '\\s+')) AS w FROM p5)),
gt AS (SELECT request_id, arg_min(w, i) AS w FROM tok WHERE ok AND w <> '' GROUP BY request_id),
r AS MATERIALIZED (SELECT p5.request_id, t AS label, {_NORMG.format(g="coalesce(w,'')")} AS gene, cell_line, kind AS project_type,
 CASE WHEN kind IN ('ct','nt') THEN mention ELSE '' END AS requested_reporter, CASE kind WHEN 'pm' THEN mut WHEN 'it' THEN site ELSE '' END AS mutation,
 CASE WHEN kind IN ('ct','nt') THEN key WHEN kind = 'it' THEN CASE WHEN key <> '' THEN key ELSE 'SPOT' END ELSE '{fx.DEFAULT_TAG}' END AS tag FROM p5 LEFT JOIN gt USING (request_id)),
ri AS (SELECT *, array_to_string(list_filter([CASE WHEN gene = '' THEN 'gene' END, CASE WHEN cell_line = '' AND project_type <> 'ko' THEN 'cell line' END,
 CASE WHEN project_type = 'pm' AND mutation = '' THEN 'mutation' END, CASE WHEN project_type = 'it' AND mutation = '' THEN 'in-frame insert site' END,
 CASE WHEN project_type IN ('ct','nt') AND tag = '' THEN 'cassette' END, CASE WHEN project_type <> 'ko' THEN 'GenBank' END], lambda x: x IS NOT NULL), ', ') AS miss FROM r)
"""


def requests(spark, sf):
    return tx.parse_requests(lines(spark, sf))


@query("txt_1_cell_line", _l(f"SELECT request_id, {_CELL.format(t='line')} AS cell_line FROM l"))
def txt_1(spark, sf):
    return lines(spark, sf).select("request_id", tx.cell_line_token(F.col("line")).alias("cell_line"))


@query("txt_2_mutation", _l(f"SELECT request_id, {_MUT.format(t='line')} AS mutation FROM l"))
def txt_2(spark, sf):
    return lines(spark, sf).select("request_id", tx.mutation_token(F.col("line")).alias("mutation"))


@query("txt_3_internal_site", _l(f"SELECT request_id, {_SITE.format(t='line')} AS site FROM l"))
def txt_3(spark, sf):
    return lines(spark, sf).select("request_id", tx.internal_site_token(F.col("line")).alias("site"))


@query("txt_4_edit_class", _l(_P1 + "SELECT request_id, kind FROM p3"))
def txt_4(spark, sf):
    t = F.col("t")
    df = lines(spark, sf).withColumn("t", F.trim("line")).where("t <> ''")
    return df.select("request_id", tx.edit_class(t, tx.mutation_token(t), tx.internal_site_token(t), tx.cassette_key(t)).alias("kind"))


@query("txt_5_cassette", _l(_P1 + "SELECT request_id, first_key, key_nt, key_ct, key_it FROM p3"))
def txt_5(spark, sf):
    t = F.col("t")
    df = lines(spark, sf).withColumn("t", F.trim("line")).where("t <> ''")
    return df.select("request_id", tx.cassette_key(t).alias("first_key"), *[tx.cassette_key(t, e).alias("key_" + e) for e in ("nt", "ct", "it")])


@query("txt_6_gene", _l(_P1 + "SELECT request_id, gene FROM r"))
def txt_6(spark, sf):
    return requests(spark, sf).select("request_id", "gene")


@query("txt_7_reporter_mention", _l(f"SELECT request_id, {mention_sql('line')} AS reporter FROM l"))
def txt_7(spark, sf):
    return lines(spark, sf).select("request_id", tx.reporter_mention(F.col("line")).alias("reporter"))


@query("txt_8_architecture", _l(f"SELECT request_id, {hint_sql('line')} AS hint FROM l"))
def txt_8(spark, sf):
    return lines(spark, sf).select("request_id", tx.architecture_hint(F.col("line")).alias("hint"))


@query("txt_9_issues", _l(_P1 + """SELECT request_id, CASE WHEN miss <> '' THEN 'Needs ' || miss ELSE '' END AS parse_issue,
 (CASE WHEN gene = '' THEN 'Enter a gene or locus.' ELSE '' END) || '#' || (CASE WHEN cell_line = '' AND project_type <> 'ko' THEN 'Add a cell line for the final report.' ELSE '' END) AS project,
 CASE WHEN project_type = 'ko' THEN 'Gene-only KO mode will suggest reference guides only. Upload a reference to generate validation primers automatically.'
  ELSE 'Upload a GenBank file or switch to raw DNA input.' END AS reference, array_to_string(list_filter([
 CASE WHEN project_type = 'pm' AND mutation = '' THEN 'Enter the requested mutation, for example R175H.' END, CASE WHEN project_type = 'it' AND mutation = '' THEN 'Enter the internal insertion site, for example P155.' END,
 CASE WHEN project_type IN ('ct','nt') AND tag = '' THEN 'Choose a cassette.' END], lambda x: x IS NOT NULL), '#') AS design FROM ri"""))
def txt_9(spark, sf):
    r = requests(spark, sf)
    s = tx.section_issues(r)
    has = lambda text: F.array_contains(s["project"], text)
    project = F.concat(F.when(has("Enter a gene or locus."), "Enter a gene or locus.").otherwise(""), F.lit("#"),
                       F.when(has("Add a cell line for the final report."), "Add a cell line for the final report.").otherwise(""))
    return r.select("request_id", "parse_issue", project.alias("project"), F.array_join(s["reference"], "#").alias("reference"),
                    F.array_join(s["design"], "#").alias("design"))


@query("txt_10_request_rows", _l(_P1 + "SELECT request_id, label, gene, cell_line, project_type, requested_reporter, mutation, tag, '250' AS homology_arm FROM r"))
def txt_10(spark, sf):
    return requests(spark, sf).select("request_id", "label", "gene", "cell_line", "project_type", "requested_reporter", "mutation", "tag", "homology_arm")


_M11 = """, s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'p.G' || CAST(doc_id AS VARCHAR) || 'S' WHEN 1 THEN ' g-' || CAST(doc_id AS VARCHAR) || '_s ' WHEN 2 THEN CAST(doc_id AS VARCHAR) || 'GS'
 WHEN 3 THEN 'G ' || CAST(doc_id AS VARCHAR) || ' S' WHEN 4 THEN 'c.12A>G' ELSE 'after P' || CAST(doc_id AS VARCHAR) END AS t FROM documents)"""


def _formats(spark, sf):
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    t = (F.when(k == 0, F.concat(F.lit("p.G"), n, F.lit("S"))).when(k == 1, F.concat(F.lit(" g-"), n, F.lit("_s ")))
         .when(k == 2, F.concat(n, F.lit("GS"))).when(k == 3, F.concat(F.lit("G "), n, F.lit(" S"))).when(k == 4, "c.12A>G")
         .otherwise(F.concat(F.lit("after P"), n)))
    return table(spark, sf, "documents").select("doc_id", t.alias("t"))


@query("txt_11_strict_mutation", "WITH x AS (SELECT 1)" + _M11 + r""", n AS (SELECT doc_id, upper(regexp_replace(regexp_replace(trim(t), '(?i)^p\.', ''), '\s+', '', 'g')) AS v FROM s)
SELECT doc_id, CASE WHEN regexp_matches(v, '^([A-Z])[-_/]?(\d+)[-_/]?([A-Z])$') THEN v[1] || '/' || regexp_extract(v, '\d+') || '/' || right(v, 1) END AS parts,
 CASE WHEN regexp_matches(v, '^([A-Z])[-_/]?(\d+)[-_/]?([A-Z])$') THEN NULL WHEN regexp_matches(v, '^(\d+)([A-Z])([A-Z])$')
 THEN 'Use mutation format ' || v[-2] || regexp_extract(v, '\d+') || v[-1] || ', not ' || v || '. The app expects WT-position-mutant, for example G96S.'
 ELSE 'Cannot parse mutation. Use WT-position-mutant format such as G96S or p.G96S.' END AS err FROM n""")
def txt_11(spark, sf):
    m = tx.strict_mutation(F.col("t"))
    return _formats(spark, sf).withColumn("m", m).select(
        "doc_id", F.concat(F.col("m.wt"), F.lit("/"), F.col("m.pos").cast("string"), F.lit("/"), F.col("m.mut")).alias("parts"), "m.err")


@query("txt_12_strict_site", "WITH x AS (SELECT 1)" + _M11 + r""", n AS (SELECT doc_id, upper(regexp_replace(regexp_replace(trim(t), '(?i)^after\s+', ''), '\s+', '', 'g')) AS v FROM s)
SELECT doc_id, CASE WHEN regexp_matches(v, '^[A-Z]?\d+$') THEN regexp_extract(v, '^[A-Z]?') END AS wt, CASE WHEN regexp_matches(v, '^[A-Z]?\d+$') THEN CAST(regexp_extract(v, '\d+') AS INT) END AS pos,
 CASE WHEN NOT regexp_matches(v, '^[A-Z]?\d+$') THEN 'Use an internal insertion site such as P155 or 155.' END AS err FROM n""")
def txt_12(spark, sf):
    return _formats(spark, sf).select("doc_id", tx.strict_site(F.col("t")).alias("m")).select("doc_id", "m.wt", "m.pos", "m.err")


@query("txt_13_custom_guides", with_views("fx_history", """SELECT project_id, guide1 || CASE WHEN guide2 <> '' THEN '/' || guide2 ELSE '' END AS guides FROM fx_history"""))
def txt_13(spark, sf):
    joined = F.concat(F.lower("guide1"), F.lit(" ;\n"), F.lit("--,"), F.col("guide2"), F.lit("\r\nACGT"))
    return view(spark, sf, "fx_history").select("project_id", F.array_join(tx.custom_guides(joined), "/").alias("guides"))


@query("txt_14_note_numbers", "SELECT doc_id, CAST(doc_id - 1 AS BIGINT) AS cut, CAST(doc_id % 9 AS INT) AS exon FROM documents")
def txt_14(spark, sf):
    n = F.col("doc_id").cast("string")
    note = F.concat(F.lit("x | cut at "), n, F.lit(", Exon "), (F.col("doc_id") % 9).cast("string"), F.lit(" (5 bp into exon 7)"))
    return table(spark, sf, "documents").select("doc_id", tx.cut_from_note(note).alias("cut"), tx.exon_from_note(note).alias("exon"))


@query("txt_15_internal_definition", _l(_P1 + "SELECT request_id, site, key_it AS tag, CASE WHEN contains(lower(t), 'spot') THEN 'SPOT' WHEN contains(lower(t), 'alphabtx') THEN 'alphaBtx' ELSE '' END AS tag_key FROM p3"))
def txt_15(spark, sf):
    df = lines(spark, sf).where("trim(line) <> ''")
    d = tx.internal_definition(F.col("line"))
    return df.select("request_id", d["site"].alias("site"), d["tag"].alias("tag"), tx.internal_tag_key(F.col("line")).alias("tag_key"))


@query("src_11_request_lines", _l("SELECT request_id, line FROM l WHERE trim(line) <> ''"))
def src_11(spark, sf):
    """Request texts of several lines each, split again into lines."""
    from ..sources.files import request_lines
    texts = lines(spark, sf).withColumn("grp", F.col("request_id") % 97).groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("request_id", "line"))).alias("a"))
    texts = texts.select("grp", "a", F.array_join(F.transform("a", lambda x: x["line"]), "\r\n").alias("text"))
    split = request_lines(texts, "text")
    return split.select(F.get("a", F.col("line_index"))["request_id"].alias("request_id"), "line")


@query("flt_5_runnable_rows", _l(_P1 + "SELECT request_id, project_type = 'ko' AND gene <> '' AS runnable FROM r"))
def flt_5(spark, sf):
    r = requests(spark, sf)
    gene_only = (F.col("project_type") == "ko") & (F.col("gene") != "") & (F.size(tx.custom_guides(F.col("custom_guides"))) == 0)
    return r.select("request_id", (tx.has_reference(r) | gene_only).alias("runnable"))


@query("flt_6_edition_filter", _l(_P1 + f"""SELECT request_id, CASE WHEN bad THEN CASE WHEN kind = 'ko' THEN 'ko' ELSE 'pm' END ELSE kind END AS project_type,
 CASE WHEN bad THEN '{fx.COMMUNITY_ONLY_MESSAGE}' ELSE '' END AS issue FROM (SELECT *, regexp_matches(lower(t), '\\b(internal|in-frame|inframe)\\b') OR regexp_matches(lower(t), '\\b(c[\\s-]?(?:term(?:inal|inus)?)|ct)\\b')
 OR regexp_matches(lower(t), '\\b(n[\\s-]?(?:term(?:inal|inus)?)|nt)\\b') OR first_key <> '' AS bad FROM p3)"""))
def flt_6(spark, sf):
    r = tx.parse_requests(lines(spark, sf), community=True)
    return r.select("request_id", "project_type", F.when(F.col("parse_issue") == fx.COMMUNITY_ONLY_MESSAGE, F.col("parse_issue")).otherwise("").alias("issue"))


# --- names and labels ----------------------------------------------------------------------------

@query("prj_2_gene_token", _l("SELECT request_id, " + _NORMG.format(g="line || '-ENSG0001 x'") + " AS gene FROM l"))
def prj_2(spark, sf):
    return lines(spark, sf).select("request_id", F.coalesce(norm.gene_token(F.concat("line", F.lit("-ENSG0001 x"))), F.lit("")).alias("gene"))


_FAM = ("CASE " + " ".join(f"WHEN contains(lower(x), '{w.lower()}') THEN '{w}'" for w in ("SD40", "dTAG", "mAID", "2xHA", "EGFP", "mScarlet", "mCherry"))
        + " ELSE x END")
_TAGS = ", ".join(f"('{n}')" for n in cassette_names())
_SAFE = "CASE WHEN trim(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN '{d}' ELSE trim(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '_') END"


@query("prj_8_tag_family", _l(_P1 + f"SELECT request_id, {_FAM} AS family FROM (SELECT request_id, regexp_replace(tag, '^N:', '') AS x FROM r)"))
def prj_8(spark, sf):
    return requests(spark, sf).select("request_id", norm.tag_family(F.col("tag")).alias("family"))


@query("prj_7_names", _l(_P1 + f""", f AS (SELECT *, {_FAM} AS fam FROM (SELECT *, regexp_replace(tag, '^N:', '') AS x FROM r)),
m AS (SELECT request_id, {_SAFE.format(x='gene', d='GENE')} || '_' || CASE project_type WHEN 'pm' THEN {_SAFE.format(x='upper(mutation)', d='PM')} WHEN 'ko' THEN 'KO' ELSE {_SAFE.format(x='fam', d='KI')} || '_KI' END AS prefix FROM f)
SELECT request_id, prefix || '_gRNA2' AS guide, prefix || '_Rev' AS primer FROM m"""))
def prj_7(spark, sf):
    c = [F.col(x) for x in ("gene", "project_type", "mutation", "tag")]
    return requests(spark, sf).select("request_id", norm.guide_name(c[0], c[1], F.lit(2), c[2], c[3]).alias("guide"),
                                      norm.primer_name(c[0], c[1], "Rev", c[2], c[3]).alias("primer"))


_TYPES = "SELECT DISTINCT p_type FROM part"


@query("prj_9_edit_class_names", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ko' WHEN 1 THEN 'pm' WHEN 2 THEN 'nt' WHEN 3 THEN 'it' WHEN 4 THEN NULL WHEN 5 THEN 'ct' ELSE NULL END AS manifest,
 CASE p_partkey % 8 WHEN 0 THEN 'ko' WHEN 1 THEN 'pm' WHEN 2 THEN 'nt' WHEN 3 THEN 'it' WHEN 4 THEN 'pm' WHEN 5 THEN 'ct' WHEN 6 THEN 'it' ELSE '' END AS batch FROM part""")
def prj_9(spark, sf):
    words = ["Knockout ", "Point Mutation", "N-terminal tag", "internal tag", "SNP", "CT", "in-frame", "other"]
    text = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", norm.manifest_edit_class(text).alias("manifest"), norm.batch_edit_class(text).alias("batch"))


@query("prj_10_organism", with_views("fx_sequences", """SELECT seq_id, CASE WHEN seq_id % 7 = 0 THEN '6' ELSE '1' END AS organism, CASE seq_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '8' WHEN 2 THEN '12' ELSE '1' END AS other FROM fx_sequences"""))
def prj_10(spark, sf):
    other = F.element_at(F.array(F.lit("Rnor_6.0"), F.lit("zebrafish GRCz10"), F.lit("Sus scrofa"), F.lit("")), (F.col("seq_id") % 4 + 1).cast("int"))
    return view(spark, sf, "fx_sequences").select("seq_id", norm.organism_id(F.col("assembly")).alias("organism"), norm.organism_id(other).alias("other"))


_CLB = "CASE WHEN b = 'HMGUI001A' THEN 'MDCI053A' ELSE b END"


@query("prj_11_cell_line_base", with_views("fx_history fx_requests fx_requests_wide", _L + _P1 + f"""SELECT k, {_CLB} AS base FROM (SELECT k, regexp_replace(regexp_replace(upper(v), '[^A-Z0-9]+', '', 'g'), '([A-Z0-9]+A)\\w*$', '\\1') AS b
 FROM (SELECT project_id AS k, parental_line AS v FROM fx_history UNION ALL SELECT CAST(request_id AS VARCHAR), cell_line FROM r))"""))
def prj_11(spark, sf):
    a = view(spark, sf, "fx_history").select(F.col("project_id").alias("k"), F.col("parental_line").alias("v"))
    b = requests(spark, sf).select(F.col("request_id").cast("string").alias("k"), F.col("cell_line").alias("v"))
    return a.unionByName(b).select("k", norm.cell_line_base(F.col("v")).alias("base"))


_FOLD = """, f AS (SELECT request_id, CASE request_id % 4 WHEN 0 THEN CAST(1000 + request_id AS VARCHAR) || ' (' || CAST(500 + request_id AS VARCHAR) || ') - ' || trim(line) WHEN 1 THEN CAST(1000 + request_id AS VARCHAR) || ' - ' || trim(line)
 WHEN 2 THEN 'Template' ELSE trim(line) END AS name FROM l)"""


def folders(spark, sf):
    k, n, t = F.col("request_id") % 4, F.col("request_id"), F.trim("line")
    name = (F.when(k == 0, F.concat((n + 1000).cast("string"), F.lit(" ("), (n + 500).cast("string"), F.lit(") - "), t))
            .when(k == 1, F.concat((n + 1000).cast("string"), F.lit(" - "), t)).when(k == 2, "Template").otherwise(t))
    return lines(spark, sf).select("request_id", name.alias("name"))


@query("prj_12_folder_numbers", _l(_FOLD + " SELECT request_id, CASE WHEN request_id % 4 < 2 THEN CAST(1000 + request_id AS VARCHAR) ELSE '' END AS project_no, CASE WHEN request_id % 4 = 0 THEN CAST(500 + request_id AS VARCHAR) ELSE '' END AS parent_no FROM f"))
def prj_12(spark, sf):
    return folders(spark, sf).select("request_id", norm.project_number(F.col("name")).alias("project_no"), norm.parent_number(F.col("name")).alias("parent_no"))


@query("src_12_folder_requests", _l(_P1 + _FOLD.replace(", f AS", ", f AS", 1) + """ SELECT f.request_id, f.name AS project_folder, CASE WHEN f.request_id % 4 < 2 THEN CAST(1000 + f.request_id AS VARCHAR) ELSE '' END AS project_no,
 r.gene, r.project_type FROM f JOIN r USING (request_id) WHERE f.name <> 'Template'"""))
def src_12(spark, sf):
    from ..sources.files import folder_requests
    return folder_requests(folders(spark, sf)).select("request_id", "project_folder", "project_no", "gene", "project_type")


_FN = r"trim(regexp_replace(regexp_replace({x}, '[<>:\"/\\|?*\x00-\x1f]', '', 'g'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query("prj_13_project_folder", _l(_P1 + f"""SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'given name' WHEN 1 THEN CAST(1000 + request_id AS VARCHAR) || ' (77) - ' || {_FN.format(x='label')}
 ELSE (CASE WHEN gene = '' THEN 'GENE' ELSE gene END) || ' ' || {_FN.format(x='label')} || ' in ' || CASE WHEN cell_line = '' THEN 'CELL-LINE' ELSE cell_line END END AS folder FROM r"""))
def prj_13(spark, sf):
    k, c = F.col("request_id") % 3, F.col
    given = F.when(k == 0, "given  name<>").otherwise("")
    number = F.when(k == 1, (c("request_id") + 1000).cast("string")).otherwise("")
    return requests(spark, sf).select("request_id", norm.project_folder(given, number, F.when(k == 1, "77").otherwise(""), c("edit_summary"), c("label"),
                                                                        c("gene"), c("cell_line")).alias("folder"))


@query("prj_14_labels", _l(_P1 + """, d AS (SELECT *, gene || CASE project_type WHEN 'pm' THEN ' p.N32R' WHEN 'ko' THEN ' knockout' WHEN 'it' THEN ' internal ' || tag || ' after N32' WHEN 'ct' THEN ' C-terminal ' || tag ELSE ' N-terminal ' || tag END AS canonical FROM r)
SELECT request_id, canonical, CASE WHEN request_id % 2 = 0 THEN canonical WHEN project_type = 'pm' AND label <> canonical THEN canonical || ' | requested: ' || label ELSE label END AS shown,
 CASE WHEN request_id % 2 = 0 THEN replace(canonical, ' p.N32R', ' N32R') ELSE label END AS batch FROM d"""))
def prj_14(spark, sf):
    c = F.col
    args = (c("project_type"), c("gene"), F.lit("N"), F.lit(32), F.lit("R"), c("tag"))
    asked = F.when(c("request_id") % 2 == 0, "").otherwise(c("label"))
    df = requests(spark, sf).withColumn("canonical", norm.design_label(*args))
    return df.select("request_id", "canonical", norm.displayed_label(c("project_type"), c("canonical"), asked).alias("shown"),
                     norm.batch_label(asked, *args).alias("batch"))


@query("prj_15_class_change", _l(_P1 + f""", k AS (SELECT *, CASE request_id % 6 WHEN 0 THEN 'it' WHEN 1 THEN 'ct' WHEN 2 THEN 'nt' WHEN 3 THEN 'ko' WHEN 4 THEN 'pm' ELSE 'zz' END AS nk FROM r)
SELECT request_id, CASE WHEN nk = 'zz' THEN 'pm' ELSE nk END AS project_type, CASE nk WHEN 'zz' THEN tag WHEN 'it' THEN CASE WHEN tag IN ('SPOT','alphaBtx') THEN tag ELSE 'SPOT' END
 WHEN 'ct' THEN CASE WHEN tag IN (SELECT * FROM (VALUES {_TAGS})) AND NOT starts_with(tag, 'N:') THEN tag ELSE 'SD40-2xHA' END WHEN 'nt' THEN CASE WHEN tag IN (SELECT * FROM (VALUES {_TAGS})) THEN tag ELSE 'N:EGFP-Linker' END ELSE 'dTAG-V5' END AS tag,
 CASE nk WHEN 'it' THEN CASE WHEN regexp_matches(mutation, '(?i)^[A-Z]?\\d+$') THEN mutation ELSE '' END WHEN 'ko' THEN '' ELSE mutation END AS mutation FROM k"""))
def prj_15(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("it", "ct", "nt", "ko", "pm", "zz")])
    new = F.element_at(kinds, (F.col("request_id") % 6 + 1).cast("int"))
    kind, tag, mutation = norm.reset_fields(F.col("tag"), F.col("mutation"), new)
    return requests(spark, sf).select("request_id", kind.alias("project_type"), tag.alias("tag"), mutation.alias("mutation"))


@query("prj_20_projections", with_views("fx_sequences", """SELECT seq_id, 'Parsed ' || CAST(length(seq) AS VARCHAR) || ' bp with 4 features. CDS: ' || gene || ', 4 segments, 219 aa.' AS debug, lower(gene) AS file_key,
 CASE seq_id % 3 WHEN 0 THEN 'Knockout' WHEN 1 THEN 'C-terminal tag / reporter' ELSE 'Point mutation' END AS class_label FROM fx_sequences"""))
def prj_20(spark, sf):
    from ..plans.designs import debug_line
    from .fixtures import models
    kind = F.element_at(F.array(F.lit("ko"), F.lit("ct"), F.lit("zz")), (F.col("seq_id") % 3 + 1).cast("int"))
    m = models(spark, sf)
    return m.select("seq_id", debug_line(m, F.size("exons")).alias("debug"), F.lower(F.trim("gene")).alias("file_key"), norm.edit_class_label(kind).alias("class_label"))
