"""Deterministic input views over the given tables, in SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frame import barrier
from ..sources.models import build_models

_DNA = "'0123456789abcdef','ACGTACGTACGTACGT'"
_RAW = " || ".join(f"md5(CAST(doc_id AS STRING) || ':{i}')" for i in range(63))
_KEY = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
_LSEQ = f"translate(md5(CAST({_KEY} AS STRING)),{_DNA})"
_QSEQ = f"substr(translate(md5(CAST(l_orderkey AS STRING)),{_DNA}),1,20)"

FX = {
    "fx_sequences": f"""SELECT CAST(doc_id AS BIGINT) AS seq_id, 'GENE' || CAST(doc_id AS STRING) AS gene,
 CASE WHEN doc_id % 7 = 0 THEN 'GRCm39' ELSE 'GRCh38' END AS assembly,
 substr(raw,1,300) || 'ATG' || substr(raw,304,1214) || 'TAA' || substr(raw,1521) AS seq
 FROM (SELECT doc_id, translate(({_RAW}),{_DNA}) AS raw FROM {{documents}}) t""",
    "fx_cds_segments": """SELECT CAST(doc_id AS BIGINT) AS seq_id, s.seg_idx, s.seg_start, s.seg_end FROM {documents} CROSS JOIN
 (SELECT 1 AS seg_idx, 300 AS seg_start, 421 AS seg_end UNION ALL SELECT 2, 600, 841 UNION ALL SELECT 3, 1000, 1178
  UNION ALL SELECT 4, 1400, 1520) s""",
    "fx_exons": """SELECT CAST(doc_id AS BIGINT) AS seq_id, s.exon_number, s.exon_start, s.exon_end FROM {documents} CROSS JOIN
 (SELECT 1 AS exon_number, 250 AS exon_start, 421 AS exon_end UNION ALL SELECT 2, 600, 841 UNION ALL SELECT 3, 1000, 1178
  UNION ALL SELECT 4, 1400, 1700) s""",
    "fx_requests": """SELECT CAST(doc_id AS BIGINT) AS request_id, 'GENE' || CAST(doc_id AS STRING) || CASE doc_id % 5
 WHEN 0 THEN ' knockout' WHEN 1 THEN ' N32R' WHEN 2 THEN ' internal SPOT after P155'
 WHEN 3 THEN ' C-terminal SD40-2xHA' ELSE ' N-terminal N:EGFP-Linker' END
 || CASE WHEN doc_id % 11 = 0 THEN '' ELSE ' BIHi00' || CAST(doc_id % 9 AS STRING) || '-A' END AS line FROM {documents}""",
    "fx_requests_wide": """SELECT CAST(doc_id AS BIGINT) AS request_id, CASE doc_id % 12
 WHEN 0 THEN 'please make a knockout of gene' || CAST(doc_id AS STRING)
 WHEN 1 THEN 'GENE' || CAST(doc_id AS STRING) || ' n -32 r, WTSI' || CAST(100 + doc_id % 800 AS STRING) || '-A-12'
 WHEN 2 THEN 'alphaBtx in-frame 88 GENE' || CAST(doc_id AS STRING)
 WHEN 3 THEN 'GENE' || CAST(doc_id AS STRING) || '-ENSG000123 ct EGFP' || CASE WHEN doc_id % 24 = 3 THEN ' t2a' ELSE '' END
 WHEN 4 THEN 'n-term mStayGold2 ' || CASE WHEN doc_id % 3 = 0 THEN 'fusion' WHEN doc_id % 3 = 1 THEN 'p2a' ELSE '' END || ' of GENE' || CAST(doc_id AS STRING)
 WHEN 5 THEN 'dTAG-V5 GENE' || CAST(doc_id AS STRING)
 WHEN 6 THEN 'N:mAID-Linker, GENE' || CAST(doc_id AS STRING) || '; ABC123-A'
 WHEN 7 THEN 'mScarlet P2A C terminus GENE' || CAST(doc_id AS STRING)
 WHEN 8 THEN 'GENE' || CAST(doc_id AS STRING)
 WHEN 9 THEN 'spot after A' || CAST(doc_id % 300 AS STRING) || ' GENE' || CAST(doc_id AS STRING) || ' XY001-A'
 WHEN 10 THEN '  '
 ELSE 'miniIAA7-HA-P2A-HygroR nt GENE' || CAST(doc_id AS STRING) || ' HMGUI001-A' END AS line FROM {documents}""",
    "fx_guide_library": f"""SELECT {_KEY} AS line_id, 'gene' || CAST(l_partkey % 500 AS STRING) AS target_gene_symbol,
 substr({_LSEQ},1,20) AS spacer, substr({_LSEQ},21,1) || 'GG' AS pam,
 CAST(l_linenumber AS STRING) AS exon, l_discount AS rule_set2,
 CASE WHEN l_returnflag = 'R' THEN 'antisense' ELSE 'sense' END AS strand, l_orderkey AS cut_position FROM {{lineitem}}""",
    "fx_cas_targets": f"""SELECT {_KEY} AS id, 'GENE' || CAST(l_suppkey AS STRING) AS gene,
 substr({_LSEQ},1,20) || substr({_LSEQ},21,1) || 'GG' AS sequence,
 CAST(l_quantity AS INT) % 3 AS off0, CAST(l_quantity AS INT) % 5 AS off1,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey % 4 END AS off2,
 l_linenumber AS coverage, l_tax * 1000 AS oof_score, l_discount * 1000 AS cds_pct_a, l_quantity * 2 AS cds_pct_b,
 CASE WHEN l_linenumber = 3 THEN '' ELSE 'chr' || CAST(l_partkey % 22 + 1 AS STRING) END AS chromosome,
 CAST(l_orderkey AS STRING) AS position, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM {{lineitem}}""",
    "fx_reporters": """SELECT p_partkey AS pos, CAST(floor(p_partkey / 250) AS INT) AS page,
 CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || ' ' || CAST(p_size AS STRING)) ELSE ' ' || p_brand || ' ' || CAST(p_size AS STRING) END AS name,
 CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(400 + p_size AS STRING) END AS ex_max,
 CAST(410 + p_size AS STRING) AS default_state_ex_max, p_type AS organism FROM {part}""",
    "fx_hsps": f"""SELECT {_KEY} AS hsp_id, l_orderkey AS query_id, 20 AS query_len, 'NM_' || CAST(l_partkey % 50 AS STRING) AS accession,
 CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey * 100 ELSE l_suppkey * 100 + 19 END AS hit_from,
 CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey * 100 + 19 ELSE l_suppkey * 100 END AS hit_to,
 1 AS query_from, CASE WHEN l_returnflag = 'R' THEN 19 ELSE 20 END AS query_to,
 20 - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS align_len, 0 AS gaps, {_QSEQ} AS qseq,
 CASE WHEN l_linenumber % 4 = 0 THEN {_QSEQ} ELSE substr({_QSEQ},1,l_linenumber * 2) || 'N' || substr({_QSEQ},l_linenumber * 2 + 2) END AS hseq,
 CASE WHEN l_linenumber % 4 = 0 THEN 20 ELSE 19 END - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS identity FROM {{lineitem}}""",
    "fx_history": f"""SELECT 'Proj' || CAST(o_orderkey AS STRING) AS project_id, 'BIHi00' || CAST(o_custkey % 9 AS STRING) || '-A-' || CAST(o_orderkey % 4 AS STRING) AS parental_line,
 'GENE' || CAST(o_custkey % 1000 AS STRING) AS target_gene,
 CASE WHEN o_orderkey % 8 = 5 THEN NULL WHEN o_orderstatus = 'F' THEN 'ssODN' ELSE 'donor' END AS donor_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'pm' WHEN 2 THEN 'ki' ELSE 'other' END AS modification_class,
 CASE o_orderkey % 6 WHEN 0 THEN 'N32R' WHEN 1 THEN 'C-terminal EGFP' WHEN 2 THEN 'exon 1 insert' WHEN 3 THEN 'knockout' ELSE '' END AS modification_description,
 substr(translate(md5(CAST(o_orderkey % 500 AS STRING) || 'a'),{_DNA}),1,20) AS guide1, substr(translate(md5(CAST(o_orderkey % 500 AS STRING) || 'b'),{_DNA}),1,20) AS guide2,
 'donor' || CAST(o_orderkey % 13 AS STRING) AS donor_name,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE translate(md5(CAST(o_orderkey % 700 AS STRING) || 'd'),{_DNA}) END AS donor_sequence,
 CAST(o_orderdate AS DATE) AS registration_date FROM {{orders}}""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sequences that one task builds and designs on.
PART_ROWS = 5000


def sequence_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the sequences: as many as a shuffle has, or cores, and more as the table grows. The count reads no rows.

    Fewer than a shuffle has would let Spark deal the models out anew, and gather them by size."""
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-table(spark, sf_dir, "documents").count() // PART_ROWS))


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A view; ``by``: a column of its one table whose equal values come to one task before the texts of the view are made."""
    text = FX[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if name == "fx_sequences":
        # The ids are spread over all tasks before their text is made: a small file is one task's, and the text is wide to send.
        used["documents"] = used["documents"].select("doc_id").repartition(sequence_parts(spark, sf_dir), F.col("doc_id").cast("bigint"))
    if by is not None:
        source = next(iter(used))
        used[source] = used[source].select(*[c for c in used[source].columns if c in text]).repartition(by)
    df = spark.sql(text, **used)
    if name == "fx_sequences":
        # The barrier keeps filters on the text (and those Spark infers from them for joined tables) from making it again.
        df = barrier(df.withColumnRenamed("seq", "_seq"), {"seq": F.col("_seq")}).drop("_seq")
    return df


def oracle_view(name: str) -> str:
    text = FX[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def with_views(names: str, body: str) -> str:
    """Oracle text: the named views (space separated) as CTEs, then ``body`` ('name AS (...)' parts allowed
    in front via a leading comma)."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({oracle_view(n)})" for n in names.split())
    body = body.strip()
    return f"WITH {ctes}\n{body}" if not body.startswith(",") else f"WITH {ctes}{body}"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = view(spark, sf_dir, "fx_sequences")
    return build_models(seqs, view(spark, sf_dir, "fx_cds_segments"), view(spark, sf_dir, "fx_exons"), sequence_parts(spark, sf_dir))
