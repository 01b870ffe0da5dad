"""Registered queries of the corpus operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from editloom.session import staging_folder

from . import (conversations, decontaminate, exact_dedup, hidden_markov, near_join, packing, periodic, secret_scan, sharding, token_files,
               toxicity, url_filter, warc)
from .common import table, text_of

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM d)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""")
def op1(spark, sf_dir):
    return exact_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, start, start + length(hit) AS stop FROM (
 SELECT doc_id, hits[i] AS hit, vals[i] AS val,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
 FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits,
   regexp_extract_all(text, '{pattern}', {rule.group}) AS vals FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE length(val) >= {rule.least}""")
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    one = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY start, rank) AS every
 FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(every, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


@query("op2_secret_scan", _secret_sql())
def op2(spark, sf_dir):
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), staging_folder(spark, "blob-ledger"))


def _url_sql() -> str:
    own = url_filter.Reputation()
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    action = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _, _) in zip(fits, rules)) + " END"

    def level(name, source, keys, prior):
        return f"""
{name}_s AS (SELECT {keys}, n, bad, prior FROM {source}{prior}),
{name}_m AS (SELECT sum(bad) / sum(n) AS mean, sum(n * power(bad / n - prior, 2)) / sum(n) AS spread, count(*) / sum(n) AS noise FROM {name}_s WHERE n > 0),
{name}_w AS (SELECT least(greatest(coalesce(CASE WHEN spread - mean * (1 - mean) * noise > 0 THEN mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1 END,
  {own.most}), {own.least}), {own.most}) AS s FROM {name}_m),
{name} AS (SELECT {keys}, (bad + prior * (SELECT s FROM {name}_w)) / (n + (SELECT s FROM {name}_w)) AS mean, n + (SELECT s FROM {name}_w) AS weight FROM {name}_s)"""
    return f"""WITH o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix
 FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), t AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
e AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS prior FROM t),
{level("top", "t", "suffix", ", e")},
{level("mid", "d", "domain", " JOIN (SELECT suffix, mean AS prior FROM top) USING (suffix)")},
{level("low", "h", "host", " JOIN (SELECT domain, mean AS prior FROM mid) USING (domain)")}
SELECT page_id, host, path, {rule} AS rule, coalesce({action},
 CASE WHEN mean - {own.z} * sqrt(mean * (1 - mean) / (weight + 1)) > {own.limit} THEN 'block' ELSE 'allow' END) AS verdict,
 round(mean, 9) AS bad_rate, round(mean - {own.z} * sqrt(mean * (1 - mean) / (weight + 1)), 9) AS bound FROM p JOIN low USING (host)"""


@query("op3_url_filter", _url_sql())
def op3(spark, sf_dir):
    """A page's outcome is bad when the label with its id says low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int").alias("bad"))
    out = url_filter.judge(table(spark, sf_dir, "pages"), outcomes)
    return out.withColumns({"bad_rate": F.round("bad_rate", 9), "bound": F.round("bound", 9)})


@query("op4_token_files")
def op4(spark, sf_dir):
    path = staging_folder(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read_tokens(spark, path))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_decontamination")
def op9(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_near_join")
def op10(spark, sf_dir):
    return near_join.classes_of(table(spark, sf_dir, "documents"))


@query("op7_hidden_markov")
def op7(spark, sf_dir):
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def _warc_sql() -> str:
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if "\n" not in x else "chr(10)"
    text = "payload"
    for pattern, put in warc.TEXT_STEPS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {lit(put)}, 'g')"
    def uuid(x):
        cuts = " || '-' || ".join(f"substr(sha256({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cuts} || '>'"
    title = f"trim(regexp_replace(regexp_extract(payload, '{warc.TITLE}', 1), '\\s+', ' ', 'g'))"
    language = f"translate(regexp_extract(payload, '{warc.LANGUAGE}', 1), chr(13) || chr(10), '  ')"
    end = "chr(13) || chr(10)"
    fields = f"'title: ' || title || {end} || 'language: ' || language || {end} || 'text-digest: sha256:' || sha256(text) || {end}"
    rid = uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || uri || '|sha256:' || sha256(payload)")
    own = uuid("kind || '|' || rid")
    return f"""WITH p AS (SELECT page_id, translate(coalesce(url, ''), {end}, '  ') AS uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {rid} AS rid, {text} AS text, {title} AS title, {language} AS language FROM p),
k AS (SELECT *, 'metadata' AS kind, {fields} AS block FROM r UNION ALL SELECT *, 'conversion' AS kind, text AS block FROM r)
SELECT page_id, kind, {own} AS record_id, rid AS refers_to, uri AS target_uri, 'sha256:' || sha256(payload) AS source_digest, 'text/html; charset=utf-8' AS source_type,
 'sha256:' || sha256(block) AS block_digest, true AS sound, CAST(strlen(block) AS BIGINT) AS block_bytes FROM k"""


@query("op6_warc_derivatives", _warc_sql())
def op6(spark, sf_dir):
    return warc.build(table(spark, sf_dir, "pages"), staging_folder(spark, "warc"))


@query("op11_ring_shards")
def op11(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), staging_folder(spark, "shards"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = periodic.with_planted_runs(text_of(), F.col("doc_id"))
    return periodic.digests(periodic.periodic_runs(docs, {"doc_id": F.col("doc_id")}, text))


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)
