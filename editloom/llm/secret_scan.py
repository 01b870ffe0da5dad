"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the digest of its content (the blob). The ledger holds one row per blob, rule
and rule version that was scanned, with the spans found. A scan takes only the pairs that the ledger lacks, appends
them, and joins the findings back to all paths that ever held the blob."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pass_rows, stage, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern whose matches are found leftmost first without overlap, and the least length of a group."""
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    #: Text that every match holds: blobs without it need no pattern pass.
    hint: str = ""


# The patterns of the base kinds.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds that this scanner reports beside the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, hint="-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hint="gh"),
)
RULES = BASE_RULES + MORE_RULES

#: Unseen blobs (a digest of 64 letters and a few pairs each) that may be broadcast; more are joined by shuffle.
BROADCAST_BLOBS = 200_000
#: The ledger's columns.
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,stop:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points, end exclusive: lengths of the pieces between matches and of the matches, summed up."""
    if rule.kind == "hex":  # runs shorter than the least length never count, so the pattern may skip them at once
        pattern, test = f"[0-9a-f]{{{rule.least},}}", None
    else:
        pattern, test = rule.pattern, rule.least
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, part):
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        good = part["hit"].isNotNull() if test is None else F.coalesce(F.length(part["value"]), F.lit(0)) >= test
        one = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    may = text.contains(rule.hint) if rule.hint else text.rlike(pattern)
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def versions_of(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob): each document is one version of one path; null text is the empty blob."""
    return pass_rows(docs, {"path": F.col(path), "blob": F.sha2(text_of(), 256)})


def _pairs(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the distinct blobs that have not met all rules, and the (kind, version) pairs they lack. Only digests
    are moved; copies are merged within their task first."""
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    todo = F.coalesce(F.array_except(_pairs(rules), "done"), _pairs(rules))
    return blobs.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans): each distinct blob is scanned once, by the rules it has not met yet.

    A copy of a text is merged within its task before the shuffle, so a text with a third of all rows is not a hot key.
    With a ledger, what is unseen is found by digests alone; texts of other blobs are not moved when the unseen ones are at
    most BROADCAST_BLOBS, and are left out after the merge of copies when there are more."""
    blobs = pass_rows(docs, {"blob": F.sha2(text_of(), 256), "text": text_of()})
    todo = None
    if ledger is not None:
        todo = stage(unseen(blobs, ledger, rules), "secret-unseen")
        if todo.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
            todo = F.broadcast(todo)
            blobs = blobs.join(todo.select("blob"), "blob", "left_semi")
    texts = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    texts = texts.withColumn("todo", _pairs(rules)) if todo is None else texts.join(todo, "blob")
    wanted = [F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for r in rules]
    found = [F.when(w, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))
             for w, r in zip(wanted, rules)]
    rows = texts.select("blob", F.array_compact(F.array(*found)).alias("found"))
    return rows.select("blob", F.inline("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Append new rows to the ledger at ``path`` and return the whole ledger."""
    new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every path: columns of ``versions`` and hits, the spans by start, then kind in the rules' order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = (ledger.where((F.size("spans") > 0) & (F.col("version") == current[F.col("kind")])).distinct()
            .select("blob", "kind", order[F.col("kind")].alias("rank"), F.inline("spans")))
    lists = hits.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("hits"))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")
    return versions.join(lists, "blob", "left").withColumn("hits", F.coalesce("hits", none))


def span_text(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"], h["stop"])), ",")


def batches_of(docs: DataFrame) -> list[DataFrame]:
    """Older documents (ids up to the median, by an approximate quantile of the rows), then newer ones and those without id."""
    middle = docs.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    if middle is None:
        return [docs]
    older = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return [docs.where(older), docs.where(~older)]


def scan_documents(docs: DataFrame, ledger_path: str) -> DataFrame:
    """All documents through the ledger at ``ledger_path`` (created when it is not there).

    Older documents are scanned and entered first, then newer ones against what the ledger holds; a further run on the same
    path scans only what is new in it, and appends nothing for the rest. One row per row of ``docs``: doc_id, counts of the
    base kinds, digest of the base spans, all spans as text. Null texts are empty ones and have no spans; rows with equal
    text share one scan. A ledger row list per blob grows with the findings of that one blob only."""
    spark = docs.sparkSession
    ledger = read_ledger(spark, ledger_path)
    for batch in batches_of(docs):
        ledger = append(spark, scan(batch, ledger), ledger_path)
    base = [r.kind for r in BASE_RULES]
    rows = findings(versions_of(docs), ledger)
    own = F.filter("hits", lambda h: h["kind"].isin(base))
    counts = [F.size(F.array_remove(F.transform("hits", lambda h: h["kind"]), k)) for k in base]
    counts = [(F.size("hits") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, base)]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(span_text(own), 256).alias("base_sha256"), span_text(F.col("hits")).alias("spans"))
