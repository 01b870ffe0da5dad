"""Primer specificity from alignment hits: per-primer locus counts, best hits, pair verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import locus_key, suffix_match

GENOME_ERROR = "Only hg38 remote specificity is currently enabled."


def length_error(sequence: Column, label: str) -> Column:
    """Reason why a cleaned primer cannot be checked (15-40 bases are needed), else null."""
    n = F.length(sequence)
    return F.when(n == 0, f"{label} primer sequence is required.").when((n < 15) | (n > 40), (
        f"{label} primer must be between 15 and 40 nt for the remote specificity check."))


def classify_hits(hsps: DataFrame) -> DataFrame:
    """Flags, locus key and class of every high-scoring pair (columns as in the alignment source)."""
    n, zero = F.col("query_len"), F.lit(0)
    col = lambda c: F.coalesce(F.col(c), zero)
    full = (col("query_from") == 1) & (col("query_to") == n) & (col("align_len") == n) & (col("gaps") == 0)
    df = hsps.withColumns({"suffix": suffix_match(F.col("qseq"), F.col("hseq")),
                           "locus": locus_key(F.col("accession"), F.col("hit_from"), F.col("hit_to"))})
    near = full & (col("identity") >= n - 1)
    risk = (col("query_to") == n) & (col("identity") >= n - 2) & (col("align_len") >= n - 2) & (F.col("suffix") >= F.least(F.lit(8), n))
    df = df.withColumns({"exact": full & (col("identity") == n), "near": near, "risk": risk})
    return df.withColumn("hit_class", F.when(F.col("exact"), "exact").when(F.col("near"), "near-perfect").when(
        F.col("risk"), "3prime-risk").otherwise("partial"))


def primer_status(exact: Column, risk: Column) -> Column:
    return F.when((exact <= 1) & (risk <= 2), "favorable").when((exact <= 3) & (risk <= 6), "moderate").otherwise("broad")


def summarize_primers(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Distinct loci by class, best 3' suffix, status and summary per primer.

    Loci are first made unique per primer and locus (partial aggregation before the shuffle), so a primer with
    very many hits is spread over tasks until only its loci are left."""
    loci = hits.groupBy(key, "locus").agg(
        F.max(F.col("exact").cast("int")).alias("e"), F.max(F.col("near").cast("int")).alias("n"), F.max(F.col("risk").cast("int")).alias("r"),
        F.max(F.when(F.col("exact") | F.col("near") | F.col("risk"), F.col("suffix"))).alias("s"))
    per = loci.groupBy(key).agg(F.sum("e").alias("exact_loci"), F.sum("n").alias("near_loci"), F.sum("r").alias("risk_loci"),
                                F.coalesce(F.max("s"), F.lit(0)).alias("best_suffix"))
    s = lambda c: F.col(c).cast("string")
    return per.withColumns({
        "status": primer_status(F.col("exact_loci"), F.col("risk_loci")),
        "summary": F.concat(s("exact_loci"), F.lit(" exact human loci | "), s("near_loci"), F.lit(" near-perfect loci | "), s("risk_loci"), F.lit(" 3' risk loci"))})


def top_hits(hits: DataFrame, key: str = "query_id", keep: int = 5, fix_priority: bool = False, order: str = "hsp_id") -> DataFrame:
    """Best hits per primer, one per locus. By default exact hits rank last, as the established ranking does
    (its priority 0 is read as missing); ``fix_priority`` puts them first."""
    rank = F.when(F.col("hit_class") == "near-perfect", 1).when(F.col("hit_class") == "3prime-risk", 2).otherwise(0 if fix_priority else 9)
    df = hits.where("exact or near or risk").withColumn("_p", rank)
    keys = [F.col("_p"), F.col("identity").desc(), F.col("suffix").desc(), F.coalesce("accession", F.lit("")), F.col(order)]
    one = Window.partitionBy(key, "locus").orderBy(*keys)
    df = df.withColumn("_l", F.row_number().over(one)).where("_l = 1")
    return df.withColumn("hit_rank", F.row_number().over(Window.partitionBy(key).orderBy(*keys))).where(F.col("hit_rank") <= keep).drop("_l", "_p")


def pair_verdict(forward: Column, reverse: Column) -> Column:
    """struct(status, label, note) from two primer statuses."""
    def verdict(status, label, note):
        return F.struct(F.lit(status).alias("status"), F.lit(label).alias("label"), F.lit(note).alias("note"))
    either = lambda word: (forward == word) | (reverse == word)
    return (F.when(either("broad"), verdict("review", "Broad / repeated pair", (
                "One or both primers show repeated human matches and should be reviewed before ordering.")))
            .when(either("moderate"), verdict("caution", "Usable with review", (
                "At least one primer shows multiple human matches; keep backup pairs available.")))
            .otherwise(verdict("acceptable", "Approximate unique pair", "Both primers look limited on the remote human BLAST screen.")))


def pair_specificity(pairs: DataFrame, summaries: DataFrame, key: str = "query_id") -> DataFrame:
    """pairs(pair_id, fw_id, rev_id, fw_seq, rev_seq, genome) -> verdict rows; primers without hits count as
    having none; a wrong genome or primer length gives an error row."""
    part = lambda p: summaries.select(F.col(key).alias(p + "_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("exact_loci", "risk_loci", "status")])
    df = pairs.join(part("fw"), "fw_id", "left").join(part("rev"), "rev_id", "left")
    status = lambda p: F.coalesce(F.col(p + "_status"), F.lit("favorable"))
    err = F.coalesce(F.when(F.lower(F.coalesce("genome", F.lit("hg38"))) != "hg38", GENOME_ERROR),
                     length_error(F.col("fw_seq"), "Forward"), length_error(F.col("rev_seq"), "Reverse"))
    df = df.withColumns({"err": err, "v": pair_verdict(status("fw"), status("rev"))})
    good = F.col("err").isNull()
    return df.select("pair_id", "err", *[F.when(good, F.col("v." + c)).alias(c) for c in ("status", "label", "note")])
