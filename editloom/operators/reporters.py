"""Fluorescent reporter catalogue: field folding, first-per-name, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm

# Alternate source keys of each reporter field, first filled one wins.
REPORTER_KEYS = {
    "id": ["id", "uuid"], "name": ["name", "label", "protein"], "slug": ["slug"],
    "aa_sequence": ["seq", "sequence", "aa_seq"], "genbank": ["genbank", "genbank_accession"], "uniprot": ["uniprot"],
    "link": ["url", "absolute_url", "link"], "ex_max": ["ex_max", "default_state__ex_max"],
    "em_max": ["em_max", "default_state__em_max"], "brightness": ["brightness", "default_state__brightness"],
    "qy": ["qy", "default_state__qy"], "ext_coeff": ["ext_coeff", "default_state__ext_coeff"],
    "pka": ["pka", "default_state__pka"], "agg": ["agg"], "status": ["status"],
    "organism": ["parent_organism", "organism"],
}


def map_reporters(records: DataFrame) -> DataFrame:
    """Fold alternate keys into one set of text columns; position columns are kept."""
    have = set(records.columns)
    pick = lambda keys: norm.first_filled(*[F.col(k).cast("string") for k in keys if k in have]) if have & set(keys) else F.lit("")
    used = {k for keys in REPORTER_KEYS.values() for k in keys}
    out = records.select(*[c for c in records.columns if c not in used], *[
        pick(keys).alias(name) for name, keys in REPORTER_KEYS.items()])
    return out.withColumns({"aa_sequence": F.upper("aa_sequence"), "aa_length": F.length("aa_sequence"),
                            "link": norm.absolute_url(F.col("link"))})


def dedupe_reporters(reporters: DataFrame) -> DataFrame:
    """First reporter, in page order, of every name (case and outer blanks ignored)."""
    key = F.lower(F.trim("name"))
    w = Window.partitionBy(key).orderBy("page", "pos")
    return reporters.where(key != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def limit_reporters(reporters: DataFrame, limit: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Distinct reporters; with limits, the first ``limit`` of the first ``max_pages`` pages (a top-k, not a sort of all)."""
    pages = reporters if max_pages is None else reporters.where(F.col("page") < max_pages)
    out = dedupe_reporters(pages)
    return out if limit is None else out.orderBy("page", "pos").limit(limit)
