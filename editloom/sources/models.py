"""Gene models: one row per reference sequence with its coding segments and exons nested.

``model`` columns: seq_id, gene, transcript_id, assembly, source, seq, seq_len,
segs array<struct<start,end,cum>> (coordinate order, ``cum`` = coding bases before the segment),
exons array<struct<start,end,exon_number,label>>, cds, protein_length.
Coordinates are 0-based, half-open. The nested arrays belong to one transcript record, so their
size is that of an annotation, not of the data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import truthy
from ..functions.seq import clean_dna

MODEL_COLUMNS = ["seq_id", "gene", "transcript_id", "assembly", "source", "seq", "seq_len", "segs", "exons", "cds",
                 "protein_length"]


def clean_intervals(intervals: Column) -> Column:
    """Keep intervals with end > start, in start order."""
    return F.array_sort(F.filter(intervals, lambda s: s["start"].isNotNull() & (s["end"] > s["start"])))


def with_running_offset(intervals: Column) -> Column:
    """Give every segment the number of coding bases before it."""
    return F.transform(intervals, lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.aggregate(F.slice(intervals, F.lit(1), i), F.lit(0).cast("bigint"),
                    lambda acc, x: acc + x["end"] - x["start"]).alias("cum")))


def assemble_cds(seq: Column, segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: F.substring(
        seq, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))), "")


def finish_model(df: DataFrame) -> DataFrame:
    """Derive lengths and the coding sequence from seq, segs (start, end) and exons; drop empty models."""
    df = df.withColumn("segs", with_running_offset(clean_intervals(F.col("segs"))))
    df = df.withColumns({"seq": F.upper("seq"), "exons": clean_intervals(F.col("exons"))})
    df = df.where(truthy(F.col("seq")) & (F.size("segs") > 0))
    df = df.withColumns({"cds": assemble_cds(F.col("seq"), F.col("segs")), "seq_len": F.length("seq")})
    return df.withColumn("protein_length", (F.floor(F.length("cds") / 3) - 1).cast("int")).select(*MODEL_COLUMNS)


def build_models(sequences: DataFrame, segments: DataFrame, exons: DataFrame, parts: int | None = None) -> DataFrame:
    """Child tables cds_segments(seq_id, seg_start, seg_end) and exons(seq_id, exon_number, exon_start,
    exon_end, label) folded into their sequences.

    The child tables are dealt out by sequence to ``parts`` partitions, by default as many as a shuffle has. The number keeps
    the few bytes of a model from being gathered by size into one task, which would then make all designs."""
    parts = parts or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments, exons = segments.repartition(parts, "seq_id"), exons.repartition(parts, "seq_id")
    segs = segments.groupBy("seq_id").agg(F.collect_list(F.struct(
        F.col("seg_start").cast("bigint").alias("start"), F.col("seg_end").cast("bigint").alias("end"))).alias("segs"))
    label = F.col("label") if "label" in exons.columns else F.concat(F.lit("Exon "), F.col("exon_number").cast("string"))
    exs = exons.groupBy("seq_id").agg(F.collect_list(F.struct(
        F.col("exon_start").cast("bigint").alias("start"), F.col("exon_end").cast("bigint").alias("end"),
        F.col("exon_number").cast("int").alias("exon_number"), label.alias("label"))).alias("exons"))
    df = sequences.join(segs, "seq_id").join(exs, "seq_id", "left")
    for name, default in (("transcript_id", ""), ("assembly", ""), ("source", "genbank")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return finish_model(df)


def raw_models(raw: DataFrame) -> DataFrame:
    """Pasted DNA with 1-based CDS start and end (and an optional exon list) -> models."""
    seq = clean_dna(F.col("raw_sequence"))
    df = raw.withColumn("seq", seq)
    start = F.greatest(F.lit(0), F.floor(F.col("cds_start").cast("double")) - 1).cast("bigint")
    end = F.least(F.length("seq"), F.floor(F.col("cds_end").cast("double"))).cast("bigint")
    df = df.withColumns({"_s": start, "_e": end}).where(
        (F.col("seq") != "") & F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_e") > F.col("_s")))
    listed = F.transform(tx.exon_list(F.col("exon_coordinates")), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["exon_number"].alias("exon_number"), x["label"].alias("label")))
    single = F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"), F.lit(1).alias("exon_number"),
                              F.lit("Exon 1").alias("label")))
    df = df.withColumns({
        "segs": F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"))),
        "exons": F.when(F.size(listed) > 0, listed).otherwise(single), "source": F.lit("raw-sequence")})
    for name in ("transcript_id", "assembly"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    return finish_model(df)


PAYLOAD_SCHEMA = (
    "gene string, geneSymbol string, displayName string, symbol string, transcriptId string, id string, "
    "stableId string, accession string, proteinLength int, genomicSequence string, sequence string, "
    "cdsSegments array<array<bigint>>, cds array<struct<start:bigint,end:bigint>>, "
    "exons array<struct<start:bigint,end:bigint,exonNumber:int,label:string>>, strand int, assembly string, "
    "assemblyName string")


def payload_models(payloads: DataFrame, provider: str) -> DataFrame:
    """Transcript payloads of a provider ('ensembl' or 'ncbi'), alternate key names folded together."""
    any_of = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    names = {"ensembl": (("gene", "geneSymbol", "displayName"), ("transcriptId", "id", "stableId")),
             "ncbi": (("gene", "geneSymbol", "symbol"), ("transcriptId", "accession", "id"))}[provider]
    pairs = F.transform(F.col("cdsSegments"), lambda p: F.struct(
        F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")))
    exons = F.transform(F.coalesce(F.col("exons"), F.array()), lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"),
        F.coalesce(F.nullif(x["exonNumber"], F.lit(0)), i + 1).alias("exon_number"),
        F.coalesce(F.nullif(x["label"], F.lit("")), F.concat(F.lit("Exon "), F.coalesce(
            F.nullif(x["exonNumber"], F.lit(0)), i + 1).cast("string"))).alias("label")))
    df = payloads.select(
        *[c for c in payloads.columns if c == "seq_id"],
        F.coalesce(any_of(*names[0]), F.lit("Gene")).alias("gene"),
        F.coalesce(any_of(*names[1]), F.lit("")).alias("transcript_id"),
        F.coalesce(any_of("assembly", "assemblyName"), F.lit("")).alias("assembly"), F.lit(provider).alias("source"),
        any_of("genomicSequence", "sequence").alias("seq"), F.coalesce(pairs, F.col("cds")).alias("segs"),
        exons.alias("exons"), F.col("proteinLength").alias("_given"))
    if "seq_id" not in df.columns:
        df = df.withColumn("seq_id", F.col("transcript_id"))
    given = df.select("seq_id", "_given")
    out = finish_model(df.drop("_given").withColumn("source", F.lit(provider)))
    return out.join(given, "seq_id", "left").withColumn(
        "protein_length", F.coalesce("_given", "protein_length")).drop("_given")
