"""Coordinate operators: coding positions, codons, guide sites and their genomic context.

Functions that take ``segs``/``exons``/``cds`` columns work inside one model row (no shuffle); operators
over whole sequences first cut them into overlapping chunks, so a very long sequence is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frame import broadcast_if_small, let
from ..functions.seq import codon_to_aa
from ..functions.sites import find_sites

SITE = 23  # 20-base spacer plus 3-base PAM
#: Bases that a tile of a long sequence owns, and those it holds after them.
TILE, HALO = 65536, 1024


# --- coding coordinates --------------------------------------------------------------------------

def coding_to_genomic(segs: Column, cp: Column) -> Column:
    return let(F.get(F.filter(segs, lambda s: s["cum"] + s["end"] - s["start"] > cp), F.lit(0)),
               lambda s: s["start"] + cp - s["cum"])


def genomic_to_coding(segs: Column, gp: Column) -> Column:
    return let(F.get(F.filter(segs, lambda s: (s["start"] <= gp) & (gp < s["end"])), F.lit(0)),
               lambda s: s["cum"] + gp - s["start"])


def genomic_to_residue(segs: Column, gp: Column) -> Column:
    return (F.floor(genomic_to_coding(segs, gp) / 3) + 1).cast("int")


def codon_at(cds: Column, residue: Column) -> Column:
    """Three bases of a 1-based residue; null outside the coding sequence."""
    start = (residue - 1) * 3
    return F.when((start >= 0) & (start + 3 <= F.length(cds)), F.substring(cds, start.cast("int") + 1, F.lit(3)))


def residue_at(cds: Column, residue: Column) -> Column:
    codon = codon_at(cds, residue)
    return F.when(codon.isNotNull(), codon_to_aa(codon))


def coding_positions(models: DataFrame) -> DataFrame:
    """One row per coding base: seq_id, cp, gp, base, residue, frame. Restrict ``models`` to the sequences
    that are asked for before calling this."""
    seg = models.select("seq_id", "cds", F.explode("segs").alias("s"))
    pos = seg.select("seq_id", "cds", "s", F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias("gp"))
    cp = F.col("s.cum") + F.col("gp") - F.col("s.start")
    return pos.select("seq_id", cp.alias("cp"), "gp", F.substring("cds", cp.cast("int") + 1, F.lit(1)).alias("base"),
                      (F.floor(cp / 3) + 1).cast("int").alias("residue"), (cp % 3).cast("int").alias("frame"))


def exon_for_segment(exons: Column, start: Column, end: Column) -> Column:
    """Exon that contains the segment, else the first one that overlaps it."""
    inside = F.filter(exons, lambda x: (x["start"] <= start) & (x["end"] >= end))
    touching = F.filter(exons, lambda x: (x["end"] > start) & (x["start"] < end))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(touching, F.lit(0)))


def regions_of(exons: Column, segs: Column) -> Column:
    """Exons as array<struct<start,end,exon_number>>; coding segments stand in when there are none."""
    own = F.transform(exons, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                x["exon_number"].alias("exon_number")))
    fallback = F.transform(segs, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                       (i + 1).alias("exon_number")))
    return F.when(F.size(exons) > 0, own).otherwise(fallback)


def _text(label: Column, detail: Column) -> Column:
    return F.struct(label.alias("label"), detail.alias("detail"))


def cut_context(regions: Column, cut: Column) -> Column:
    """Where a cut lies: struct(label, detail)."""
    s = lambda c: c.cast("string")
    n = F.size(regions)
    hit = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda i: let(
        F.get(regions, i), lambda r: (cut >= r["start"]) & (
            (cut < r["end"]) | ((i < n - 1) & (cut >= r["end"]) & (cut < F.get(regions, i + 1)["start"]))))), F.lit(0))
    first, last = F.get(regions, F.lit(0)), F.get(regions, n - 1)

    def describe(i):
        r, nxt = F.get(regions, i), F.get(regions, i + 1)
        after, before = cut - r["end"], nxt["start"] - cut
        inside = _text(F.concat(F.lit("exon "), s(r["exon_number"])),
                       F.concat(s(cut - r["start"]), F.lit(" bp into exon "), s(r["exon_number"])))
        between = _text(
            F.concat(F.lit("intron between exon "), s(r["exon_number"]), F.lit(" and exon "), s(nxt["exon_number"])),
            F.when(after <= before, F.concat(s(after), F.lit(" bp downstream of exon "), s(r["exon_number"])))
            .otherwise(F.concat(s(before), F.lit(" bp upstream of exon "), s(nxt["exon_number"]))))
        return F.when(cut < r["end"], inside).otherwise(between)

    upstream = _text(F.lit("upstream of CDS"), F.concat(
        s(first["start"] - cut), F.lit(" bp upstream of exon "), s(first["exon_number"])))
    downstream = _text(F.lit("downstream of CDS"), F.concat(
        s(cut - last["end"]), F.lit(" bp downstream of exon "), s(last["exon_number"])))
    return F.when(hit.isNotNull(), let(hit, describe)).when(cut < first["start"], upstream).otherwise(downstream)


def guide_placement(regions: Column, ps: Column) -> Column:
    """How the 23-base site lies relative to the exons: struct(label, detail)."""
    s = lambda c: c.cast("string")
    end = ps + SITE
    n = F.size(regions)
    over = F.filter(regions, lambda r: (ps < r["end"]) & (end > r["start"]))
    one, last_over = F.get(over, F.lit(0)), F.get(over, F.size(over) - 1)
    first, last = F.get(regions, F.lit(0)), F.get(regions, n - 1)
    gap = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)), lambda i: (i < n - 1) & (
        ps >= F.get(regions, i)["end"]) & (end <= F.get(regions, i + 1)["start"])), F.lit(0))
    inside = (ps >= one["start"]) & (end <= one["end"])
    return (
        F.when((n == 0) | ps.isNull(), _text(
            F.lit("context unavailable"), F.lit("Guide placement could not be resolved on the reference.")))
        .when((F.size(over) == 1) & inside, _text(
            F.concat(F.lit("exonic (exon "), s(one["exon_number"]), F.lit(")")),
            F.concat(F.lit("Guide spans 23 bp within exon "), s(one["exon_number"]), F.lit("."))))
        .when(F.size(over) == 1, _text(
            F.concat(F.lit("crosses exon "), s(one["exon_number"]), F.lit(" boundary")),
            F.concat(F.lit("Guide overlaps exon "), s(one["exon_number"]), F.lit(" and adjacent noncoding sequence."))))
        .when(F.size(over) > 1, _text(
            F.lit("crosses exon boundary"),
            F.concat(F.lit("Guide spans exon "), s(one["exon_number"]), F.lit(" to exon "), s(last_over["exon_number"]),
                     F.lit("."))))
        .when(end <= first["start"], _text(
            F.lit("upstream of CDS"), F.concat(F.lit("Guide lies upstream of exon "), s(first["exon_number"]), F.lit("."))))
        .when(gap.isNotNull(), _text(
            F.lit("intronic"), F.concat(F.lit("Guide lies in the intron between exon "),
                                        s(F.get(regions, gap)["exon_number"]), F.lit(" and exon "),
                                        s(F.get(regions, gap + 1)["exon_number"]), F.lit("."))))
        .when(ps >= last["end"], _text(
            F.lit("downstream of CDS"),
            F.concat(F.lit("Guide lies downstream of exon "), s(last["exon_number"]), F.lit("."))))
        .otherwise(_text(F.lit("context unavailable"),
                         F.lit("Guide placement could not be resolved on the reference."))))


def coding_window(segs: Column, cds: Column, start: Column, end: Column, payload: Column) -> Column:
    """Coding part of a donor window in frame: struct(coding_wt, coding_donor)."""
    parts = F.filter(F.transform(segs, lambda s: F.struct(
        F.greatest(start, s["start"]).alias("a"), F.least(end, s["end"]).alias("b"),
        (s["cum"] + F.greatest(start, s["start"]) - s["start"]).alias("ci"))), lambda p: p["b"] > p["a"])
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["b"] - p["a"])
    donor = F.array_join(F.transform(parts, lambda p: F.substring(
        payload, (p["a"] - start).cast("int") + 1, (p["b"] - p["a"]).cast("int"))), "")
    ci = F.get(parts, F.lit(0))["ci"]
    trim = (F.lit(3) - ci % 3) % 3
    usable = F.greatest(F.lit(0), (F.floor((total - trim) / 3) * 3)).cast("int")
    return F.when(F.size(parts) == 0, F.struct(F.lit("").alias("coding_wt"), F.lit("").alias("coding_donor"))).otherwise(
        F.struct(F.substring(cds, (ci + trim).cast("int") + 1, usable).alias("coding_wt"),
                 F.substring(donor, trim.cast("int") + 1, usable).alias("coding_donor")))


# --- guide sites ---------------------------------------------------------------------------------

def _cut(frame: DataFrame, width: int, overlap: int, keep: list[str]) -> DataFrame:
    """``bases`` in pieces of ``width`` with the ``overlap`` bases after each, in one pass over the text."""
    pieces = F.regexp_extract_all(F.col("bases"), F.lit("(?s).{1,%d}" % width), F.lit(0))
    joined = F.transform(F.col("_p"), lambda x, i: F.concat(x, F.left(F.coalesce(F.get(F.col("_p"), i + 1), F.lit("")), F.lit(overlap))))
    return (frame.withColumn("_p", pieces).select(*keep, "bases_start", F.posexplode(joined).alias("_i", "bases"))
            .select(*keep, (F.col("bases_start") + F.col("_i").cast("bigint") * width).alias("bases_start"), "bases"))


def _small(blocks: DataFrame, overlap: int, size: int) -> DataFrame:
    """Blocks that own the bases up to ``_own`` -> chunks of ``size`` with the number of bases each owns."""
    keep = [c for c in blocks.columns if c not in ("bases", "bases_start")]
    # The overlap of a block is seen again by its last chunks; they own less or nothing.
    owned = F.least(F.lit(size).cast("bigint"), F.col("_own") - F.col("bases_start"))
    return _cut(blocks, size, overlap, keep).withColumn("owned", owned).drop("_own")


def chunked(df: DataFrame, overlap: int = SITE - 1, size: int = 256, block: int = TILE) -> DataFrame:
    """Replace ``bases``/``bases_start`` (one long text per row) by overlapping chunks of ``size`` owned bases.

    Both cuts read the text once (fixed-size regex pieces), first into blocks, then into small chunks, so neither the row size
    nor the cost of a substring grows with the sequence. A site belongs to the chunk that owns its first base; the overlap holds
    the rest of it."""
    keep = [c for c in df.columns if c not in ("bases", "bases_start")]
    blocks = _cut(df, block, overlap, keep)
    return _small(blocks.withColumn("_own", F.col("bases_start") + block), overlap, size)


def scan_sites(df: DataFrame, any_pam: bool = False, drop_runs: bool = True) -> DataFrame:
    """All SpCas9 sites of ``bases`` (starting at ``bases_start``) on both strands.

    Adds spacer, pam, strand, cut, gc, ps. ``any_pam`` accepts any letter before GG, ``drop_runs`` leaves
    out spacers with five A or five T in a row.
    """
    keep = [c for c in df.columns if c not in ("bases", "bases_start")]
    blocks = _cut(df, TILE, SITE - 1, keep)
    return _sites_of(blocks.withColumn("_own", F.col("bases_start") + TILE), any_pam, drop_runs)


def _sites_of(blocks: DataFrame, any_pam: bool, drop_runs: bool) -> DataFrame:
    """The sites that start before ``_own``, found in one Arrow pass (see ``functions.sites``)."""
    keep = [c for c in blocks.columns if c not in ("bases", "bases_start", "_own")]
    schema = StructType([*[blocks.schema[c] for c in keep], *StructType.fromDDL("spacer string, pam string, strand string, cut bigint, ps bigint, gc int").fields])
    return blocks.mapInArrow(find_sites(keep, any_pam, drop_runs, TILE), schema)


def tile_table(sequences: DataFrame, halo: int = HALO, spread: bool | None = None) -> DataFrame:
    """Sequences (seq_id, seq, and seq_len where there is one) as tiles: seq_id, tile, start, bases, seq_len. A tile owns TILE
    bases and holds ``halo`` more.

    With ``spread``, the tiles of sequences longer than one tile are dealt out by their number, so all cores share one
    chromosome; shorter sequences stay where they are. That takes two looks at the table, so by default it is done where
    seq_len is a column, which a stored table answers from its statistics."""
    have = "seq_len" in sequences.columns
    size = F.col("seq_len") if have else F.length("seq")
    rows = sequences.select("seq_id", F.col("seq").alias("bases"), size.cast("bigint").alias("seq_len"), F.lit(0).cast("bigint").alias("bases_start"))

    def cut(frame):
        return _cut(frame, TILE, halo, ["seq_id", "seq_len"]).select(
            "seq_id", F.expr(f"bases_start div {TILE}").alias("tile"), F.col("bases_start").alias("start"), "bases", "seq_len")

    if not (have if spread is None else spread):
        return cut(rows)
    # The number keeps the small tiles from being gathered again by size: each becomes thousands of sites.
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.where(F.col("seq_len") <= TILE)).unionByName(cut(rows.where(F.col("seq_len") > TILE)).repartition(parts, "seq_id", "tile"))


def write_tiles(sequences: DataFrame, path: str, halo: int = HALO) -> None:
    """Store the tile table in order of sequence and tile, so that a reader of a few stretches skips the other row groups."""
    tile_table(sequences, halo, spread=False).repartitionByRange("seq_id", "tile").sortWithinPartitions("seq_id", "tile").write.option(
        "parquet.block.size", 8 << 20).parquet(path)


def scan_tiles(tiles: DataFrame, any_pam: bool = False, drop_runs: bool = True) -> DataFrame:
    """Guide sites of a tile table, each found by the tile that owns its first base."""
    blocks = tiles.select("seq_id", F.left("bases", F.lit(TILE + SITE - 1)).alias("bases"), F.col("start").alias("bases_start"), (F.col("start") + TILE).alias("_own"))
    return _sites_of(blocks, any_pam, drop_runs)


def tile_windows(tiles: DataFrame, targets: DataFrame, reach: int, halo: int = HALO) -> DataFrame:
    """Targets (seq_id, target, ...) with the bases within ``reach`` attached as bases/bases_start/seq_len. A window begins in one
    tile and ends in its halo, so it takes one equality join of tiles that hold at most TILE and a few bases; no row holds a
    whole sequence. A target beyond its sequence has an empty window."""
    if 2 * reach > halo:
        raise ValueError("the window is wider than the halo of a tile")
    low = F.greatest(F.lit(0).cast("bigint"), F.col("target") - reach)
    wanted = targets.withColumns({"_low": low, "tile": F.expr(f"greatest(0L, target - {reach}) div {TILE}")})
    joined = wanted.join(tiles, ["seq_id", "tile"])
    high = F.least("seq_len", F.col("target") + reach)
    size = F.greatest(F.lit(0).cast("bigint"), high - F.col("_low"))
    return joined.select(*targets.columns, F.substring("bases", (F.col("_low") - F.col("start")).cast("int") + 1, size.cast("int")).alias("bases"),
                         F.col("_low").alias("bases_start"), "seq_len")


def scan_sequences(sequences: DataFrame, **options) -> DataFrame:
    """Guide sites of whole sequences (seq_id, seq; give seq_len too where some are very long)."""
    return scan_tiles(tile_table(sequences, SITE - 1), **options)


def match_spacers(sequences: DataFrame, spacers: DataFrame) -> DataFrame:
    """Exact spacer hits. ``spacers``: seq_id, spacer and any other columns, optionally pam (then the PAM
    must be equal). Only sequences that are asked for are scanned, and only PAM-adjacent 20-mers are joined, on
    (seq_id, spacer): no scan per spacer."""
    wanted = spacers.where(F.length("spacer") == 20)
    asked = sequences.join(broadcast_if_small(wanted.select("seq_id").distinct()), "seq_id", "left_semi")
    sites = scan_sequences(asked, any_pam=True, drop_runs=False)
    return sites.join(wanted, ["seq_id", "spacer", "pam"] if "pam" in spacers.columns else ["seq_id", "spacer"])
