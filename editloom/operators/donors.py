"""Repair donors: 127-base oligos with edits or inserts, insert checks and donor annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frame import let
from ..functions.seq import codon_to_aa, codons, diff_positions, put_base, put_insert, revcomp_clean, show_stop
from .genome import coding_window
from .guides import Reference

OLIGO = 127


def oligo_start(guide: Column, seq_len: Column) -> Column:
    """First base of the 127-base window around a cut, moved inwards at the sequence ends; null if the
    sequence is too short."""
    wanted = F.when(guide["strand"] == "+", guide["cut"] - 36).otherwise(guide["cut"] - 91)
    inside = F.greatest(F.lit(0).cast("bigint"), F.least(seq_len.cast("bigint") - OLIGO, wanted))
    return F.when(seq_len >= OLIGO, inside)


def _ordered(plus: Column, text: Column) -> Column:
    return F.when(plus, revcomp_clean(text)).otherwise(text)


def _strand_label(plus: Column) -> Column:
    return F.when(plus, "- strand target").otherwise("+ strand target")


def edit_oligo(ref: Reference, guide: Column, changes: Column, silent: Column, cds: Column, segs: Column) -> Column:
    """Oligo with the wanted base changes (array<struct<gp,wt,alt>>) and one optional silent edit."""
    plus = guide["strand"] == "+"

    def build(start):
        def with_texts(wt):
            edited = F.aggregate(changes, wt, lambda s, c: put_base(s, c["gp"] - start, c["alt"]))
            payload = F.when(silent.isNotNull(), put_base(edited, silent["gp"] - start, silent["base"])).otherwise(edited)

            def finish(sense):
                index = lambda gp: let((gp - start).cast("int"), lambda i: F.when(
                    (i >= 0) & (i < OLIGO), F.when(plus, F.lit(OLIGO - 1) - i).otherwise(i)))
                wanted = F.array_sort(F.array_compact(F.transform(changes, lambda c: index(c["gp"]))))
                quiet = F.array_compact(F.array(F.when(silent.isNotNull(), index(silent["gp"]))))
                site = (guide["ps"] - start).cast("int")
                pam = F.when(plus, site + 20).otherwise(site)
                coding = coding_window(segs, cds, start, start + OLIGO, sense)
                return F.struct(
                    _ordered(plus, sense).alias("donor"), _ordered(plus, wt).alias("wild_type"),
                    diff_positions(_ordered(plus, wt), _ordered(plus, sense)).alias("diffs"), wanted.alias("edit_at"),
                    quiet.alias("silent_at"), _strand_label(plus).alias("strand_label"),
                    coding["coding_wt"].alias("coding_wt"), coding["coding_donor"].alias("coding_donor"),
                    site.alias("site_start"), (site + 23).alias("site_end"), pam.alias("pam_start"),
                    (pam + 3).alias("pam_end"), start.alias("window_start"))
            return let(payload, finish)
        return let(ref.slice(start, OLIGO), with_texts)

    start = oligo_start(guide, ref.seq_len)
    return F.when(guide.isNotNull() & start.isNotNull(), let(start, build))


def insert_oligo(ref: Reference, guide: Column, insert_at: Column, insert: Column, silent: Column) -> Column:
    """Oligo with an insert before coordinate ``insert_at`` and one optional guide-blocking edit."""
    plus = guide["strand"] == "+"
    size = F.length(insert)
    total = size + OLIGO

    def build(start):
        at = (insert_at - start).cast("int")
        index = lambda gp: let((gp - start).cast("int") + F.when(gp >= insert_at, size).otherwise(0), lambda i: F.when(
            (i >= 0) & (i < total), F.when(plus, total - 1 - i).otherwise(i)))
        listed = lambda positions: F.array_compact(F.transform(positions, index))

        def with_wt(wt):
            raw = put_insert(wt, at, insert)
            quiet = (silent["gp"] - start).cast("int") + F.when(silent["gp"] >= insert_at, size).otherwise(0)
            sense = F.when(silent.isNotNull(), put_base(raw, quiet, silent["base"])).otherwise(raw)
            begin = F.when(plus, total - at - size).otherwise(at)
            first = guide["ps"]
            sites = F.when(plus, F.sequence(first, first + 19)).otherwise(F.sequence(first + 3, first + 22))
            pams = F.when(plus, F.sequence(first + 20, first + 22)).otherwise(F.sequence(first, first + 2))
            return F.struct(
                _ordered(plus, sense).alias("donor"), _ordered(plus, wt).alias("wild_type"),
                _strand_label(plus).alias("strand_label"), begin.alias("insert_start"), (begin + size).alias("insert_end"),
                F.array_compact(F.array(F.when(silent.isNotNull(), F.when(plus, total - 1 - quiet).otherwise(quiet))))
                .alias("silent_at"), listed(sites).alias("site_at"), listed(pams).alias("pam_at"),
                start.alias("window_start"))
        return F.when((at >= 0) & (at <= OLIGO), let(ref.slice(start, OLIGO), with_wt))

    start = oligo_start(guide, ref.seq_len)
    return F.when(guide.isNotNull() & start.isNotNull(), let(start, build))


def check_insert(expected: Column, actual: Column, terminal_stop: bool) -> Column:
    """Is the insert the wanted one and in frame: struct(matches_preset, frame_preserved, unexpected_stop,
    terminal_stop_present)."""
    def build(aas):
        n = F.size(aas)
        stops = F.exists(F.transform(aas, lambda a, i: (a == "*") & ~(F.lit(terminal_stop) & (i == n - 1))), lambda x: x)
        end_stop = F.lit(terminal_stop) & F.coalesce(F.get(aas, n - 1) == "*", F.lit(False))
        frame = (F.length(actual) > 0) & (F.length(actual) % 3 == 0) & ~stops & (F.lit(not terminal_stop) | end_stop)
        return F.struct((expected == actual).alias("matches_preset"), frame.alias("frame_preserved"),
                        stops.alias("unexpected_stop"), end_stop.alias("terminal_stop_present"))
    return let(F.transform(codons(actual), lambda c: codon_to_aa(c)), build)


def segment_checks(donors: DataFrame, segments: DataFrame, insert: str = "insert_seq") -> DataFrame:
    """Compare the reporter segments of designed inserts with their reference proteins.

    ``donors``: request_id, insert_name, terminus and the designed insert; ``segments``: the (fixed, small)
    segment dimension."""
    ref = segments.where(F.col("protein").isNotNull())
    df = donors.join(F.broadcast(ref), ["insert_name", "terminus"])
    part = F.substring(F.col(insert), F.col("seg_start") + 1, F.length("seg_seq"))
    aas = F.array_join(F.transform(codons(part), lambda c: show_stop(codon_to_aa(c))), "")
    return df.select("request_id", "seg_no", F.col("protein_label").alias("label"), aas.alias("actual"),
                     F.col("protein").alias("expected"), (aas == F.col("protein")).alias("matches"))


def apply_to_arm(arm: Column, arm_start: Column, edits: Column) -> Column:
    """Put base edits (array<struct<gp,base,...>>) that fall into a homology arm."""
    return F.aggregate(edits, arm, lambda s, e: put_base(s, e["gp"] - arm_start, e["base"]))


def index_ranges(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Contiguous runs of a set of indexes: keys, start, end (end exclusive)."""
    d = df.select(*keys, index).where(F.col(index) >= 0).distinct()
    w = Window.partitionBy(*keys).orderBy(index)
    return (d.withColumn("_g", F.col(index) - F.row_number().over(w)).groupBy(*keys, "_g")
            .agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("_g"))


def ranges_of(indexes: Column) -> Column:
    """The same inside one row: array<struct<start,end>> of the contiguous runs of an index array."""
    ordered = F.array_sort(F.array_distinct(indexes))
    starts = F.filter(ordered, lambda i: ~F.array_contains(ordered, i - 1))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (F.array_min(F.filter(
        ordered, lambda i: (i >= s) & ~F.array_contains(ordered, i + 1))) + 1).alias("end")))
