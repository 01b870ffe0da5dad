"""Sequence and oligo functions: column in, column out, no shuffle and no Python per row.

Counting-based formulas (letters and dinucleotides are counted by string replacement) keep
GC, melting temperature and 3'-end stability inside generated code; the complementary-run
searches are Arrow passes of ``functions.oligo``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CODON_TO_AA, GUIDE_GC_HIGH, GUIDE_GC_LOW, NN_PARAMS
from .frame import let
from .numeric import half_up

BASES = "ACGT"


def revcomp(seq: Column) -> Column:
    """Reverse complement; any letter other than A, C, G, T becomes N."""
    return F.regexp_replace(F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA"), "[^ACGTN]", "N")


def revcomp_clean(seq: Column) -> Column:
    """Reverse complement of a sequence known to hold A, C, G, T, N only."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def clean_dna(text: Column, keep_n: bool = False) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^ACGTN]" if keep_n else "[^ACGT]", "")


def slice_at(seq: Column, start: Column, length) -> Column:
    """Bases [start, start+length) with a 0-based start >= 0."""
    return F.substring(seq, start.cast("int") + F.lit(1), length if isinstance(length, Column) else F.lit(length))


def gc_count(seq: Column) -> Column:
    seq = F.upper(seq)
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def gc_flag(gc: Column) -> Column:
    """low or high for an atypical guide GC percent, else null; so is a GC that is not known."""
    return F.when(gc < GUIDE_GC_LOW, "low").when(gc > GUIDE_GC_HIGH, "high")


def gc_percent(seq: Column) -> Column:
    """GC percent with one decimal; 0 for an empty sequence."""
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(
        F.floor(gc_count(seq) / F.length(seq) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))


def gc_percent_int(seq: Column) -> Column:
    return F.when(F.length(seq) == 0, F.lit(0).cast("bigint")).otherwise(
        half_up(gc_count(seq) / F.length(seq) * F.lit(100.0)))


def _pair_count(seq: Column, pair: str) -> Column:
    """How often the dinucleotide occurs, overlaps included."""
    if pair[0] != pair[1]:
        return (F.length(seq) - F.length(F.replace(seq, F.lit(pair), F.lit("")))) / F.lit(2)
    letter = pair[0]
    # 'A' -> 'aA' turns every adjacent 'AA' into exactly one 'Aa', which cannot overlap itself.
    marked = F.replace(seq, F.lit(letter), F.lit(letter.lower() + letter))
    joint = letter + letter.lower()
    return (F.length(marked) - F.length(F.replace(marked, F.lit(joint), F.lit("")))) / F.lit(2)


def stacking_sums(seq: Column) -> tuple[Column, Column]:
    """Sums of dH and of ten times dS over all neighbouring base pairs (exact whole numbers)."""
    seq = F.upper(seq)
    dh, ds10 = F.lit(0), F.lit(0)
    for pair, (h, s) in NN_PARAMS.items():
        count = _pair_count(seq, pair)
        dh = dh + count * F.lit(h)
        ds10 = ds10 + count * F.lit(round(10 * s))
    return dh, ds10


def melting_temperature(seq: Column, conc: float = 250e-9, mg: float = 1.5e-3, mono: float = 0.05) -> Column:
    """Nearest-neighbour melting temperature with the salt correction chosen by sqrt(mg)/mono."""
    dh, ds10 = stacking_sums(seq)
    dh = F.lit(200.0) + dh
    ds = (F.lit(-57.0) + ds10) / F.lit(10.0)
    base = dh / (ds + F.lit(1.987 * math.log(conc / 4))) - F.lit(273.15)
    gc = gc_count(seq) / F.length(seq)
    inverse = F.lit(1.0) / (base + F.lit(273.15))
    ratio = math.sqrt(mg) / mono
    ln_mg, ln_mono = math.log(mg), math.log(mono)
    if ratio < 0.22:
        corrected = inverse + (F.lit(4.29) * gc - F.lit(3.95)) * F.lit(1e-5 * ln_mono) + F.lit(9.4e-6 * ln_mono**2)
    elif ratio < 6.0:
        end_term = -4.82e-4 + 5.25e-4 * ln_mg + 8.31e-5 * ln_mg**2
        corrected = (inverse + F.lit(3.92e-5) - F.lit(9.11e-6 * ln_mg)
                     + gc * F.lit(6.26e-5 + 1.42e-5 * ln_mg)
                     + (F.lit(1.0) / (F.lit(2.0) * F.greatest(F.lit(1), F.length(seq) - 1))) * F.lit(end_term))
    else:
        corrected = inverse * F.lit(0.843 - 0.352 * ln_mg)
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(
        half_up(F.lit(1.0) / corrected - F.lit(273.15), 1))


def three_prime_dg(seq: Column, window: int = 5) -> Column:
    """Free energy (kcal/mol, 37 degrees) of the last bases."""
    dh, ds10 = stacking_sums(F.right(seq, F.lit(window)))
    return half_up((dh - F.lit(310.15) * (ds10 / F.lit(10.0))) / F.lit(1000.0), 2)


def has_homopolymer(seq: Column, run: int = 4) -> Column:
    seq = F.upper(seq)
    out = F.contains(seq, F.lit("A" * run))
    for base in "CGT":
        out = out | F.contains(seq, F.lit(base * run))
    return out


def clamp_count(seq: Column) -> Column:
    return gc_count(F.right(seq, F.lit(3)))


def three_prime_gc(seq: Column, window: int = 5) -> Column:
    return gc_count(F.right(seq, F.lit(window)))


def low_complexity(seq: Column) -> Column:
    seq = F.upper(seq)
    distinct = sum((F.contains(seq, F.lit(b)).cast("int") for b in "CGT"), F.contains(seq, F.lit("A")).cast("int"))
    other = F.size(F.array_distinct(F.split(F.regexp_replace(seq, "[ACGT]", ""), ""))) - F.when(
        F.regexp_replace(seq, "[ACGT]", "") == "", F.lit(1)).otherwise(F.lit(0))
    return ((F.length(seq) == 0)
            | seq.rlike("^(AT)+$|^(TA)+$|^(GC)+$|^(CG)+$")
            | ((distinct + other <= 2) & (F.length(seq) >= 20))
            | seq.rlike("(..)\\1{3,}"))


def complement_run(left: Column, right: Column) -> Column:
    """Longest stretch of ``left`` that can pair with a stretch of ``right`` (one Arrow pass, see ``functions.oligo``)."""
    from .oligo import pairing_run

    return pairing_run(left, right)


def three_prime_complement_run(left: Column, right: Column, window: int = 8) -> Column:
    from .oligo import end_pairing_run, pairing_run

    if window == 8:
        return end_pairing_run(left, right)
    return pairing_run(F.right(left, F.lit(window)), F.right(right, F.lit(window)))


def hairpin_run(seq: Column, min_loop: int = 3) -> Column:
    """Longest stem inside one oligo whose arms are more than ``min_loop`` bases apart."""
    from .oligo import stem_run

    return stem_run(min_loop)(seq)


def primer_penalty(gc: Column, tm: Column, run4: Column, low: Column, dg3: Column, self_run: Column,
                   self_three: Column, hairpin: Column) -> Column:
    total = (F.abs(gc - 50) / 4 + F.abs(tm - 60) / 3
             + F.when(run4, 8.0).otherwise(0.0) + F.when(low, 10.0).otherwise(0.0)
             + F.when(dg3 > -1.0, 6.0).when(dg3 < -10.0, 4.0).otherwise(0.0)
             + F.greatest(F.lit(0), self_run - 3) * 2.5
             + F.greatest(F.lit(0), self_three - 2) * 5
             + F.greatest(F.lit(0), hairpin - 3) * 3)
    return half_up(total, 1)


def primer_status(penalty: Column) -> Column:
    return F.when(penalty <= 6, "high").when(penalty <= 14, "medium").otherwise("review")


def primer_warnings(run4, low, self_three, self_run, hairpin, dg3) -> Column:
    rules = [
        (run4, "homopolymer run"), (low, "low complexity"), (self_three >= 4, "3' self-dimer risk"),
        (self_run >= 6, "self-dimer risk"), (hairpin >= 5, "hairpin risk"), (dg3 > -1.0, "weak 3' clamp"),
        (dg3 < -10.0, "over-stable 3' end"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))


ASSESSMENT_COLUMNS = ["gc", "tm", "dg3", "clamp", "len", "self_run", "self_three", "hairpin", "run4", "low",
                      "penalty", "status", "warnings"]


def with_assessment(df, seq: str, prefix: str = ""):
    """Add all oligo quality columns of column ``seq`` (one Arrow pass, see ``functions.oligo``)."""
    from .oligo import oligo_quality

    names = ["gc", "tm", "dg3", "clamp", "run4", "low", "self_run", "self_three", "hairpin", "penalty"]
    p = lambda name: F.col(prefix + name)
    df = df.withColumn("_q", oligo_quality(F.col(seq)))
    df = df.select(*[c for c in df.columns if c != "_q"], F.length(seq).alias(prefix + "len"),
                   *[F.col("_q." + n).alias(prefix + n) for n in names])
    return df.withColumns({
        prefix + "status": primer_status(p("penalty")),
        prefix + "warnings": primer_warnings(p("run4"), p("low"), p("self_three"), p("self_run"), p("hairpin"),
                                             p("dg3")),
    })


def pair_penalty(pen_f, pen_r, hetero, hetero_three, tm_f, tm_r) -> Column:
    return half_up(pen_f + pen_r + F.greatest(F.lit(0), hetero - 4) * 3
                   + F.greatest(F.lit(0), hetero_three - 2) * 7 + F.abs(tm_f - tm_r) / 2, 1)


def pair_confidence(penalty: Column) -> Column:
    return F.when(penalty <= 14, "high").when(penalty <= 26, "medium").otherwise("review")


def pair_warnings(warn_f: Column, warn_r: Column, hetero: Column, hetero_three: Column) -> Column:
    own = F.concat(F.transform(warn_f, lambda w: F.concat(F.lit("Fw "), w)),
                   F.transform(warn_r, lambda w: F.concat(F.lit("Rev "), w)))
    shared = F.when(hetero_three >= 4, F.lit("3' hetero-dimer risk")).when(hetero >= 7, F.lit("hetero-dimer risk"))
    return F.array_compact(F.concat(own, F.array(shared)))


def pair_score(tm_f, tm_r, gc_f, gc_r, clamp_f, clamp_r, amp, wanted, penalty, extra) -> Column:
    return half_up(-(F.abs(tm_f - 60) + F.abs(tm_r - 60)) - (F.abs(gc_f - 50) + F.abs(gc_r - 50)) / 10
                   + (clamp_f + clamp_r) * 2 - F.abs(amp - wanted) / 100 - penalty / 8 - extra, 2)


def simple_primer_score(seq: Column) -> Column:
    percent = gc_count(seq) / F.length(seq) * F.lit(100.0)
    return (F.abs(percent - 50) + F.when(has_homopolymer(seq, 5), 20.0).otherwise(0.0)
            + F.when(F.contains(seq, F.lit("AAAA")) | F.contains(seq, F.lit("TTTT")), 6.0).otherwise(0.0)
            + F.when(F.right(seq, F.lit(1)).isin("G", "C"), 0.0).otherwise(4.0))


# --- translation ---------------------------------------------------------------------------------

# The residue stands five characters after the semicolon before its codon; what is not found is at place 0.
_AA_TABLE = "....?" + "".join(f";{a}{b}{c}={CODON_TO_AA.get(a + b + c, '?')}" for a in BASES for b in BASES for c in BASES)


def codon_to_aa(codon: Column) -> Column:
    """One-letter residue of a codon, '*' for stop, '?' when unknown; one text search, the codon is evaluated once."""
    at = F.instr(F.lit(_AA_TABLE), F.concat(F.lit(";"), codon, F.lit("=")))
    return F.coalesce(F.substring(F.lit(_AA_TABLE), at + 5, F.lit(1)), F.lit("?"))


def show_stop(aa: Column) -> Column:
    return F.when(aa == "*", "Stop").otherwise(aa)


def codons(dna: Column) -> Column:
    """Whole codons of a sequence as an array."""
    count = F.floor(F.length(dna) / 3).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1),
                                         lambda i: F.substring(dna, i * 3 + 1, F.lit(3)))).otherwise(
        F.array().cast("array<string>"))


def residues(dna: Column) -> Column:
    """Residues of all whole codons; stop is shown as 'Stop'."""
    return F.transform(codons(dna), lambda c: show_stop(codon_to_aa(c)))


# --- comparison and editing ----------------------------------------------------------------------

def suffix_match(left: Column, right: Column) -> Column:
    """Number of equal bases from the 3' end up to the first difference or gap; 0 if lengths differ."""
    n = F.length(left)
    # Letters as arrays: one cheap comparison per position instead of substrings.
    bad = F.zip_with(F.split(F.reverse(left), ""), F.split(F.reverse(right), ""), lambda a, b: (a != b) | (a == "-"))
    first_bad = F.array_position(bad, True).cast("int")
    return F.when((F.coalesce(n, F.lit(0)) == 0) | (F.length(right) != n) | right.isNull(), F.lit(0)).otherwise(
        F.when(first_bad > 0, first_bad - 1).otherwise(n))


def diff_positions(left: Column, right: Column) -> Column:
    """0-based positions at which two texts of equal length differ."""
    def differ(a, b):
        return F.when(F.length(a) > 0, F.filter(
            F.sequence(F.lit(0), F.length(a) - 1),
            lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
    # Both texts are bound, or each place would evaluate them again.
    return let(F.struct(left.alias("a"), right.alias("b")), lambda x: differ(x["a"], x["b"]))


def diff_items(left: Column, right: Column) -> Column:
    """0-based positions at which two arrays differ, over the length of the right one."""
    def differ(a, b):
        return F.when(F.size(b) > 0, F.filter(
            F.sequence(F.lit(0), F.size(b) - 1),
            lambda i: ~F.get(b, i).eqNullSafe(F.get(a, i)))).otherwise(F.array().cast("array<int>"))
    return let(F.struct(left.alias("a"), right.alias("b")), lambda x: differ(x["a"], x["b"]))


def put_base(seq: Column, index: Column, base: Column) -> Column:
    """Replace the base at a 0-based index; an index outside the sequence (or null) changes nothing."""
    ok = (index >= 0) & (index < F.length(seq)) & base.isNotNull()
    return F.when(ok, F.overlay(seq, base, index.cast("int") + 1, F.lit(1))).otherwise(seq)


def put_insert(seq: Column, index: Column, insert: Column) -> Column:
    """Insert a text before a 0-based index."""
    return F.concat(F.substring(seq, F.lit(1), index.cast("int")), insert,
                    F.substring(seq, index.cast("int") + 1, F.length(seq)))


def mirror_positions(positions: Column, length: Column) -> Column:
    return F.array_sort(F.transform(positions, lambda i: length - 1 - i))


def locus_key(accession: Column, hit_from: Column, hit_to: Column) -> Column:
    a, b = F.coalesce(hit_from, F.lit(0)), F.coalesce(hit_to, F.lit(0))
    return F.concat(F.coalesce(F.nullif(accession, F.lit("")), F.lit("unknown")), F.lit(":"),
                    F.least(a, b).cast("string"), F.lit("-"), F.greatest(a, b).cast("string"))


def arm_side(strand: Column, cut: Column, edit: Column) -> Column:
    near = F.when(strand == "+", edit > cut).otherwise(edit < cut)
    return F.when(near, "PROX").otherwise("DIST")


def arm_regions(length: Column, long_first: bool) -> Column:
    """The two arms (91 and 36 bases) of a 127-base donor as array<struct<label,start,end>>."""
    first = F.least(F.lit(91 if long_first else 36), length)
    labels = ("91 bp arm", "36 bp arm") if long_first else ("36 bp arm", "91 bp arm")
    regions = F.array(
        F.struct(F.lit(labels[0]).alias("label"), F.lit(0).alias("start"), first.alias("end")),
        F.struct(F.lit(labels[1]).alias("label"), first.alias("start"), length.alias("end")))
    return F.filter(regions, lambda r: r["end"] > r["start"])


def region_of(index: Column, regions: Column) -> Column:
    return F.get(F.filter(regions, lambda r: (index >= r["start"]) & (index < r["end"])), F.lit(0))["label"]
