"""Choice of guides: near a target, as knockout pairs, from custom spacers; and edits that block them.

A guide is struct(spacer, pam, strand, cut, d, gc, ps) with d = cut - target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CODON_TO_AA
from ..functions.frame import barrier, let
from ..functions.numeric import half_up
from ..functions.seq import codon_to_aa, gc_count, revcomp
from .bandjoin import band_join
from .genome import SITE, genomic_to_coding, scan_sites

WINDOWS = (10, 20, 30)


class Reference:
    """A stretch of reference sequence held in column ``bases`` that starts at coordinate ``start``."""

    def __init__(self, bases: Column, start: Column, seq_len: Column):
        self.bases, self.start, self.seq_len = bases, start, seq_len

    def slice(self, begin: Column, length) -> Column:
        size = length if isinstance(length, Column) else F.lit(length)
        return F.substring(self.bases, (begin - self.start).cast("int") + 1, size.cast("int"))

    def base(self, gp: Column) -> Column:
        return self.slice(gp, 1)


def local_windows(models: DataFrame, targets: DataFrame, reach: int, columns: list[str] | None = None) -> DataFrame:
    """targets(request_id, seq_id, target, ...) with the bases within ``reach`` of the target attached as
    bases/bases_start/seq_len, so the full sequence is not carried past this join."""
    extra = [c for c in (columns or [])]
    joined = targets.join(models.select("seq_id", "seq", "seq_len", *extra), "seq_id")
    low = F.greatest(F.lit(0).cast("bigint"), F.col("target") - reach)
    high = F.least(F.col("seq_len").cast("bigint"), F.col("target") + reach)
    return joined.withColumns({
        "bases_start": low, "bases": F.substring("seq", low.cast("int") + 1, (high - low).cast("int"))}).drop("seq")


def nearby_guides(ref: Reference, target: Column, reach: int = WINDOWS[-1]) -> Column:
    """Guides with |d| <= reach as a sorted array (nearest first, then scan order)."""
    low = F.greatest(F.lit(0).cast("bigint"), target - reach - SITE)
    high = F.least(ref.seq_len.cast("bigint") - SITE, target + reach)

    def site(ps):
        def build(w):
            def guide(order, strand, text, shift):
                spacer = F.substring(text, 1, 20)
                cut = ps + shift
                return F.struct(F.abs(cut - target).alias("dist"), ps.alias("ps"), F.lit(order).alias("strand_order"),
                                spacer.alias("spacer"), F.substring(text, 21, 3).alias("pam"), F.lit(strand).alias("strand"),
                                cut.alias("cut"), (cut - target).alias("d"),
                                half_up(gc_count(spacer) / F.lit(20.0) * F.lit(100.0)).cast("int").alias("gc"))
            return F.array(
                F.when(F.endswith(w, F.lit("GG")) & F.substring(w, 21, 1).isin("A", "C", "G", "T"),
                       guide(0, "+", w, 17)),
                F.when(F.startswith(w, F.lit("CC")) & F.substring(w, 3, 1).isin("A", "C", "G", "T"),
                       guide(1, "-", revcomp(w), 6)))
        return let(ref.slice(ps, SITE), build)

    found = F.when(high >= low, F.flatten(F.transform(F.sequence(low, high), site)))
    ok = F.filter(found, lambda g: g.isNotNull() & (g["dist"] <= reach) & ~F.contains(g["spacer"], F.lit("TTTTT"))
                  & ~F.contains(g["spacer"], F.lit("AAAAA")))
    return F.coalesce(F.array_sort(ok), F.array())


def pick_both_strands(sorted_guides: Column) -> Column:
    """Best '+' and best '-' guide if both exist (in that order), else the best two."""
    first = lambda strand: F.get(F.filter(sorted_guides, lambda g: g["strand"] == strand), F.lit(0))
    plus, minus = first("+"), first("-")
    return F.when(plus.isNotNull() & minus.isNotNull(), F.array(plus, minus)).otherwise(F.slice(sorted_guides, 1, 2))


def with_insert_guides(df: DataFrame, ref: Reference, target: Column) -> DataFrame:
    """Add guides (<= 2), guide_window (10, 20 or 30) and guide_tier from the smallest window that has any."""
    # Barriers: without them the filters Spark derives from later explodes would evaluate the scan again.
    df = barrier(df, {"_near": nearby_guides(ref, target)})
    within = lambda w: F.exists("_near", lambda g: g["dist"] <= w)
    df = barrier(df, {"guide_window": F.coalesce(*[F.when(within(w), F.lit(w)) for w in WINDOWS])})
    window = F.col("guide_window")
    chosen = F.filter("_near", lambda g: g["dist"] <= window)
    tier = F.when(window == 10, "preferred").when(window == 20, "fallback").when(window == 30, "distant fallback")
    return barrier(df, {"guides": F.when(window.isNotNull(), let(chosen, pick_both_strands)), "guide_tier": tier}).drop("_near")


def guides_near_targets(sites: DataFrame, targets: DataFrame, reach: int) -> DataFrame:
    """Band join of a scanned site table with many targets per sequence: |cut - target| <= reach."""
    out = band_join(targets, sites, ["seq_id"], "target", "cut", -reach, reach)
    return out.withColumn("d", F.col("cut") - F.col("target"))


# --- custom spacers ------------------------------------------------------------------------------

def resolve_custom_guides(matches: DataFrame, wanted: DataFrame, max_distance: int | None) -> DataFrame:
    """Pick one site per custom spacer.

    ``wanted``: request_id, guide_no (1 or 2), spacer, target (null without a target); ``matches``: the same
    keys with strand, cut, ps, pam, gc. The second spacer avoids the site of the first when it has another
    one. Result: one row per request with guides, guide_window, guide_tier and err.
    """
    m = matches.withColumn("d", F.col("cut") - F.col("target"))
    if max_distance is not None:
        m = m.where(F.abs("d") <= max_distance)
    order = [F.coalesce(F.abs("d"), F.lit(2**53 - 1)), F.col("cut")]
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "guide_no").orderBy(*order)))
    # Only the two best sites can matter: the second guide moves on at most once.
    best = m.where("rank <= 2").select("request_id", "guide_no", "rank", F.struct(
        F.abs("d").alias("dist"), "ps", F.when(F.col("strand") == "+", 0).otherwise(1).alias("strand_order"), "spacer",
        "pam", "strand", "cut", "d", "gc").alias("g"))
    per = best.groupBy("request_id").agg(
        *[F.max(F.when((F.col("guide_no") == n) & (F.col("rank") == r), F.col("g"))).alias(f"g{n}{r}")
          for n in (1, 2) for r in (1, 2)])
    asked = wanted.groupBy("request_id").agg(
        F.max(F.when(F.col("guide_no") == 1, F.col("spacer"))).alias("s1"),
        F.max(F.when(F.col("guide_no") == 2, F.col("spacer"))).alias("s2"))
    df = asked.join(per, "request_id", "left")
    clash = (F.col("g21.ps") == F.col("g11.ps")) & (F.col("g21.strand") == F.col("g11.strand"))
    second = F.when(clash, F.coalesce("g22", "g21")).otherwise(F.col("g21"))
    reach = " could not be mapped to the reference sequence." if max_distance is None else \
        f" does not map within {max_distance} bp of the target site."

    def problem(s, g):
        return (F.when(s.isNull(), F.lit(None)).when(F.length(s) != 20, F.concat(
            F.lit('Custom gRNA "'), s, F.lit('" must be a 20 nt spacer.')))
            .when(g.isNull(), F.concat(F.lit("Custom gRNA "), s, F.lit(reach))))

    err = F.coalesce(problem(F.col("s1"), F.col("g11")), problem(F.col("s2"), F.col("g21")))
    guides = F.array_compact(F.array(F.col("g11"), F.when(F.col("s2").isNotNull(), second)))
    df = df.select("request_id", err.alias("err"), F.when(err.isNull(), guides).alias("guides"))
    return df.select("request_id", "err", "guides", F.array_max(F.transform(
        "guides", lambda g: F.coalesce(g["dist"], F.lit(0).cast("bigint")))).cast("int").alias("guide_window"),
        F.when(F.col("err").isNull(), "custom").alias("guide_tier"))


# --- knockout pairs ------------------------------------------------------------------------------

def knockout_segments(models: DataFrame) -> DataFrame:
    """Coding segments a knockout may use: the 2nd to 4th unless terminal, else any non-terminal one."""
    n = F.size("segs")
    seg = models.where(n >= 2).select(
        "seq_id", "seq", "seq_len", "exons", n.alias("_n"), F.posexplode("segs").alias("seg_no", "s"))
    keep = (F.col("seg_no") < F.col("_n") - 1) & ((F.col("_n") == 2) | F.col("seg_no").between(1, 3))
    exon = F.get(F.filter("exons", lambda x: (x["start"] <= F.col("s.start")) & (x["end"] >= F.col("s.end"))), F.lit(0))
    touch = F.get(F.filter("exons", lambda x: (x["end"] > F.col("s.start")) & (x["start"] < F.col("s.end"))), F.lit(0))
    return seg.where(keep).select(
        "seq_id", F.col("seg_no"), F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"),
        F.coalesce(exon["exon_number"], touch["exon_number"], F.col("seg_no") + 1).alias("exon_number"),
        "seq", "seq_len")


def segment_sites(segments: DataFrame) -> DataFrame:
    """Guide sites that cut in or close to their segment."""
    mid = F.floor((F.col("seg_start") + F.col("seg_end")) / 2)
    reach = F.floor((F.col("seg_end") - F.col("seg_start")) / 2) + 10
    low = F.greatest(F.lit(0).cast("bigint"), mid - reach - SITE)
    high = F.least(F.col("seq_len").cast("bigint"), mid + reach + SITE)
    stretch = segments.select(
        "seq_id", "seg_no", "seg_start", "seg_end", "exon_number", mid.alias("_mid"), reach.alias("_reach"),
        low.alias("bases_start"), F.substring("seq", low.cast("int") + 1, (high - low).cast("int")).alias("bases"))
    sites = scan_sites(stretch)
    return sites.where((F.abs(F.col("cut") - F.col("_mid")) <= F.col("_reach"))
                       & (F.col("cut") >= F.col("seg_start") - 25) & (F.col("cut") <= F.col("seg_end") + 25)).drop(
        "_mid", "_reach")


def segment_pairs(sites: DataFrame, max_spacing: int = 140) -> DataFrame:
    """All guide pairs of a segment with cuts at most ``max_spacing`` apart, left cut first.

    Sites meet by segment: each is sent once for either side, and the pairs come out grouped by segment."""
    order = (F.lit(100) - F.col("gc")).cast("bigint") * F.lit(2**40) + F.col("ps") * 2 + F.when(
        F.col("strand") == "+", 0).otherwise(1)
    names, segment = ["spacer", "pam", "strand", "cut", "gc", "ps", "ord"], ["seq_id", "seg_no", "seg_start", "seg_end", "exon_number"]
    base = sites.withColumn("ord", order).select(*segment, *names)
    left = base.select(*segment, *[F.col(c).alias("l_" + c) for c in names])
    right = base.select(*[F.col(c).alias("_" + c) for c in segment], *[F.col(c).alias("r_" + c) for c in names])
    gap = F.col("r_cut") - F.col("l_cut")
    pairs = left.join(right, (F.col("seq_id") == F.col("_seq_id")) & (F.col("seg_no") == F.col("_seg_no")) & (gap >= 0) & (gap <= max_spacing))
    pairs = pairs.drop(*["_" + c for c in segment])
    # Equal cuts: keep the pair once, the guide that ranks first on the left.
    pairs = pairs.where((F.col("r_cut") > F.col("l_cut")) | (F.col("l_ord") < F.col("r_ord")))
    spacing = F.col("r_cut") - F.col("l_cut")
    return pairs.withColumns({
        "spacing": spacing, "preferred": spacing.between(40, 140), "opposite": F.col("l_strand") != F.col("r_strand"),
        "pair_score": F.col("l_gc") + F.col("r_gc")})


def pair_order() -> list[Column]:
    """Order of a segment's pairs, ascending."""
    down = lambda c: -F.col(c).cast("int")
    spacing = F.when(F.col("preferred"), F.abs(F.col("spacing") - 90)).otherwise(-F.col("spacing"))
    return [down("preferred").alias("a"), down("opposite").alias("b"), down("pair_score").alias("c"), spacing.alias("d"), F.least("l_ord", "r_ord").alias("e"), F.greatest("l_ord", "r_ord").alias("f")]


def best_pair_per_segment(pairs: DataFrame) -> DataFrame:
    """The first pair of each segment, as a minimum: tasks take it of their own pairs first, so pairs are not exchanged."""
    best = pairs.groupBy("seq_id", "seg_no").agg(F.min_by(F.struct(*pairs.columns), F.struct(*pair_order())).alias("_b"))
    return best.select("_b.*")


def best_segment(best_pairs: DataFrame) -> DataFrame:
    length = (F.col("seg_end") - F.col("seg_start")).desc()
    w = Window.partitionBy("seq_id").orderBy(F.col("opposite").desc(), length, F.col("pair_score").desc(),
                                             F.col("spacing").asc(), F.col("seg_no").asc())
    return best_pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def knockout_targets(models: DataFrame) -> DataFrame:
    """One row per sequence that has a usable pair: chosen segment and both guides."""
    return best_segment(best_pair_per_segment(segment_pairs(segment_sites(knockout_segments(models)))))


# --- mutant codon and guide-blocking edits -------------------------------------------------------

def mutant_codon(codon: Column, aa: Column) -> Column:
    """Codon of ``aa`` with the fewest base changes, first in A, C, G, T order."""
    out = F.lit(None).cast("string")
    for residue in sorted(set(CODON_TO_AA.values())):
        codons = sorted(c for c, aa_of in CODON_TO_AA.items() if aa_of == residue)
        options = F.array(*[F.struct(
            sum(((F.substring(codon, i + 1, 1) != c[i]).cast("int") for i in (1, 2)),
                (F.substring(codon, 1, 1) != c[0]).cast("int")).alias("changes"),
            F.lit(c).alias("codon")) for c in codons])
        out = F.when(aa == residue, F.array_min(options)["codon"]).otherwise(out)
    return out


def codon_changes(codon: Column, mutant: Column, positions: Column) -> Column:
    """array<struct<gp,wt,alt>> of the bases that differ; ``positions`` are the three coordinates."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
        F.get(positions, i).alias("gp"), F.substring(codon, i + 1, F.lit(1)).alias("wt"),
        F.substring(mutant, i + 1, F.lit(1)).alias("alt"))), lambda c: c["wt"] != c["alt"])


def blocking_edit(ref: Reference, guide: Column, cds: Column, segs: Column, blocked: Column, non_coding: bool) -> Column:
    """First base change that stops the guide from cutting again.

    Sites in order: the two PAM G's, seed positions 11-20, then positions 1-10; bases in A, C, G, T order.
    A change must be silent in the coding sequence; outside it is taken only with ``non_coding``. Result:
    struct(gp, base, label, old, new, purpose, kind) or null.
    """
    plus, ps = guide["strand"] == "+", guide["ps"]
    pam_start = F.when(plus, ps + 20).otherwise(ps)
    no_index = F.lit(None).cast("int")
    pam_sites = F.transform(F.when(plus, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))),
                            lambda i: F.struct((pam_start + i).alias("gp"), F.lit("PAM").alias("label"), i.alias("pam_index")))

    def spacer_sites(first, last, word):
        return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.struct(
            F.when(plus, ps + i).otherwise(ps + 22 - i).alias("gp"),
            F.concat(F.lit(word + " pos "), (i + 1).cast("string"), F.lit("/20")).alias("label"), no_index.alias("pam_index")))

    sites = F.concat(pam_sites, spacer_sites(10, 19, "Seed"), spacer_sites(0, 9, "Guide"))
    sites = F.filter(sites, lambda s: (s["gp"] >= 0) & (s["gp"] < ref.seq_len) & ~F.coalesce(
        F.array_contains(blocked, s["gp"]), F.lit(False)))

    def with_codon(s):
        def build(cp):
            start = (F.floor(cp / 3) * 3).cast("int")
            codon = F.when(start + 3 <= F.length(cds), F.substring(cds, start + 1, F.lit(3)))
            return F.struct(s["gp"].alias("gp"), s["label"].alias("label"), s["pam_index"].alias("pam_index"),
                            ref.base(s["gp"]).alias("base"), codon.alias("codon"), F.when(codon.isNotNull(), codon_to_aa(codon)).alias("aa"),
                            (cp % 3).cast("int").alias("frame"), (F.floor(cp / 3) + 1).cast("int").alias("residue"))
        return let(genomic_to_coding(segs, s["gp"]), build)

    mutant = lambda s, alt: F.when(s["codon"].isNotNull(), F.overlay(s["codon"], alt, s["frame"] + 1, F.lit(1)))

    def first_base(s):
        """Number of the first base that may stand at the site."""
        fine = lambda alt: F.when(s["codon"].isNull(), F.lit(non_coding)).otherwise(codon_to_aa(mutant(s, alt)) == s["aa"])
        return F.coalesce(*[F.when((F.lit(b) != s["base"]) & fine(F.lit(b)), F.lit(i)) for i, b in enumerate("ACGT")], F.lit(-1))

    # Sites are looked at until one can be changed: four times the site's number and the base's, else -1.
    def look(found, s):
        return F.when(found >= 0, found).otherwise(let(let(with_codon(s), first_base), lambda b: F.when(b >= 0, s["no"] * 4 + b).otherwise(-1)))

    def numbered(rest):
        return F.transform(rest, lambda s, i: F.struct(s["gp"].alias("gp"), s["label"].alias("label"), s["pam_index"].alias("pam_index"), i.alias("no")))

    def result(s, alt):
        window = ref.slice(pam_start, 3)
        changed = F.overlay(window, alt, F.coalesce(s["pam_index"], F.lit(0)) + 1, F.lit(1))
        oriented = lambda pam: F.when(plus, pam).otherwise(revcomp(pam))
        pam_text = F.concat(F.lit("PAM "), oriented(window), F.lit("->"), oriented(changed))
        aa = s["aa"]
        coding = s["codon"].isNotNull()
        purpose = F.concat(F.when(s["pam_index"].isNotNull(), pam_text).otherwise(s["label"]),
                           F.when(coding, "").otherwise(" outside CDS"))
        return F.struct(
            s["gp"].alias("gp"), alt.alias("base"),
            F.when(coding, F.concat(F.lit("p."), aa, s["residue"].cast("string"), aa)).otherwise("noncoding").alias("label"),
            F.when(coding, s["codon"]).otherwise(s["base"]).alias("old"),
            F.when(coding, mutant(s, alt)).otherwise(alt).alias("new"), purpose.alias("purpose"),
            F.when(coding, "silent").otherwise("noncoding").alias("kind"))

    def chosen(sites):
        return let(F.aggregate(sites, F.lit(-1), look), lambda found: F.when(found >= 0, let(
            with_codon(F.get(sites, F.floor(found / 4).cast("int"))), lambda s: result(s, F.substring(F.lit("ACGT"), found % 4 + 1, F.lit(1))))))

    return F.when(guide.isNotNull(), let(numbered(sites), chosen))


def overlaps_span(guide: Column, start: Column, end: Column) -> Column:
    return (guide["ps"] < end) & (guide["ps"] + SITE > start)
