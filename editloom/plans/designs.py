"""Design jobs: requests joined with models and carried through guides, donors and primers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import norm
from ..functions import text as tx
from ..functions.frame import barrier, let
from ..functions.numeric import half_up
from ..functions.seq import clean_dna, codon_to_aa, residues, show_stop
from ..operators.donors import apply_to_arm, check_insert, edit_oligo, insert_oligo
from ..operators.genome import (codon_at, coding_to_genomic, cut_context, guide_placement, regions_of, residue_at)
from ..operators.guides import (Reference, blocking_edit, codon_changes, knockout_targets, mutant_codon, overlaps_span,
                                with_insert_guides)
from ..operators.primers import (centred_targets, design_pairs, flanking_targets, outside_strategy, outside_targets,
                                 screen_targets)
from ..sources.dims import insert_table, internal_tag_table


def debug_line(models: DataFrame, feature_count: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("Parsed "), s(F.col("seq_len")), F.lit(" bp with "), s(feature_count), F.lit(" features. CDS: "), F.col("gene"),
                    F.lit(", "), s(F.size("segs")), F.lit(" segments, "), s(F.col("protein_length")), F.lit(" aa."))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Cut centre and deletion class of guide pairs (l_cut <= r_cut)."""
    return pairs.withColumns({
        "cut_center": half_up((F.col("l_cut") + F.col("r_cut")) / F.lit(2.0)),
        "spacing": F.abs(F.col("r_cut") - F.col("l_cut")),
        "long_deletion": F.abs(F.col("r_cut") - F.col("l_cut")) > fx.LONG_DELETION})


def with_insert(requests: DataFrame, inserts: DataFrame) -> DataFrame:
    """Attach the cassette sequence by name and terminus (null when there is none). The cassette table is a
    fixed dimension of about a hundred rows, hence the broadcast."""
    return requests.join(F.broadcast(inserts), ["insert_name", "terminus"], "left")


def construct_choice(requests: DataFrame, constructs: DataFrame) -> DataFrame:
    """Architecture group of a cassette; an unlisted one falls back to the first of the terminus."""
    first = constructs.where("group_no = 0 and position = 0").select(
        "terminus", F.col("architecture").alias("_a"), F.col("cassette").alias("_c"))
    listed = constructs.select("terminus", F.col("cassette").alias("insert_name"), "architecture", "cassette")
    out = requests.join(F.broadcast(listed), ["insert_name", "terminus"], "left").join(F.broadcast(first), "terminus", "left")
    return out.withColumns({"architecture": F.coalesce("architecture", "_a"), "cassette": F.coalesce("cassette", "_c")}).drop("_a", "_c")


# --- shared parts --------------------------------------------------------------------------------

_MODEL = ["gene", "seq", "seq_len", "segs", "exons", "cds", "protein_length"]


def _on_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    return requests.join(models.select("seq_id", *_MODEL), "seq_id")


def _cut_window(df: DataFrame, target: Column, reach: int) -> tuple[DataFrame, Reference]:
    """Add the bases within ``reach`` of a target column and drop the full sequence from the row."""
    df = df.withColumn("target", target)
    low = F.greatest(F.lit(0).cast("bigint"), F.col("target") - reach)
    df = barrier(df, {"bases_start": low, "bases": F.substring("seq", low.cast("int") + 1, F.lit(2 * reach))})
    return df, Reference(F.col("bases"), F.col("bases_start"), F.col("seq_len"))


def _choose_guides(df: DataFrame, ref: Reference, custom: DataFrame | None, none_text: str) -> DataFrame:
    """Custom guides where given (request_id, err, guides, guide_window, guide_tier), else the nearest ones."""
    if custom is not None:
        given = custom.select("request_id", F.col("err").alias("_ce"), F.col("guides").alias("_cg"),
                              F.col("guide_window").alias("_cw"), F.col("guide_tier").alias("_ct"))
        df = df.join(given, "request_id", "left")
    df = with_insert_guides(df, ref, F.col("target"))
    if custom is not None:
        asked = F.col("_ce").isNotNull() | F.col("_cg").isNotNull()
        for name, source in (("guides", "_cg"), ("guide_window", "_cw"), ("guide_tier", "_ct")):
            df = df.withColumn(name, F.when(asked, F.col(source)).otherwise(F.col(name)))
        df = df.withColumn("err", F.coalesce("err", "_ce")).drop("_ce", "_cg", "_cw", "_ct")
    return df.withColumn("err", F.coalesce("err", F.when(F.col("guides").isNull(), none_text)))


def _two(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    df = barrier(df, {"g1": F.get("guides", F.lit(0)), "g2": F.get("guides", F.lit(1))})
    return df, F.col("g1"), F.col("g2")


def _listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _numbered(edit: Column, number: int) -> Column:
    return F.when(edit.isNotNull(), F.struct(F.lit(number).alias("guide_no"), edit.alias("edit")))


def _guide_rows(kind: str, mutation: Column, tag: Column, note) -> Column:
    """Report rows of the chosen guides: name, spacer, PAM, strand, GC, distance, cut, note with placement."""
    regions = regions_of(F.col("exons"), F.col("segs"))

    def row(g, i):
        place = guide_placement(regions, g["ps"])
        return let(place, lambda p: F.struct(
            norm.guide_name(F.col("gene"), F.lit(kind), i + 1, mutation, tag).alias("name"), g["spacer"].alias("spacer"),
            g["pam"].alias("pam"), g["strand"].alias("strand"), g["gc"].alias("gc"), g["d"].cast("bigint").alias("d"),
            g["cut"].cast("bigint").alias("cut"), g["ps"].cast("bigint").alias("ps"),
            F.concat(note(g), F.lit(" | "), p["label"], F.lit(": "), p["detail"]).alias("note")))
    return F.transform(F.when(F.col("err").isNull(), F.col("guides")), row)


def _protected(g: Column, number: int, start: Column, edit: Column) -> Column:
    by_insert = overlaps_span(g, start, start + 3)
    return F.when(g.isNotNull(), F.struct(F.lit(number).alias("guide_no"), edit.isNotNull().alias("by_mutation"),
                                          by_insert.alias("by_insertion"), (edit.isNotNull() | by_insert).alias("protected")))


# --- point mutation ------------------------------------------------------------------------------

def mutation_designs(models: DataFrame, requests: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Point mutations: requests(request_id, seq_id, mutation) -> one design row each (err when impossible)."""
    df = _on_models(requests, models)
    m = tx.strict_mutation(F.col("mutation"))
    df = barrier(df, {"m_wt": m["wt"], "m_pos": m["pos"], "m_mut": m["mut"], "m_err": m["err"]})
    pos = F.col("m_pos")
    df = barrier(df, {"old_codon": codon_at(F.col("cds"), pos), "gp": coding_to_genomic(F.col("segs"), (pos.cast("bigint") - 1) * 3)})
    aa = codon_to_aa(F.col("old_codon"))
    df = barrier(df, {"new_codon": mutant_codon(F.col("old_codon"), F.col("m_mut")), "old_aa": aa})
    s = lambda c: c.cast("string")
    df = df.withColumn("err", F.coalesce(
        F.col("m_err"),
        F.when((F.trim("mutation") == "") | F.col("mutation").isNull(), "Enter a mutation such as L72S."),
        F.when(F.col("old_codon").isNull(), F.concat(F.lit("Cannot map amino acid "), s(pos), F.lit(" to the genomic sequence."))),
        F.when(F.col("old_aa") != F.col("m_wt"), F.concat(F.lit("Expected "), F.col("m_wt"), F.lit(" at position "), s(pos), F.lit(" but found "),
                                                         F.col("old_aa"), F.lit(" ("), F.col("old_codon"), F.lit(")."))),
        F.when(F.col("new_codon").isNull(), F.concat(F.lit("No codon encodes "), F.col("m_mut"), F.lit(".")))))
    spots = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: coding_to_genomic(F.col("segs"), (pos.cast("bigint") - 1) * 3 + i))
    df = barrier(df, {"changes": codon_changes(F.col("old_codon"), F.col("new_codon"), spots)})
    df, ref = _cut_window(df, F.coalesce("gp", F.lit(0).cast("bigint")), 300)
    df = _choose_guides(df, ref, custom, "No gRNAs found with cut sites within 30 bp of the mutation site.")
    df, g1, g2 = _two(df)
    blocked = F.transform("changes", lambda c: c["gp"])
    block = lambda g: blocking_edit(ref, g, F.col("cds"), F.col("segs"), blocked, False)
    df = barrier(df, {"e1": block(g1), "e2": block(g2)})
    oligo = lambda g, e: edit_oligo(ref, g, F.col("changes"), e, F.col("cds"), F.col("segs"))
    df = barrier(df, {"o1": oligo(g1, F.col("e1")), "o2": oligo(g2, F.col("e2"))})
    note = lambda g: norm.edit_guide_note(g["d"], F.col("guide_tier"), F.col("guide_window"))
    ok = F.col("err").isNull()
    return df.select(
        "request_id", "seq_id", F.lit("pm").alias("type"), "gene", F.col("m_wt").alias("wt_aa"), pos.alias("position"),
        F.col("m_mut").alias("mut_aa"), "old_codon", "new_codon", "gp", "changes", "guide_window", "guide_tier",
        _guide_rows("pm", F.col("mutation"), F.lit(""), note).alias("guides"),
        F.when(ok, _listed(_oligo_row(1, F.col("o1")), _oligo_row(2, F.col("o2")))).alias("oligos"),
        F.when(ok, _listed(_numbered(F.col("e1"), 1), _numbered(F.col("e2"), 2))).alias("edits"), "err",
        F.when(ok, F.col("gp")).alias("primer_center"))


def _oligo_row(number: int, o: Column) -> Column:
    return F.when(o.isNotNull(), F.struct(F.lit(number).alias("guide_no"), F.lit(f"ssODN{number}").alias("name"), o.alias("oligo")))


# --- internal tag --------------------------------------------------------------------------------

def internal_designs(models: DataFrame, requests: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Internal tags: requests(request_id, seq_id, mutation = site, tag) -> design rows."""
    df = _on_models(requests, models)
    spark = models.sparkSession
    df = df.join(F.broadcast(internal_tag_table(spark).withColumnRenamed("insert_name", "tag")), "tag", "left")
    m = tx.strict_site(F.col("mutation"))
    df = barrier(df, {"m_wt": m["wt"], "m_pos": m["pos"], "m_err": m["err"]})
    pos = F.col("m_pos")
    df = barrier(df, {"old_codon": codon_at(F.col("cds"), pos), "next_aa": F.coalesce(codon_to_aa(codon_at(F.col("cds"), pos + 1)), F.lit("?")),
                      "gp": coding_to_genomic(F.col("segs"), pos.cast("bigint") * 3)})
    df = df.withColumn("old_aa", codon_to_aa(F.col("old_codon")))
    s = lambda c: c.cast("string")
    df = df.withColumn("err", F.coalesce(
        F.when((F.trim("mutation") == "") | F.col("mutation").isNull(), "Enter an internal insertion site such as P155."), F.col("m_err"),
        F.when((pos < 1) | (pos >= F.col("protein_length")),
               "Internal insertion site must be within the coding sequence and before the final amino acid."),
        F.when(F.col("old_codon").isNull(), F.concat(F.lit("Cannot map amino acid "), s(pos), F.lit(" to the coding sequence."))),
        F.when((F.col("m_wt") != "") & (F.col("old_aa") != F.col("m_wt")), F.concat(
            F.lit("Expected "), F.col("m_wt"), F.lit(" at position "), s(pos), F.lit(" but found "), F.col("old_aa"), F.lit(" ("), F.col("old_codon"), F.lit(")."))),
        F.when(F.col("insert_seq").isNull(), F.concat(F.lit('Internal tag "'), F.col("tag"), F.lit('" is not available.'))),
        F.when(F.col("gp").isNull(), F.concat(F.lit("Cannot map insertion point after amino acid "), s(pos), F.lit(".")))))
    df, ref = _cut_window(df, F.coalesce("gp", F.lit(0).cast("bigint")), 300)
    df = _choose_guides(df, ref, custom, "No gRNAs found with cut sites within 30 bp of the internal insertion site.")
    df, g1, g2 = _two(df)
    block = lambda g, taken: blocking_edit(ref, g, F.col("cds"), F.col("segs"), taken, True)
    df = barrier(df, {"e1": block(g1, F.array().cast("array<bigint>"))})
    df = barrier(df, {"e2": block(g2, _listed(F.col("e1.gp")))})
    oligo = lambda g, e: insert_oligo(ref, g, F.col("target"), F.col("insert_seq"), e)
    df = barrier(df, {"o1": oligo(g1, F.col("e1")), "o2": oligo(g2, F.col("e2"))})
    site = F.concat(F.lit("AFTER_"), F.col("m_wt"), s(pos))
    note = lambda g: norm.internal_guide_note(g["d"], F.col("guide_tier"), F.col("guide_window"))
    ok = F.col("err").isNull()
    shown = F.coalesce("o1", "o2")
    made = F.substring(shown["donor"], shown["insert_start"] + 1, F.length("insert_seq"))
    return df.select(
        "request_id", "seq_id", F.lit("it").alias("type"), "gene", F.col("old_aa").alias("wt_aa"), pos.alias("position"), "next_aa", "tag", "gp",
        "guide_window", "guide_tier", _guide_rows("it", site, F.col("tag"), note).alias("guides"),
        F.when(ok, _listed(_oligo_row(1, F.col("o1")), _oligo_row(2, F.col("o2")))).alias("insert_oligos"),
        F.when(ok, _listed(_numbered(F.col("e1"), 1), _numbered(F.col("e2"), 2))).alias("edits"),
        F.length("insert_seq").alias("insert_length"), F.when(ok, check_insert(F.col("insert_seq"), F.coalesce(made, F.lit("")), False)).alias("insert_check"),
        internal_preview(F.col("cds"), F.col("protein_length"), pos, F.col("insert_aa")).alias("preview"), "err",
        F.when(ok, F.col("gp")).alias("primer_center"))


def internal_preview(cds: Column, protein_length: Column, pos: Column, insert_aa: Column) -> Column:
    """Residues up to eight before and after the insertion point."""
    aas = lambda first, last: F.array_join(F.transform(F.when(last >= first, F.sequence(first, last)), lambda i: F.coalesce(residue_at(cds, i), F.lit("?"))), "")
    before, after = aas(F.greatest(F.lit(1), pos - 7), pos), aas(pos + 1, F.least(protein_length, pos + 8))
    return F.struct(before.alias("wt_prefix"), F.coalesce(after, F.lit("")).alias("wt_suffix"), F.concat(before, insert_aa, F.coalesce(after, F.lit(""))).alias("donor"))


def knockin_preview(cds: Column, protein_length: Column, terminus: str, insert: Column) -> Column:
    """Residues across the junction of a terminal insert: struct(wt, donor) as arrays."""
    part = lambda first, last: F.transform(F.when(last >= first, F.sequence(first, last)), lambda i: show_stop(residue_at(cds, i)))
    size = F.least(F.lit(8), protein_length)
    if terminus == "ct":
        wt = part(protein_length - size + 1, protein_length)
        return F.struct(wt.alias("wt"), F.concat(wt, residues(insert)).alias("donor"))
    return F.struct(part(F.lit(1), size).alias("wt"), F.concat(residues(insert), part(F.lit(2), F.least(size + 1, protein_length))).alias("donor"))


# --- terminal inserts ----------------------------------------------------------------------------

def terminal_designs(models: DataFrame, requests: DataFrame, terminus: str, custom: DataFrame | None = None) -> DataFrame:
    """C- or N-terminal inserts: requests(request_id, seq_id, tag, homology_arm) -> design rows with donor."""
    spark = models.sparkSession
    inserts = insert_table(spark).where(F.col("terminus") == terminus).select(F.col("insert_name").alias("tag"), "insert_seq")
    df = _on_models(requests, models).join(F.broadcast(inserts), "tag", "left")
    n = F.col("seq_len").cast("bigint")
    site = F.element_at("segs", -1)["end"] - 3 if terminus == "ct" else F.get("segs", F.lit(0))["start"]
    arm = F.coalesce(F.nullif(F.regexp_extract(F.col("homology_arm").cast("string"), r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")),
                     F.lit(fx.DEFAULT_ARM).cast("bigint"))
    df = barrier(df, {"site": site, "arm": arm})
    df = barrier(df, {"codon": F.substring("seq", F.col("site").cast("int") + 1, F.lit(3)),
                      "arm_start": F.greatest(F.lit(0).cast("bigint"), F.col("site") - F.col("arm")),
                      "arm_end": F.least(n, F.col("site") + 3 + F.col("arm"))})
    cut = lambda a, b: F.substring("seq", a.cast("int") + 1, (b - a).cast("int"))
    df = barrier(df, {"h5": cut(F.col("arm_start"), F.col("site")), "h3": cut(F.col("site") + 3, F.col("arm_end"))})
    wrong = (F.when(~F.col("codon").isin("TAA", "TAG", "TGA"), F.concat(F.lit("Expected a stop codon at the end of the CDS, found "), F.col("codon"), F.lit(".")))
             if terminus == "ct" else F.when(F.col("codon") != "ATG", F.concat(F.lit("Expected ATG at CDS start, found "), F.col("codon"), F.lit("."))))
    unknown = F.concat(F.lit('Tag "' if terminus == "ct" else "Unknown tag: "), F.col("tag"), F.lit('" is not available.' if terminus == "ct" else "."))
    df = df.withColumn("err", F.coalesce(wrong, F.when(F.col("insert_seq").isNull(), unknown)))
    df, ref = _cut_window(df, F.col("site"), 300)
    df = _choose_guides(df, ref, custom, "No SpCas9 gRNAs found with cut sites within 30 bp of the stop codon." if terminus == "ct"
                        else "No gRNAs found with cut sites within 30 bp of the start codon.")
    df, g1, g2 = _two(df)
    gap = (lambda e: (e["gp"] >= F.col("site")) & (e["gp"] < F.col("site") + 3)) if terminus == "ct" else (lambda e: F.lit(False))
    inside = lambda e: F.when((e["gp"] >= F.col("arm_start")) & (e["gp"] < F.col("arm_end")) & ~gap(e), e)
    block = lambda g, taken: let(blocking_edit(ref, g, F.col("cds"), F.col("segs"), taken, True), inside)
    df = barrier(df, {"e1": block(g1, F.array().cast("array<bigint>"))})
    df = barrier(df, {"e2": block(g2, _listed(F.col("e1.gp")))})
    edits = _listed(F.col("e1"), F.col("e2"))
    df = barrier(df, {"a5": apply_to_arm(F.col("h5"), F.col("arm_start"), edits), "a3": apply_to_arm(F.col("h3"), F.col("site") + 3, edits)})
    anchor = F.lit("stop" if terminus == "ct" else "start codon replacement site")
    note = lambda g: norm.insert_guide_note(g["d"], anchor, F.col("guide_tier"), F.col("guide_window"))
    ok = F.col("err").isNull()
    donor = F.concat("a5", "insert_seq", "a3")
    made = F.substring(donor, F.length("h5") + 1, F.length("insert_seq"))
    return df.select(
        "request_id", "seq_id", F.lit(terminus).alias("type"), "gene", "tag", F.col("site").alias("gp"), F.col("arm").alias("arm_length"),
        F.length("h5").alias("h5_length"), F.length("h3").alias("h3_length"), F.length("insert_seq").alias("insert_length"),
        F.when(ok, donor).alias("donor"), F.when(ok, F.length(donor)).alias("donor_length"), "guide_window", "guide_tier",
        _guide_rows(terminus, F.lit(""), F.col("tag"), note).alias("guides"),
        F.when(ok, _listed(_numbered(F.col("e1"), 1), _numbered(F.col("e2"), 2))).alias("edits"),
        F.when(ok, _listed(_protected(g1, 1, F.col("site"), F.col("e1")), _protected(g2, 2, F.col("site"), F.col("e2")))).alias("protection"),
        F.when(ok, check_insert(F.col("insert_seq"), made, terminus == "ct")).alias("insert_check"),
        F.when(ok, made).alias("made_insert"), knockin_preview(F.col("cds"), F.col("protein_length"), terminus, F.col("insert_seq")).alias("ends_preview"),
        "seq_len", "err", F.when(ok, F.col("arm_start")).alias("arm_start"), F.when(ok, F.col("arm_end")).alias("arm_end"))


# --- knockout ------------------------------------------------------------------------------------

def knockout_designs(models: DataFrame, requests: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Knockouts: requests(request_id, seq_id) -> guide pair, exon text and cut geometry."""
    found = knockout_targets(models.join(requests.select("seq_id").distinct(), "seq_id", "left_semi"))
    side = lambda p: F.struct(*[F.col(p + c).alias(c) for c in ("spacer", "pam", "strand", "cut", "gc", "ps")],
                              (F.col(p + "cut") - F.floor((F.col("seg_start") + F.col("seg_end")) / 2)).alias("d"))
    auto = found.select("seq_id", side("l_").alias("g1"), side("r_").alias("g2"), "exon_number", F.col("seg_start").alias("exon_start"), F.col("seg_end").alias("exon_end"))
    df = requests.join(models.select("seq_id", "gene", "seq_len", "segs", "exons", "protein_length"), "seq_id").join(auto, "seq_id", "left")
    err = F.when(F.size("segs") < 2, "Not enough coding exons available for KO design.")
    if custom is not None:
        given = custom.select("request_id", F.col("err").alias("_ce"), F.col("guides").alias("_cg"))
        df = df.join(given, "request_id", "left")
        asked = F.col("_ce").isNotNull() | F.col("_cg").isNotNull()
        plain = lambda g: F.struct(*[g[c].alias(c) for c in ("spacer", "pam", "strand", "cut", "gc", "ps")], F.lit(None).cast("bigint").alias("d"))
        low = F.get("_cg", F.lit(0))["cut"] <= F.get("_cg", F.lit(1))["cut"]
        first = F.when(low, plain(F.get("_cg", F.lit(0)))).otherwise(plain(F.get("_cg", F.lit(1))))
        second = F.when(low, plain(F.get("_cg", F.lit(1)))).otherwise(plain(F.get("_cg", F.lit(0))))
        regions = regions_of(F.col("exons"), F.col("segs"))
        number = tx.exon_from_note(cut_context(regions, first["cut"])["label"])
        exon = F.get(F.filter("exons", lambda x: x["exon_number"] == number), F.lit(0))
        err = F.coalesce(err, F.col("_ce"), F.when(asked & (F.size("_cg") < 2), "Paste two custom gRNAs for knockout design."))
        df = barrier(df, {"_g1": F.when(asked, first).otherwise(F.col("g1")), "_g2": F.when(asked, second).otherwise(F.col("g2")),
                          "_n": F.when(asked, number).otherwise(F.col("exon_number")),
                          "_s": F.when(asked, F.coalesce(exon["start"], F.lit(0).cast("bigint"))).otherwise(F.col("exon_start")),
                          "_e": F.when(asked, F.coalesce(exon["end"], F.lit(0).cast("bigint"))).otherwise(F.col("exon_end"))})
        df = df.drop("g1", "g2", "exon_number", "exon_start", "exon_end").withColumnsRenamed(
            {"_g1": "g1", "_g2": "g2", "_n": "exon_number", "_s": "exon_start", "_e": "exon_end"})
    df = df.withColumn("err", F.coalesce(err, F.when(F.col("g1").isNull(), (
        "No gRNA pair found with cut-site spacing up to 140 bp across non-terminal coding exons, preferentially exons 2-4, "
        "including exon-intron boundaries."))))
    spacing = F.abs(F.col("g2.cut") - F.col("g1.cut"))
    regions = regions_of(F.col("exons"), F.col("segs"))
    s = lambda c: c.cast("string")

    def row(g, number):
        return let(cut_context(regions, g["cut"]), lambda c: let(guide_placement(regions, g["ps"]), lambda p: F.struct(
            norm.guide_name(F.col("gene"), F.lit("ko"), F.lit(number), F.lit(""), F.lit("")).alias("name"), g["spacer"].alias("spacer"),
            g["pam"].alias("pam"), g["strand"].alias("strand"), g["gc"].alias("gc"), g["d"].cast("bigint").alias("d"), g["cut"].cast("bigint").alias("cut"), g["ps"].cast("bigint").alias("ps"),
            F.concat(F.lit("Cut at "), s(g["cut"] + 1), F.lit(", "), c["label"], F.lit(" ("), c["detail"], F.lit(") | "), p["label"], F.lit(": "),
                     p["detail"], F.lit(" | pair spacing "), s(spacing), F.lit(" bp")).alias("note"))))

    long = spacing > fx.LONG_DELETION
    ok = F.col("err").isNull()
    return df.select(
        "request_id", "seq_id", F.lit("ko").alias("type"), "gene", "protein_length", "exon_number",
        F.when(ok, F.concat(F.lit("Exon "), F.coalesce(s(F.col("exon_number")), F.lit("null")), F.lit(" ("), s(F.col("exon_start") + 1), F.lit("-"),
                            s(F.col("exon_end")), F.lit(", "), s(F.col("exon_end") - F.col("exon_start")), F.lit(" bp)"))).alias("exon"),
        F.when(ok, F.array(row(F.col("g1"), 1), row(F.col("g2"), 2))).alias("guides"), F.when(ok, spacing).alias("spacing"),
        F.when(ok, long).alias("long_deletion"), F.when(ok, F.when(long, (
            "NHEJ-mediated deletion using dual Cas9 guides. Screen with flanking junction PCR, then confirm the deletion by sequencing."))
            .otherwise("NHEJ-mediated frameshift using Cas9 RNP. Screen by Sanger sequencing plus ICE/TIDE, then confirm protein loss.")).alias("strategy"),
        "err", F.when(ok, half_up((F.col("g1.cut") + F.col("g2.cut")) / F.lit(2.0))).alias("cut_center"),
        F.when(ok, F.col("g1.cut")).alias("left_cut"), F.when(ok, F.col("g2.cut")).alias("right_cut"))


# --- primers of designs --------------------------------------------------------------------------

def _with_seq(designs: DataFrame, models: DataFrame) -> DataFrame:
    return designs.join(models.select("seq_id", "seq"), "seq_id").withColumn("target_id", F.col("request_id"))


def centred_design_primers(designs: DataFrame, models: DataFrame, center: str = "primer_center", offset: int = 0) -> DataFrame:
    d = designs.where(F.col(center).isNotNull()).select("request_id", "seq_id", center)
    return design_pairs(centred_targets(_with_seq(d, models), center, offset=offset))


def terminal_design_primers(designs: DataFrame, models: DataFrame, per_side: int | None = None) -> DataFrame:
    """Pairs outside both arms; ``per_side`` limits the candidates of each side (none by default)."""
    d = designs.where("err is null").select("request_id", "seq_id", "arm_start", "arm_end")
    return design_pairs(outside_targets(_with_seq(d, models)), per_side=per_side)


def knockout_design_primers(designs: DataFrame, models: DataFrame, offset: int = fx.ICE_OFFSET) -> DataFrame:
    """Centred pairs for near cuts, deletion-screen pairs for cuts more than 1 kb apart."""
    d = designs.where("err is null").select("request_id", "seq_id", "cut_center", "left_cut", "right_cut", "long_deletion")
    near = design_pairs(centred_targets(_with_seq(d.where("not long_deletion"), models), "cut_center", offset=offset))
    far = design_pairs(screen_targets(_with_seq(d.where("long_deletion"), models)))
    return near.unionByName(far)


def with_best_pair(designs: DataFrame, pairs: DataFrame, mutation: Column, tag: Column) -> DataFrame:
    """Attach the first pair: primer names and sequences, amplicon text and primer strategy."""
    best = pairs.where("rank = 1").select(F.col("target_id").alias("request_id"), "fw_seq", "rev_seq", "amp", "wt_amp", "del_amp", "mode", "is_fallback")
    df = designs.join(best, "request_id", "left")
    s = lambda c: F.col(c).cast("string")
    kind = F.col("type")
    ki = (F.col("amp") + F.col("insert_length") - 3).cast("string") if "insert_length" in designs.columns else F.lit("")
    text = (F.when(F.col("mode") == "screen", F.concat(F.lit("WT ~"), s("wt_amp"), F.lit(" bp | deletion ~"), s("del_amp"), F.lit(" bp")))
            .when(F.col("mode") == "outside", F.concat(F.lit("WT ~"), s("amp"), F.lit(" bp | KI ~"), ki, F.lit(" bp")))
            .when(F.col("mode").isNotNull(), F.concat(F.lit("~"), s("amp"), F.lit(" bp"))).otherwise(""))
    has = F.col("fw_seq").isNotNull()
    strategy = (F.when(kind.isin("ct", "nt"), outside_strategy(has, F.coalesce("is_fallback", F.lit(False))))
                .when(F.col("mode") == "screen", "validated-deletion-screen").otherwise("validated-centered"))
    return df.withColumns({
        "fw_name": F.when(has, norm.primer_name(F.col("gene"), kind, "Fw", mutation, tag)),
        "rev_name": F.when(has, norm.primer_name(F.col("gene"), kind, "Rev", mutation, tag)),
        "amplicon": text, "primer_strategy": strategy}).drop("amp", "wt_amp", "del_amp", "mode")


def replace_primers(designs: DataFrame, panel: DataFrame) -> DataFrame:
    """Take the primers of a panel result where there is one. panel: request_id, fw_seq, rev_seq, amplicon,
    strategy, target_summary."""
    p = panel.select("request_id", F.col("fw_seq").alias("_f"), F.col("rev_seq").alias("_r"), F.col("amplicon").alias("_a"),
                     F.concat("strategy", F.lit(" | "), "target_summary").alias("_s"))
    df = designs.join(p, "request_id", "left")
    swap = {"fw_seq": "_f", "rev_seq": "_r", "amplicon": "_a", "primer_strategy": "_s"}
    return df.withColumns({k: F.coalesce(F.col(v), F.col(k)) for k, v in swap.items()}).drop(*swap.values())


# --- primer panel --------------------------------------------------------------------------------

def primer_panel(requests: DataFrame) -> dict[str, DataFrame]:
    """Free primer design: request_id, sequence, mode (centered, flanking, deletion) and 1-based positions a, b.

    Returns {'pairs': ..., 'errors': ...}; faulty rows get the reason instead of primers."""
    df = requests.withColumn("seq", clean_dna(F.col("sequence"), keep_n=True)).withColumn("n", F.length("seq"))
    n, a, b, s = F.col("n"), F.col("a"), F.col("b"), F.col("n").cast("string")
    mode = F.col("mode")
    bad = lambda c: c.isNull() | (c < 1) | (c > n)
    err = (F.when(n == 0, "Paste a DNA sequence or upload a GenBank file first.")
           .when(n < 120, "Reference sequence must be at least 120 bp long for primer design.")
           .when((mode == "centered") & bad(a), F.concat(F.lit("Centered primer mode needs a valid 1-based target position between 1 and "), s, F.lit(".")))
           .when((mode == "flanking") & (a.isNull() | b.isNull() | (a < 1) | (b > n) | (a > b)), F.concat(
               F.lit("Flanking primer mode needs a valid 1-based interval within 1-"), s, F.lit(".")))
           .when((mode == "deletion") & (a.isNull() | b.isNull() | (a < 1) | (b > n) | (a >= b)), F.concat(
               F.lit("Deletion screen mode needs two valid 1-based cut positions within 1-"), s, F.lit(".")))
           .when(~mode.isin("centered", "flanking", "deletion"), F.concat(F.lit("Unsupported primer design mode: "), mode, F.lit("."))))
    df = df.withColumns({"err": err, "target_id": F.col("request_id")})
    ok = df.where("err is null")
    part = lambda m: ok.where(mode == m).withColumns({"p": (a - 1).cast("bigint"), "q": b.cast("bigint"), "q0": (b - 1).cast("bigint")})
    pairs = (design_pairs(centred_targets(part("centered"), "p"))
             .unionByName(design_pairs(flanking_targets(part("flanking"), "p", "q")))
             .unionByName(design_pairs(screen_targets(part("deletion"), "p", "q0"))))
    return {"pairs": pairs.withColumnRenamed("target_id", "request_id"), "errors": df.where("err is not null").select("request_id", "err")}


# --- dispatch ------------------------------------------------------------------------------------

DESIGN_COLUMNS = ["request_id", "type", "gene", "guides", "err"]


def dispatch(models: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Requests of all classes -> design tables by class. requests: request_id, seq_id, project_type,
    mutation, tag, homology_arm."""
    of = lambda k: requests.where(F.col("project_type") == k)
    return {"ko": knockout_designs(models, of("ko")), "pm": mutation_designs(models, of("pm")), "it": internal_designs(models, of("it")),
            "ct": terminal_designs(models, of("ct"), "ct"), "nt": terminal_designs(models, of("nt"), "nt")}


def batch_results(requests: DataFrame, models: DataFrame, designs: dict[str, DataFrame]) -> DataFrame:
    """One row per request: success with its guides, or error with the reason (also without a reference)."""
    rows = None
    for d in designs.values():
        part = d.select(*DESIGN_COLUMNS)
        rows = part if rows is None else rows.unionByName(part)
    lost = requests.join(models.select("seq_id"), "seq_id", "left_anti").select(
        "request_id", F.col("project_type").alias("type"), F.lit("").alias("gene"), F.lit(None).cast(rows.schema["guides"].dataType).alias("guides"),
        F.lit("Upload a GenBank file first.").alias("err"))
    return rows.unionByName(lost).withColumn("status", F.when(F.col("err").isNull(), "success").otherwise("error"))


def remapped_knockout(designs: DataFrame, sites: DataFrame, models: DataFrame, chosen: DataFrame) -> DataFrame:
    """Knockouts with other guides put in: map spacer and exact PAM on the reference, prefer the exon and cut of
    the guide's note, recompute spacing, exon and note. ``chosen``: request_id, seq_id, guide_no, spacer, pam,
    detail, exon_hint, cut_hint."""
    hits = sites.join(chosen, ["seq_id", "spacer", "pam"], "right").join(
        models.select("seq_id", regions_of(F.col("exons"), F.col("segs")).alias("regions")), "seq_id")
    hits = barrier(hits, {"ctx": F.when(F.col("cut").isNotNull(), cut_context(F.col("regions"), F.col("cut")))})
    exon = tx.exon_from_note(F.col("ctx.label"))
    far = F.coalesce(F.abs(F.col("cut") - F.col("cut_hint")), F.lit(2**53 - 1))
    w = Window.partitionBy("request_id", "guide_no").orderBy(F.when(exon == F.col("exon_hint"), 0).otherwise(1), far, F.col("cut"))
    best = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    best = best.withColumn("cut", F.coalesce("cut", "cut_hint"))
    best = barrier(best, {"c2": F.coalesce("ctx", F.when(F.col("cut").isNotNull(), cut_context(F.col("regions"), F.col("cut"))), F.struct(
        F.lit("genomic context unresolved").alias("label"), F.lit("position unavailable").alias("detail")))})
    best = best.withColumn("exon_number", F.coalesce(tx.exon_from_note(F.col("ctx.label")), F.col("exon_hint")))
    both = Window.partitionBy("request_id")
    spacing = F.when(F.count("cut").over(both) == 2, F.max("cut").over(both) - F.min("cut").over(both))
    best = best.withColumns({"spacing": spacing, "cut_center": half_up(F.avg("cut").over(both))})
    return best.withColumn("note", norm.knockout_guide_note(F.col("cut"), F.col("c2.label"), F.col("c2.detail"), F.col("spacing"), F.col("detail"))).select(
        "request_id", "seq_id", "guide_no", "spacer", "pam", "strand", "cut", "exon_number", "spacing", "cut_center", "detail",
        F.col("c2.label").alias("context_label"), F.col("c2.detail").alias("context_detail"), "note")
