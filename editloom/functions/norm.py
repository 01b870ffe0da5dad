"""Names, labels and normalised keys (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numeric import empty_to_null, number_text, truthy


def gene_query(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def gene_token(value: Column) -> Column:
    """First word of a gene text without accession suffixes."""
    text = F.regexp_replace(F.trim(F.upper(value)), r"[-_\s]*(ENSG|NM_|NCBI)\S*", " ")
    return F.get(F.split(F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " ")), r"\s+"), F.lit(0))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[empty_to_null(v) for v in values], F.lit(""))


def absolute_url(value: Column, base: str = "https://www.fpbase.org") -> Column:
    """Full address of a link that may be relative to ``base``; '' when empty or malformed."""
    v = F.trim(F.coalesce(value, F.lit("")))
    full = (F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), v)
            .when(F.startswith(v, F.lit("//")), F.concat(F.lit("https:"), v))
            .when(F.startswith(v, F.lit("/")), F.concat(F.lit(base), v))
            .otherwise(F.concat(F.lit(base + "/"), v)))
    # A bare host gets its root path, as an address always has one.
    full = F.when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(full, F.lit("/"))).otherwise(full)
    host = F.try_parse_url(full, F.lit("HOST"))
    return F.when(v == "", "").when(host.isNull(), "").otherwise(full)


def safe_token(value: Column, fallback: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def tag_family(tag: Column) -> Column:
    """Short family name of a cassette; the first matching word wins."""
    raw = F.regexp_replace(F.coalesce(tag, F.lit("")), "^N:", "")
    out = F.when(raw.rlike("(?i)SD40"), "SD40")
    for word in ("dTAG", "mAID", "2xHA", "EGFP", "mScarlet", "mCherry"):
        out = out.when(raw.rlike("(?i)" + word), word)
    return out.otherwise(raw)


def design_prefix(gene: Column, kind: Column, mutation: Column, tag: Column) -> Column:
    modifier = (F.when(kind == "pm", safe_token(F.upper(mutation), "PM")).when(kind == "ko", "KO")
                .otherwise(F.concat(safe_token(tag_family(tag), "KI"), F.lit("_KI"))))
    return F.concat(safe_token(gene, "GENE"), F.lit("_"), modifier)


def guide_name(gene: Column, kind: Column, number: Column, mutation: Column, tag: Column) -> Column:
    return F.concat(design_prefix(gene, kind, mutation, tag), F.lit("_gRNA"), number.cast("string"))


def primer_name(gene: Column, kind: Column, direction: str, mutation: Column, tag: Column) -> Column:
    return F.concat(design_prefix(gene, kind, mutation, tag), F.lit("_" + direction))


def manifest_edit_class(value: Column) -> Column:
    """Edit class of a manifest spelling; null when it is not supported."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in fixed.MANIFEST_EDIT_TYPES.items()])


def batch_edit_class(value: Column, community: bool = False) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z]", "")
    kinds = ("pm", "ko") if community else tuple(fixed.BATCH_EDIT_TYPES)
    return F.coalesce(*[F.when(low.isin(*fixed.BATCH_EDIT_TYPES[k]), F.lit(k)) for k in kinds], F.lit(""))


def edit_class_label(kind: Column, community: bool = False) -> Column:
    """Label of an edit class; an unknown class shows the first label of the edition."""
    labels = fixed.COMMUNITY_EDIT_CLASSES if community else fixed.FULL_EDIT_CLASSES
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in labels.items()], F.lit(labels["pm"]))


def organism_id(assembly: Column) -> Column:
    low = F.lower(F.coalesce(assembly, F.lit("")))
    out = None
    for words, number in fixed.ORGANISM_RULES:
        test = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(low, F.lit(word))
        out = F.when(test, number) if out is None else out.when(test, number)
    return out.otherwise("1")


def cell_line_base(value: Column) -> Column:
    """Parental line: letters and digits up to the last 'A', alias lines folded together."""
    text = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]+", "")
    base = F.regexp_replace(text, r"([A-Z0-9]+A)\w*$", "$1")
    out = base
    for alias, main in fixed.CELL_LINE_ALIASES.items():
        out = F.when(base == alias, main).otherwise(out)
    return out


def project_number(folder: Column) -> Column:
    return F.regexp_extract(F.coalesce(folder, F.lit("")), r"^(\d{3,})\b", 1)


def parent_number(folder: Column) -> Column:
    return F.regexp_extract(F.coalesce(folder, F.lit("")), r"^\d{3,}\s+\((\d{3,})\)", 1)


def folder_title(folder: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(folder, F.lit("")), r"^\d{3,}(?:\s+\(\d{3,}\))?\s*-\s*", ""))


def folder_segment(value: Column, fallback: str) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(
        F.coalesce(value, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " "))
    return F.when(clean == "", fallback).otherwise(clean)


def project_folder(explicit: Column, number: Column, parent: Column, summary: Column, label: Column, gene: Column,
                   cell_line: Column) -> Column:
    """Folder name: the given one, else by project number, else by gene, edit and cell line."""
    given, num, par = (folder_segment(c, "") for c in (explicit, number, parent))
    edit = folder_segment(first_filled(summary, label), "")
    by_number = F.concat(num, F.when(par != "", F.concat(F.lit(" ("), par, F.lit(")"))).otherwise(""), F.lit(" - "), edit)
    by_gene = F.concat(folder_segment(gene, "GENE"), F.lit(" "),
                       folder_segment(first_filled(summary, label), "Genome edit"), F.lit(" in "),
                       folder_segment(cell_line, "CELL-LINE"))
    return F.when(given != "", given).when((num != "") & (edit != ""), by_number).otherwise(by_gene)


def design_label(kind, gene, wt, pos, mut, tag, short: bool = False) -> Column:
    """Report label of a design; ``short`` drops the 'p.' of mutations (batch label)."""
    change = F.concat(wt, pos.cast("string"), mut)
    return (F.when(kind == "pm", F.concat(gene, F.lit(" " if short else " p."), change))
            .when(kind == "ko", F.concat(gene, F.lit(" knockout")))
            .when(kind == "it", F.concat(gene, F.lit(" internal "), tag, F.lit(" after "), wt, pos.cast("string")))
            .otherwise(F.concat(gene, F.when(kind == "ct", " C-terminal ").otherwise(" N-terminal "), tag)))


def displayed_label(kind: Column, canonical: Column, requested: Column) -> Column:
    asked = F.trim(F.coalesce(requested, F.lit("")))
    return (F.when(asked == "", canonical)
            .when((kind == "pm") & (asked != canonical), F.concat(canonical, F.lit(" | requested: "), asked))
            .otherwise(asked))


def batch_label(label: Column, kind, gene, wt, pos, mut, tag) -> Column:
    given = F.trim(F.coalesce(label, F.lit("")))
    return F.when(given != "", given).otherwise(design_label(kind, gene, wt, pos, mut, tag, short=True))


def reset_fields(old_tag: Column, old_mutation: Column, new_kind: Column) -> tuple[Column, Column, Column]:
    """(class, tag, mutation) of a row after its edit class was changed to ``new_kind``."""
    from ..sources.dims import cassette_names

    known = old_tag.isin(*cassette_names())
    kind = F.when(new_kind.isin(*fixed.FULL_EDIT_CLASSES), new_kind).otherwise("pm")
    supported = new_kind.isin(*fixed.FULL_EDIT_CLASSES)
    tag = (F.when(~supported, old_tag)
           .when(new_kind == "it", F.when(old_tag.isin(*fixed.INTERNAL_TAGS), old_tag).otherwise("SPOT"))
           .when(new_kind == "ct", F.when(known & ~F.startswith(old_tag, F.lit("N:")), old_tag).otherwise("SD40-2xHA"))
           .when(new_kind == "nt", F.when(known, old_tag).otherwise("N:EGFP-Linker"))
           .otherwise(fixed.DEFAULT_TAG))
    mutation = (F.when(~supported, old_mutation)
                .when(new_kind == "it", F.when(old_mutation.rlike(r"(?i)^[A-Z]?\d+$"), old_mutation).otherwise(""))
                .when(new_kind == "ko", "").otherwise(old_mutation))
    return kind, tag, mutation


def reporter_summary(ex_max, em_max, brightness, agg, organism) -> Column:
    parts = [
        F.when(truthy(ex_max) & truthy(em_max), F.concat(F.lit("Ex/Em "), ex_max, F.lit("/"), em_max)),
        F.when(truthy(brightness), F.concat(F.lit("Brightness "), brightness)),
        F.when(truthy(agg), F.concat(F.lit("Agg "), agg)), empty_to_null(organism),
    ]
    return F.concat_ws(" • ", *parts)


def tier_name(tier: Column) -> Column:
    return F.when(tier == 1, "preferred").when(tier == 2, "fallback").when(tier == 3, "distant fallback")


def _tier_text(tier_word: Column, window: Column) -> Column:
    text = (F.when(tier_word == "preferred", "preferred window").when(tier_word == "fallback", "fallback window")
            .otherwise("distant fallback"))
    return F.concat(text, F.lit(" <="), window.cast("string"), F.lit(" bp"))


def insert_guide_note(d: Column, anchor: Column, tier_word: Column, window: Column) -> Column:
    side = F.when(d < 0, "5-prime").otherwise("3-prime")
    far = F.abs(d).cast("string")
    return F.when(tier_word == "custom", F.concat(F.lit("Custom gRNA | cut "), far, F.lit(" bp "), side, F.lit(" of "),
                                                  anchor)).otherwise(
        F.concat(F.lit("Cut "), far, F.lit(" bp "), side, F.lit(" of "), anchor, F.lit(" | "),
                 _tier_text(tier_word, window)))


def edit_guide_note(d: Column, tier_word: Column, window: Column) -> Column:
    far = F.abs(d).cast("string")
    return F.when(tier_word == "custom", F.concat(F.lit("Custom gRNA | cut-to-edit distance "), far, F.lit(" bp"))
                  ).otherwise(F.concat(F.lit("Cut-to-edit distance "), far, F.lit(" bp | "),
                                       _tier_text(tier_word, window)))


def internal_guide_note(d: Column, tier_word: Column, window: Column) -> Column:
    return F.concat(F.lit("Cut-to-insert distance "), F.abs(d).cast("string"), F.lit(" bp | "),
                    _tier_text(tier_word, window))


def knockout_guide_note(cut, context_label, context_detail, spacing, source_detail=None) -> Column:
    text = F.concat(F.lit("Cut at "), (cut + 1).cast("string"), F.lit(", "), context_label, F.lit(" ("),
                    context_detail, F.lit(")"))
    text = F.concat(text, F.coalesce(F.concat(F.lit(" | pair spacing "), spacing.cast("string"), F.lit(" bp")),
                                     F.lit("")))
    if source_detail is None:
        return text
    return F.concat(F.when(truthy(source_detail), F.concat(source_detail, F.lit(" | "))).otherwise(""), text)


def library_detail(rule_set2: Column, exon: Column, transcript: Column) -> Column:
    return F.concat(F.lit("Brunello reference guide | Rule Set 2 "), number_text(rule_set2),
                    F.when(truthy(exon), F.concat(F.lit(" | Exon "), exon)).otherwise(""),
                    F.when(truthy(transcript), F.concat(F.lit(" | "), transcript)).otherwise(""))


def target_detail(oof: Column, counts: Column, location: Column) -> Column:
    return F.concat(F.lit("Cas-Database reference guide | OOF "), F.format_string("%.2f", oof.cast("double")),
                    F.lit(" | off-targets "), counts,
                    F.when(truthy(location), F.concat(F.lit(" | "), location)).otherwise(""))
