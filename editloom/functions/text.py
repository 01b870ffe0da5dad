"""Reading free-text edit requests: every function maps a text column to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .frame import first_rule, let
from .norm import gene_token
from .numeric import truthy


def _squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def _squash_py(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isascii() and ch.isalnum())


def cell_line_token(text: Column) -> Column:
    return F.regexp_extract(text, r"\b[A-Za-z]{2,10}\d{3}-A(?:-[A-Za-z0-9]+)?\b", 0)


def mutation_token(text: Column) -> Column:
    pattern = r"\b([A-Za-z])\s*-?(\d+)\s*-?([A-Za-z])\b"
    return F.concat(F.upper(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2),
                    F.upper(F.regexp_extract(text, pattern, 3)))


def internal_site_token(text: Column) -> Column:
    after = F.regexp_extract(text, r"(?i)\bafter\s+([A-Za-z]\d+|\d+)\b", 1)
    inline = F.when(text.rlike(r"(?i)\b(internal|in-frame|inframe)\b"),
                    F.regexp_extract(text, r"(?i)\b([A-Za-z]\d+|\d+)\b", 1)).otherwise("")
    return F.upper(F.when(after != "", after).otherwise(inline))


CT_WORDS = r"\b(c[\s-]?(?:term(?:inal|inus)?)|ct)\b"
NT_WORDS = r"\b(n[\s-]?(?:term(?:inal|inus)?)|nt)\b"
INTERNAL_WORDS = r"\b(internal|in-frame|inframe)\b"


def edit_class(text: Column, mutation: Column, site: Column, cassette: Column) -> Column:
    """Edit class of a line; the first rule that holds wins."""
    low = F.lower(text)
    return (F.when(low.rlike(r"\b(ko|knockout)\b"), "ko")
            .when(low.rlike(INTERNAL_WORDS), "it")
            .when(low.rlike(CT_WORDS), "ct")
            .when(low.rlike(NT_WORDS), "nt")
            .when(truthy(site) & cassette.isin(*fixed.INTERNAL_TAGS), "it")
            .when(F.startswith(cassette, F.lit("N:")), "nt")
            .when(truthy(cassette), "ct")
            .when(truthy(mutation), "pm")
            .when(F.trim(text).rlike("^[A-Za-z0-9._-]+$"), "ko")
            .otherwise("pm"))


def reporter_mention(text: Column) -> Column:
    """First reporter, in catalogue order, whose squashed name occurs in the squashed text."""
    return F.coalesce(let(_squash(text), lambda line: first_rule(
        list(fixed.REPORTER_NAMES.items()), lambda n: F.contains(line, n))), F.lit(""))


def reporter_key(name: Column) -> Column:
    return F.coalesce(let(_squash(name), lambda low: first_rule(
        list(fixed.REPORTER_NAMES.items()), lambda n: low == n)), F.lit(""))


def architecture_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(low.rlike(r"\bp2a\b"), "p2a").when(low.rlike(r"\bt2a\b"), "t2a")
            .when(low.rlike(r"\bfusion\b|\blink(?:er)?\b|\bdirect\b"), "fusion").otherwise(""))


def reporter_cassette(reporter: Column, target: str, hint: Column) -> Column:
    """Order-ready cassette of a reporter at one terminus, picked by the architecture hint."""
    out = F.lit(None).cast("string")
    for key, by_end in fixed.REPORTER_CASSETTES.items():
        options = by_end[0 if target == "nt" else 1]
        first = lambda word: next((o for o in options if word in o), "")
        pick = (F.when(hint == "fusion", first("Linker")).when(hint == "t2a", first("T2A"))
                .when(hint == "p2a", first("P2A")).otherwise(options[0] if len(options) == 1 else ""))
        out = F.when(reporter == key, pick).otherwise(out)
    return F.coalesce(out, F.lit(""))


def internal_tag_key(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in fixed.INTERNAL_TAGS], F.lit(""))


def cassette_key(text: Column, target: str = "") -> Column:
    """Cassette (or internal tag) named by a line: alias, then reporter with architecture, then internal
    tag, then the longest catalogue key contained in the line and allowed for the target."""
    from ..sources.dims import cassette_names

    keys = sorted(cassette_names(), key=len, reverse=True)
    contained = []
    if target in ("", "it"):
        contained += [(_squash_py(k), k) for k in sorted(fixed.INTERNAL_TAGS, key=len, reverse=True)]
    for key in keys:
        needle = _squash_py(key)
        if {"nt": key in fixed.NT_CASSETTES, "ct": key in fixed.CT_CASSETTES}.get(target, True):
            contained.append((needle, key))
        if target == "nt" and key.startswith("N:"):
            contained.append((needle.removeprefix("n"), key))

    def search(line):
        rules = [first_rule(list(fixed.CASSETTE_ALIASES.items()), lambda n: line == n)]
        if target in ("nt", "ct"):
            rules.append(F.nullif(let(reporter_mention(text), lambda r: let(
                architecture_hint(text), lambda h: reporter_cassette(r, target, h))), F.lit("")))
        rules.append(first_rule(contained, lambda n: F.contains(line, n)))
        return F.coalesce(*rules, F.lit(""))

    return let(_squash(text), search)


def gene_from_text(text: Column, cell_line: Column, mutation: Column, cassette: Column) -> Column:
    raw = F.trim(F.regexp_replace(text, "[,;]+", " "))
    pieces = F.split(F.lower(F.coalesce(cassette, F.lit(""))), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in fixed.GENE_STOP_WORDS])
    reporters = F.array(*[F.lit(w) for w in fixed.REPORTER_NAMES])

    def valid(token):
        low = F.lower(token)
        return (token.rlike("[A-Za-z]") & ~F.array_contains(stop, low)
                & ~(truthy(cell_line) & (low == F.lower(cell_line)))
                & ~(truthy(mutation) & (low == F.lower(mutation)))
                & ~F.array_contains(pieces, low)
                & ~F.array_contains(reporters, F.regexp_replace(low, "[^a-z0-9]+", "")))

    named = F.regexp_extract(raw, r"(?i)\bof\s+([A-Za-z0-9._-]+)\b", 1)
    first = F.get(F.filter(F.split(raw, r"\s+"), lambda t: valid(t)), F.lit(0))
    return F.when((named != "") & valid(named), gene_token(named)).otherwise(
        F.coalesce(gene_token(first), F.lit("")))


def unsupported_issue(text: Column, cassette: Column, community: bool) -> Column:
    if not community:
        return F.lit("")
    low = F.lower(F.coalesce(text, F.lit("")))
    bad = low.rlike(INTERNAL_WORDS) | low.rlike(CT_WORDS) | low.rlike(NT_WORDS) | truthy(cassette)
    return F.when(bad, fixed.COMMUNITY_ONLY_MESSAGE).otherwise("")


def custom_guides(text: Column) -> Column:
    """First two non-empty spacers of a list separated by newline, comma or semicolon."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n|,|;"),
                        lambda t: F.regexp_replace(F.upper(t), "[^ACGT]", ""))
    return F.slice(F.filter(items, lambda t: t != ""), 1, 2)


def has_raw_reference(r: DataFrame) -> Column:
    return (truthy(F.regexp_replace(F.upper(F.coalesce(r["raw_sequence"], F.lit(""))), "[^ACGT]", ""))
            & truthy(r["cds_start"]) & truthy(r["cds_end"]))


def has_reference(r: DataFrame) -> Column:
    return F.when(r["reference_source"] == "raw", has_raw_reference(r)).otherwise(truthy(r["file_name"]))


def parse_issue(r: DataFrame) -> Column:
    """'Needs a, b' for what a request row lacks; empty when nothing is missing."""
    kind, has_file = r["project_type"], truthy(r["file_name"])
    raw_ok, custom = has_raw_reference(r), F.size(custom_guides(r["custom_guides"])) > 0
    is_raw = r["reference_source"] == "raw"
    dna = truthy(F.regexp_replace(F.upper(F.coalesce(r["raw_sequence"], F.lit(""))), "[^ACGT]", ""))
    rules = [
        (~truthy(r["gene"]), "gene"),
        (~truthy(r["cell_line"]) & ~((kind == "ko") & ~has_file), "cell line"),
        ((kind == "pm") & ~truthy(r["mutation"]), "mutation"),
        ((kind == "it") & ~truthy(r["mutation"]), "in-frame insert site"),
        ((kind == "it") & ~truthy(r["tag"]), "internal tag"),
        (kind.isin("ct", "nt") & ~truthy(r["tag"]), "cassette"),
        (is_raw & ~dna, "DNA sequence"),
        (is_raw & ~(truthy(r["cds_start"]) & truthy(r["cds_end"])), "CDS coordinates"),
        (~is_raw & ~has_file & ((kind != "ko") | custom), "GenBank"),
        ((kind == "ko") & custom & ~(has_file | raw_ok), "reference sequence"),
    ]
    missing = F.array_compact(F.array(*[F.when(test, F.lit(word)) for test, word in rules]))
    return F.when(F.size(missing) > 0, F.concat(F.lit("Needs "), F.array_join(missing, ", "))).otherwise("")


def section_issues(r: DataFrame) -> dict[str, Column]:
    """The same gaps as full sentences, by form section (arrays of text)."""
    kind, anchored = r["project_type"], has_reference(r)
    custom = F.size(custom_guides(r["custom_guides"])) > 0
    is_raw = r["reference_source"] == "raw"
    dna = truthy(F.regexp_replace(F.upper(F.coalesce(r["raw_sequence"], F.lit(""))), "[^ACGT]", ""))
    listed = lambda rules: F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in rules]))
    return {
        "project": listed([
            (~truthy(r["gene"]), "Enter a gene or locus."),
            (~truthy(r["cell_line"]) & ~((kind == "ko") & ~anchored), "Add a cell line for the final report."),
        ]),
        "reference": listed([
            (is_raw & ~dna, "Paste a genomic DNA sequence."),
            (is_raw & ~(truthy(r["cds_start"]) & truthy(r["cds_end"])), "Provide CDS start and end coordinates."),
            (~is_raw & ~anchored & (kind != "ko"), "Upload a GenBank file or switch to raw DNA input."),
            ((kind == "ko") & ~anchored & ~custom, "Gene-only KO mode will suggest reference guides only. Upload a "
             "reference to generate validation primers automatically."),
            ((kind == "ko") & custom & ~anchored, "Upload a reference before using custom knockout guides."),
        ]),
        "design": listed([
            ((kind == "pm") & ~truthy(r["mutation"]), "Enter the requested mutation, for example R175H."),
            ((kind == "it") & ~truthy(r["mutation"]), "Enter the internal insertion site, for example P155."),
            ((kind == "it") & ~truthy(r["tag"]), "Choose an internal tag."),
            (kind.isin("ct", "nt") & ~truthy(r["tag"]), "Choose a cassette."),
        ]),
    }


ROW_DEFAULTS = {
    "label": "", "project_no": "", "parent_no": "", "client_name": "", "gene": "", "cell_line": "", "edit_summary": "",
    "project_folder": "", "notes": "", "project_type": "pm", "reference_source": "genbank",
    "requested_reporter": "", "mutation": "", "tag": fixed.DEFAULT_TAG, "homology_arm": "250", "custom_guides": "",
    "file_name": "", "raw_sequence": "", "cds_start": "", "cds_end": "", "exon_coordinates": "",
}


def with_row_defaults(df: DataFrame) -> DataFrame:
    """Add the request-row columns a table does not have yet."""
    return df.withColumns({k: F.lit(v) for k, v in ROW_DEFAULTS.items() if k not in df.columns})


def parse_requests(lines: DataFrame, text: str = "line", community: bool = False,
                   files: DataFrame | None = None) -> DataFrame:
    """Request lines -> request rows. ``files`` (gene_key, file_name), one row per key, links references."""
    df = lines.withColumn("_t", F.trim(F.col(text))).where(truthy(F.col("_t")))
    t = F.col("_t")
    df = df.withColumns({"_first": cassette_key(t), "_mut": mutation_token(t), "_site": internal_site_token(t)})
    df = df.withColumn("_kind", edit_class(t, F.col("_mut"), F.col("_site"), F.col("_first")))
    df = df.withColumn("_bad", unsupported_issue(t, F.col("_first"), community))
    df = df.withColumn("project_type", F.when(F.col("_bad") != "", F.when(F.col("_kind") == "ko", "ko").otherwise("pm"))
                       .otherwise(F.col("_kind")))
    kind = F.col("project_type")
    ends = kind.isin("ct", "nt")
    named = (F.when(kind == "nt", cassette_key(t, "nt")).when(kind == "ct", cassette_key(t, "ct"))
             .when(kind == "it", cassette_key(t, "it")).otherwise(cassette_key(t)))
    df = df.withColumns({"_named": named, "cell_line": cell_line_token(t)})
    df = df.withColumn("_key", F.when(F.col("_named") != "", F.col("_named"))
                       .otherwise(F.when(kind.isin("ct", "nt", "it"), F.col("_first")).otherwise("")))
    df = df.withColumns({
        "gene": gene_from_text(t, F.col("cell_line"), F.col("_mut"), F.col("_key")),
        "requested_reporter": F.when(ends, reporter_mention(t)).otherwise(""),
        "mutation": F.when(kind == "pm", F.col("_mut")).when(kind == "it", F.col("_site")).otherwise(""),
        "tag": F.when(ends, F.col("_key")).when(
            kind == "it", F.when(F.col("_key") != "", F.col("_key")).otherwise("SPOT")).otherwise(
            "" if community else fixed.DEFAULT_TAG),
        "label": t, "edit_summary": t,
    })
    if files is not None:
        df = df.join(files.select(F.col("gene_key").alias("gene"), "file_name"), "gene", "left").withColumn(
            "file_name", F.coalesce(F.col("file_name"), F.lit("")))
    df = with_row_defaults(df)
    issue = F.when(F.col("_bad") != "", F.col("_bad")).otherwise(parse_issue(df))
    return df.withColumn("parse_issue", issue).drop("_t", "_first", "_mut", "_site", "_kind", "_bad", "_named", "_key")


# --- strict formats --------------------------------------------------------------------------------

def strict_mutation(text: Column) -> Column:
    """'G96S' in its accepted spellings -> struct(wt, pos, mut, err)."""
    s = F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "(?i)^p\\.", ""), r"\s+", ""))
    plain, swapped, spaced = r"^([A-Z])(\d+)([A-Z])$", r"^(\d+)([A-Z])([A-Z])$", r"^([A-Z])[-_/]?(\d+)[-_/]?([A-Z])$"
    grab = lambda p, i: F.regexp_extract(s, p, i)
    ok = s.rlike(spaced)
    return F.struct(
        F.when(ok, grab(spaced, 1)).alias("wt"), F.when(ok, grab(spaced, 2).cast("int")).alias("pos"),
        F.when(ok, grab(spaced, 3)).alias("mut"),
        F.when(ok, F.lit(None).cast("string")).when(s.rlike(swapped), F.concat(
            F.lit("Use mutation format "), grab(swapped, 2), grab(swapped, 1), grab(swapped, 3), F.lit(", not "), s,
            F.lit(". The app expects WT-position-mutant, for example G96S.")))
        .otherwise("Cannot parse mutation. Use WT-position-mutant format such as G96S or p.G96S.").alias("err"))


def strict_site(text: Column) -> Column:
    """'P155' or '155', 'after' allowed in front -> struct(wt, pos, err)."""
    s = F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^after\s+", ""),
                                 r"\s+", ""))
    pattern = r"^([A-Z]?)(\d+)$"
    ok = s.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(s, pattern, 1)).alias("wt"),
        F.when(ok, F.regexp_extract(s, pattern, 2).cast("int")).alias("pos"),
        F.when(~ok, "Use an internal insertion site such as P155 or 155.").alias("err"))


def cut_from_note(note: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(note, F.lit("")), r"(?i)Cut at\s+(\d+)", 1), F.lit("")).cast("bigint") - 1


def exon_from_note(note: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(note, F.lit("")), r"(?i)exon\s+(\d+)", 1), F.lit("")).cast("int")


def internal_definition(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.struct(internal_site_token(t).alias("site"), cassette_key(t, "it").alias("tag"))


def exon_list(text: Column) -> Column:
    """'a-b, c:d' (1-based) -> array<struct<exon_number,start,end,label>>; bad items keep their number."""
    items = F.split(F.coalesce(text, F.lit("")), "\r?\n|,|;")
    pattern = r"^(\d+)\s*[-:]\s*(\d+)$"
    rows = F.transform(items, lambda t, i: F.struct(
        (i + 1).alias("exon_number"),
        (F.nullif(F.regexp_extract(F.trim(t), pattern, 1), F.lit("")).cast("bigint") - 1).alias("start"),
        F.nullif(F.regexp_extract(F.trim(t), pattern, 2), F.lit("")).cast("bigint").alias("end"),
        F.concat(F.lit("Exon "), (i + 1).cast("string")).alias("label")))
    return F.filter(rows, lambda r: r["start"].isNotNull() & (r["end"] > r["start"] + 1))
