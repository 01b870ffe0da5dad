"""Reference guides: library and off-target database lookups, tier fallback and reference guide pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import norm
from ..functions.frame import broadcast_if_small
from ..functions.numeric import number_text, truthy
from ..functions.seq import gc_percent_int
from ..functions.text import exon_from_note
from ..session import staging_folder
from ..sources.dims import tier_table

UNKNOWN = 2**53 - 1


# --- guide library -------------------------------------------------------------------------------

def top_library_guides(library: DataFrame, keep: int = 3) -> DataFrame:
    """Best guides per gene: score down, exon (as text) up, spacer up, input order.

    ``row_number() <= keep`` lets Spark cut each task's rows to ``keep`` per gene before the shuffle, so a
    gene with very many guides does not gather in one task."""
    tie = [F.col("line_id")] if "line_id" in library.columns else []
    w = Window.partitionBy("gene").orderBy(F.col("rule_set2").desc(), F.col("exon").asc(), F.col("spacer").asc(), *tie)
    return library.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def library_gene(requested: Column) -> Column:
    out = requested
    for name, used in fx.LIBRARY_GENE_ALIASES.items():
        out = F.when(requested == name, used).otherwise(out)
    return out


def lookup_library(genes: DataFrame, library: DataFrame, gene: str = "gene") -> DataFrame:
    """One row per requested gene and guide; genes without guides keep one row with total_guides 0."""
    asked = genes.withColumn("requested_gene", norm.gene_query(F.col(gene))).where("requested_gene <> ''")
    asked = asked.withColumn("library_gene", library_gene(F.col("requested_gene")))
    asked = asked.select("requested_gene", "library_gene").distinct()
    names = broadcast_if_small(asked.select(F.col("library_gene").alias("gene")).distinct())
    top = top_library_guides(library.join(names, "gene", "left_semi")).withColumnRenamed("gene", "library_gene")
    total = F.count("rank").over(Window.partitionBy("requested_gene"))
    out = asked.join(top, "library_gene", "left")
    return out.withColumns({"total_guides": total, "note": F.when(F.col("rank").isNull(), fx.LIBRARY_NONE_NOTE).otherwise("")})


# --- off-target database -------------------------------------------------------------------------

def match_genes(results: DataFrame) -> DataFrame:
    """Search results (query, pos, id, symbol, ensembl_id) -> one gene per query: equal symbol, else equal
    Ensembl id, else the first result."""
    q = norm.gene_query(F.col("query"))
    kind = (F.when(norm.gene_query(F.col("symbol")) == q, 1).when(norm.gene_query(F.col("ensembl_id")) == q, 2)
            .otherwise(3))
    df = results.withColumns({"query": q, "_k": kind})
    w = Window.partitionBy("query").orderBy("_k", "pos")
    names = F.when(F.col("_k") == 1, "symbol").when(F.col("_k") == 2, "ensembl").otherwise("first")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("match_kind", names).drop("_r", "_k")


def best_cds_percent(percentages: Column) -> Column:
    """Value closest to 27.5, from 5-50 when there is one in that range."""
    nearest = lambda a: F.array_min(F.transform(a, lambda v, i: F.struct(
        F.abs(v - 27.5).alias("far"), i.alias("i"), v.alias("v"))))["v"]
    inside = F.filter(percentages, lambda v: (v >= 5) & (v <= 50))
    return F.when(F.size(inside) > 0, nearest(inside)).otherwise(nearest(percentages))


def off_target(counts: Column, i: int) -> Column:
    return F.coalesce(F.get(counts, F.lit(i)).cast("bigint"), F.lit(UNKNOWN))


def summarize_targets(targets: DataFrame) -> DataFrame:
    """Derived columns of target records: spacer, PAM, location, best CDS percentage, counts."""
    full = F.upper(F.coalesce("sequence", F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    percents = F.filter(F.map_values("cds_percentages"), lambda v: v.isNotNull() & ~F.isnan(v))
    return targets.withColumns({
        "full_sequence": full, "spacer": F.left(full, F.lit(20)), "pam": F.substr(full, F.lit(21)),
        "location": F.when(truthy(F.col("chromosome")) & truthy(F.col("position")), F.concat(
            text("chromosome"), F.lit(":"), text("position"), F.lit(":"), text("strand"))).otherwise(""),
        "best_cds": best_cds_percent(percents), "transcript_count": F.size(percents),
        "off0": off_target(F.col("offtarget_counts"), 0), "off1": off_target(F.col("offtarget_counts"), 1),
        "off2": off_target(F.col("offtarget_counts"), 2)})


def target_order() -> list[Column]:
    far = F.coalesce(F.abs(F.col("best_cds") - 27.5), F.lit(float(UNKNOWN)))
    return [F.col("off0"), F.col("off1"), F.col("off2"), F.coalesce("coverage", F.lit(0)).desc(),
            F.coalesce("oof_score", F.lit(0.0)).desc(), far, F.col("id")]


def with_filter_tier(targets: DataFrame, gene: str = "gene") -> DataFrame:
    """Smallest filter tier a target passes (1 strict, 2 balanced, 3 broad; null for none).

    The database site evaluates its filters itself; here they are defined on the table: a maximum-coverage
    target ties with the highest coverage of its gene, a T-repeat is TTTT in the spacer, GC is taken from the
    spacer, unknown off-target counts fail a limit. The tiers are nested, so one number per row is enough.
    """
    top = targets.groupBy(gene).agg(F.max("coverage").alias("_top"))
    df = targets.join(top, gene)
    tier = F.lit(None).cast("int")
    for no, top_only, test in reversed(_tier_tests()):
        tier = F.when(test & (F.col("coverage") == F.col("_top")) if top_only else test, no).otherwise(tier)
    return df.withColumn("tier", tier).drop("_top")


def _tier_tests() -> list[tuple[int, bool, Column]]:
    """(tier, needs the gene's highest coverage too, test of the row alone), strictest first."""
    cds = lambda lo, hi: F.exists(F.map_values("cds_percentages"), lambda v: (v >= lo) & (v <= hi))
    common = gc_percent_int(F.col("spacer")).between(20, 80) & ~F.contains("spacer", F.lit("TTTT"))
    out = []
    for no, _, _, m0, m1, m2, top_only, oof, lo, hi in fx.FILTER_TIERS:
        test = common
        if m0 is not None:
            test = test & (F.col("off0") <= m0) & (F.col("off1") <= m1) & (F.col("off2") <= m2)
        if oof is not None:
            test = test & (F.col("oof_score") >= oof) & cds(lo, hi)
        out.append((no, top_only, test))
    return out


def first_tier_targets(targets: DataFrame, keep: int = 3) -> DataFrame:
    """Best targets of the first tier that has any, per gene, with tier, rank and total_targets, from one read of ``targets``.

    What the tiers need of a row alone is computed once and staged. Counts per gene and coverage give, at the highest coverage,
    how many targets the tiers bound to it have, so the first tier of a gene is known without a second look at its rows: as the
    tiers are nested, a tier that is first holds all rows that pass its own test."""
    tests = _tier_tests()
    passed = {f"_p{no}": F.coalesce(test, F.lit(False)) for no, _, test in tests}
    path = staging_folder(targets.sparkSession, "lookup-targets")
    targets.withColumns(passed).write.parquet(path)
    rows = targets.sparkSession.read.parquet(path)
    counts = rows.groupBy("gene", "coverage").agg(*[F.count_if(p).alias(p) for p in passed])
    total = lambda no, top_only: F.coalesce(F.max_by(f"_p{no}", "coverage"), F.lit(0)) if top_only else F.sum(f"_p{no}")
    gene = counts.groupBy("gene").agg(F.max("coverage").alias("_top"), *[total(no, top_only).alias(f"_n{no}") for no, top_only, _ in tests])
    tier = F.coalesce(*[F.when(F.col(f"_n{no}") > 0, F.struct(F.lit(no).alias("tier"), F.col(f"_n{no}").alias("n"))) for no, _, _ in tests])
    first = gene.withColumn("_t", tier).where("_t is not null").select("gene", "_top", F.col("_t.tier").alias("tier"), F.col("_t.n").alias("total_targets"))
    inside = F.lit(False)
    for no, top_only, _ in tests:
        own = F.col(f"_p{no}") & (F.col("coverage") == F.col("_top")) if top_only else F.col(f"_p{no}")
        inside = F.when(F.col("tier") == no, own).otherwise(inside)
    w = Window.partitionBy("gene").orderBy(*target_order())
    best = rows.join(first, "gene").where(inside).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return best.drop("_top", *passed)


def best_tier_targets(targets: DataFrame, gene: str = "gene", keep: int = 3) -> DataFrame:
    """Top targets of the first tier that has any, per gene (needs ``tier``)."""
    w = Window.partitionBy(gene).orderBy(F.col("tier"), *target_order())
    ranked = targets.where("tier is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    first = F.min("tier").over(Window.partitionBy(gene))
    return ranked.withColumn("_t", first).where("tier = _t").drop("_t")


def tier_counts(targets: DataFrame, gene: str = "gene") -> DataFrame:
    """Chosen tier per gene and how many targets it has (nested tiers: rows of the smallest tier only)."""
    per = targets.where("tier is not null").groupBy(gene, "tier").agg(F.count(F.lit(1)).alias("total_targets"))
    return per.groupBy(gene).agg(F.min(F.struct("tier", "total_targets")).alias("s")).select(gene, "s.tier", "s.total_targets")


def lookup_targets(requests: DataFrame, gene_table: DataFrame, targets: DataFrame) -> DataFrame:
    """Requested genes -> ranked targets with tier and note; a gene or target that is missing gives one row.

    ``gene_table``: gene (normalised symbol, unique). ``targets``: summarised records."""
    spark = targets.sparkSession
    asked = requests.select(norm.gene_query(F.col("gene")).alias("gene_query")).where("gene_query <> ''").distinct()
    names = broadcast_if_small(asked.select(F.col("gene_query").alias("gene")))
    best = first_tier_targets(targets.join(names, "gene", "left_semi")).join(F.broadcast(tier_table(spark).select("tier", "tier_id", "tier_label")), "tier")
    known = gene_table.select(F.col("gene").alias("gene_query"), F.lit(True).alias("known")).distinct()
    out = asked.join(known, "gene_query", "left").join(best.withColumnRenamed("gene", "gene_query"), "gene_query", "left")
    note = (F.when(F.col("known").isNull(), fx.TARGETS_NO_GENE_NOTE).when(F.col("rank").isNull(), fx.TARGETS_NONE_NOTE)
            .when(F.col("tier_id") == "strict", fx.TARGETS_STRICT_NOTE)
            .otherwise(F.concat(F.lit("Results required the "), F.lower("tier_label"),
                                F.lit(" because the stricter filters returned no targets."))))
    return out.withColumns({"note": note, "total_targets": F.coalesce("total_targets", F.lit(0).cast("bigint"))})


# --- guide overrides and reference pairs ----------------------------------------------------------

def library_override(guides: DataFrame) -> DataFrame:
    """Library rows in the form of design guides: sp, pm, str, gc, cut (0-based), detail."""
    transcript = F.col("transcript") if "transcript" in guides.columns else F.lit("")
    return guides.withColumns({
        "gc": gc_percent_int(F.col("spacer")), "cut": F.col("cut_position").cast("bigint") - 1,
        "detail": norm.library_detail(F.col("rule_set2"), F.col("exon"), transcript)})


def target_override(targets: DataFrame) -> DataFrame:
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("off0", "off1", "off2")])
    return targets.withColumns({
        "gc": gc_percent_int(F.col("spacer")), "cut": F.lit(None).cast("bigint"),
        "detail": norm.target_detail(F.coalesce("oof_score", F.lit(0.0)), counts, F.col("location"))})


def reference_pairs(guides: DataFrame, source: str, has_reference: bool) -> DataFrame:
    """Pairs of the top three reference guides of a request with their review mode.

    ``guides``: request_id, rank, detail, cut and, for remapped guides, context_label/context_detail.
    Modes: nearby, local, deletion-screen, cross-exon, reference-only, unresolved."""
    g = guides.where(F.col("rank") <= 3)
    names = [c for c in ("detail", "cut", "context_label", "context_detail", "spacer") if c in g.columns]
    left = g.select("request_id", F.col("rank").alias("i"), *[F.col(c).alias("l_" + c) for c in names])
    right = g.select("request_id", F.col("rank").alias("j"), *[F.col(c).alias("r_" + c) for c in names])
    p = left.join(right, "request_id").where("i < j")
    if has_reference:
        spacing = F.abs(F.col("r_cut") - F.col("l_cut"))
        note = lambda s: norm.knockout_guide_note(F.col(s + "_cut"), F.col(s + "_context_label"),
                                                  F.col(s + "_context_detail"), spacing, F.col(s + "_detail"))
    else:
        spacing = F.lit(None).cast("bigint")
        note = lambda s: F.concat(F.col(s + "_detail"), F.lit(
            " | Reference-only KO mode. Upload GenBank to calculate pair spacing and centered primers."))
    p = p.withColumns({"spacing": spacing, "l_note": note("l"), "r_note": note("r")})
    p = p.withColumns({"l_exon": exon_from_note(F.col("l_note")), "r_exon": exon_from_note(F.col("r_note")),
                       "l_src": exon_from_note(F.col("l_detail")), "r_src": exon_from_note(F.col("r_detail"))})
    both = F.col("l_exon").isNotNull() & F.col("r_exon").isNotNull()
    same = F.coalesce(F.col("l_exon") == F.col("r_exon"), F.lit(False)) | (
        (F.col("l_exon").isNull() != F.col("r_exon").isNull()))
    known = F.col("spacing").isNotNull()
    mode = (F.when(F.lit(not has_reference), "reference-only")
            .when(same & F.col("spacing").between(40, 140), "nearby").when(same & known, "local")
            .when(F.col("spacing") > fx.LONG_DELETION, "deletion-screen").when(known & ~same, "cross-exon")
            .otherwise("unresolved"))
    src_same = F.coalesce(F.col("l_src") == F.col("r_src"), F.lit(False))
    src_gap = F.coalesce(F.abs(F.col("r_src") - F.col("l_src")).cast("bigint"), F.lit(UNKNOWN))
    label = (F.when(both & (F.col("l_exon") != F.col("r_exon")), F.concat(
        F.lit("Exon "), F.col("l_exon").cast("string"), F.lit(" -> Exon "), F.col("r_exon").cast("string"))))
    ident = F.concat(F.lit(source + "-"), F.col("i").cast("string"), F.lit("-"), F.col("j").cast("string"))
    return p.withColumns({"id": ident, "source": F.lit(source), "same_exon": same, "mode": mode, "source_same_exon": src_same,
                          "source_exon_gap": src_gap, "exon_path": label})


def rank_reference_pairs(pairs: DataFrame, keep: int = 3, fix_priority: bool = False) -> DataFrame:
    """Included pairs, best first. By default 'nearby' ranks after all other modes, as the established
    ranking does (its priority 0 is read as missing); ``fix_priority`` puts it first."""
    order = F.when(F.col("mode") == "nearby", F.lit(0 if fix_priority else 9)).when(F.col("mode") == "local", 1).when(
        F.col("mode") == "cross-exon", 2).when(F.col("mode") == "deletion-screen", 3).otherwise(4)
    ref = F.col("mode") == "reference-only"
    w = Window.partitionBy("request_id", "source").orderBy(
        order, F.when(ref & ~F.col("source_same_exon"), 1).otherwise(0), F.when(ref, F.col("source_exon_gap")).otherwise(0),
        F.coalesce(F.abs(F.col("spacing") - 90), F.lit(UNKNOWN)), "id")
    return pairs.where("mode <> 'unresolved'").withColumn("pair_rank", F.row_number().over(w)).where(F.col("pair_rank") <= keep)


def filtered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that are not shown, with the reason."""
    reason = (F.when(F.col("spacing").isNull(), "Could not remap both guides cleanly onto the selected reference.")
              .otherwise("This pair did not survive remapping onto the selected reference."))
    return pairs.where("mode = 'unresolved'").withColumn("reason", reason)


def prefer_source(requests: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Best pair of the first source, else of the second, else an error row.

    ``first``/``second``: request_id with pair columns, at most one row each per request."""
    a = first.withColumn("_p", F.lit(1))
    b = second.withColumn("_p", F.lit(2))
    w = Window.partitionBy("request_id").orderBy("_p")
    best = a.unionByName(b, allowMissingColumns=True).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")
    out = requests.join(best, "request_id", "left")
    return out.withColumn("error", F.when(F.col("id").isNull(), F.concat(
        F.lit("No Brunello or Cas-Database guide pair was available for "), F.col("gene"), F.lit("."))))


def reference_only_designs(pairs: DataFrame) -> DataFrame:
    """Knockout shortlist of a chosen reference pair: exon text, strategy, no primers."""
    l, r = F.col("l_exon"), F.col("r_exon")
    one = (l == r) | (l.isNull() != r.isNull())
    return pairs.withColumns({
        "exon": F.when(F.coalesce(one, F.lit(False)), F.concat(
            F.lit("Reference exon shortlist: exon "), F.coalesce(l, r).cast("string"))).otherwise("Reference-only KO shortlist"),
        "amp": F.lit("n/a"), "reference_only": F.lit(True),
        "strategy": F.concat(F.col("source"), F.lit(
            " reference-guide shortlist; upload GenBank to calculate pair spacing and centered primers."))})
