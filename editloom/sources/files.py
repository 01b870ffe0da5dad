"""File sources: library tables, JSON dumps, GenBank folders, manifests, request and definition texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import norm
from ..functions import text as tx
from ..functions.numeric import truthy
from ..session import staging_folder
from .models import finish_model

# Column names of the guide-library table.
LIBRARY_COLUMNS = {
    "Target Gene Symbol": "gene", "sgRNA Target Sequence": "spacer", "PAM Sequence": "pam", "Exon Number": "exon",
    "Rule Set 2 score": "rule_set2", "Target Transcript": "transcript", "Strand": "strand",
    "Position of Base After Cut (1-based)": "cut_position", "Genomic Sequence": "genomic_sequence",
}


def guide_library(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated library; columns are found by header name, rows without gene or spacer are dropped."""
    raw = spark.read.csv(path, sep="\t", header=True, enforceSchema=False)
    col = lambda name: F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in raw.columns else F.lit("")
    number = lambda name, kind: F.coalesce(F.nullif(col(name), F.lit("")).cast(kind), F.lit(0).cast(kind))
    out = {new: col(old) for old, new in LIBRARY_COLUMNS.items()}
    for name in ("gene", "spacer", "pam"):
        out[name] = F.upper(out[name])
    out["rule_set2"] = number("Rule Set 2 score", "double")
    out["cut_position"] = number("Position of Base After Cut (1-based)", "bigint")
    return raw.select(*[c.alias(n) for n, c in out.items()]).where("gene <> '' and spacer <> ''")


TARGET_SCHEMA = ("gene string, targets array<struct<id:bigint,sequence:string,chromosome:string,position:string,strand:string,"
                 "oof_score:double,coverage:double,gc_contents:double,cds_percentages:map<string,double>,"
                 "offtarget_counts:array<bigint>>>")


def target_dump(spark: SparkSession, path: str) -> DataFrame:
    """Off-target dump, one JSON object per gene with its list of targets."""
    return spark.read.schema(TARGET_SCHEMA).json(path).select(norm.gene_query(F.col("gene")).alias("gene"), F.inline("targets"))


_REPORTER = ("struct<id:string,uuid:string,name:string,label:string,protein:string,slug:string,seq:string,sequence:string,aa_seq:string,"
             "genbank:string,genbank_accession:string,uniprot:string,url:string,absolute_url:string,link:string,ex_max:string,"
             "default_state__ex_max:string,em_max:string,default_state__em_max:string,brightness:string,"
             "default_state__brightness:string,qy:string,default_state__qy:string,ext_coeff:string,default_state__ext_coeff:string,"
             "pka:string,default_state__pka:string,agg:string,status:string,parent_organism:string,organism:string>")


def reporter_pages(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue pages, one JSON payload per line with a page number: either an object with ``results`` or a
    bare array. Adds page and pos (order inside the page)."""
    raw = spark.read.schema("page int, payload string").json(path)
    listed = F.from_json("payload", f"array<{_REPORTER}>")
    wrapped = F.from_json("payload", f"struct<count:bigint,next:string,results:array<{_REPORTER}>>")["results"]
    rows = F.when(F.startswith(F.ltrim("payload"), F.lit("[")), listed).otherwise(wrapped)
    return raw.select("page", F.posexplode(F.coalesce(rows, F.array())).alias("pos", "r")).select("page", "pos", "r.*")


HITS_SCHEMA = ("primer_id string, sequence string, search struct<query_len:int,hits:array<struct<description:array<struct<accession:string,"
               "id:string,title:string>>,hsps:array<struct<query_from:int,query_to:int,hit_from:bigint,hit_to:bigint,identity:int,"
               "align_len:int,gaps:int,qseq:string,hseq:string,hit_strand:string>>>>>")


def alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignment searches flattened to one row per high-scoring pair; only the first description counts."""
    raw = spark.read.schema(HITS_SCHEMA).json(path)
    hits = raw.select("primer_id", F.coalesce("search.query_len", F.length("sequence"), F.lit(0)).alias("query_len"),
                      F.posexplode("search.hits").alias("hit_no", "hit"))
    first = F.get("hit.description", F.lit(0))
    return hits.select("primer_id", "query_len", "hit_no", norm.first_filled(first["accession"], first["id"]).alias("accession"),
                       F.coalesce(first["title"], F.lit("")).alias("title"), F.posexplode("hit.hsps").alias("hsp_no", "h")).select(
        "primer_id", "query_len", "hit_no", "hsp_no", "accession", "title", "h.*")


HISTORY_SCHEMA = ("projectId string, parentalLine string, species string, tool string, guideSpecies string, targetGene string, "
                  "targetGeneId string, donorType string, donorName string, donorSequence string, establishedLine string, "
                  "receivedFrom string, modificationType string, modificationClass string, modificationDescription string, "
                  "zygosity string, registrationDate string, hazardPotential string, diseaseModel string, successStatus string, "
                  "guides array<struct<name:string,sequence:string>>")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Project history records (JSON lines), columns in snake case, registration date as a date."""
    raw = spark.read.schema(HISTORY_SCHEMA).json(path)
    snake = lambda n: "".join("_" + c.lower() if c.isupper() else c for c in n)
    out = raw.select(*[F.col(c).alias(snake(c)) for c in raw.columns])
    return out.withColumn("registration_date", F.to_date("registration_date"))


# --- GenBank -------------------------------------------------------------------------------------

GENBANK_FILES = "*.{gb,gbk,genbank,txt,GB,GBK,GENBANK,TXT}"
FEATURE = "struct<type:string,loc:string,q:array<struct<k:string,v:string>>,last:string>"


def _rest(items: Column) -> Column:
    """All items but the first."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _parse_feature(block: Column) -> Column:
    """One feature block (its lines) -> struct(type, loc, q). Qualifiers are /name="value"; a continued line
    belongs to the location until that has a closing bracket, then to the last qualifier."""
    rows = F.split(block, "\n")
    head = F.split(F.trim(F.get(rows, F.lit(0))), r"\s+")
    start = F.struct(F.get(head, F.lit(0)).alias("type"), F.array_join(_rest(head), "").alias("loc"),
                     F.array().cast("array<struct<k:string,v:string>>").alias("q"), F.lit("").alias("last")).cast(FEATURE)
    pattern = r'^/(\w+)=?"?([^"]*)"?$'

    def step(acc, line):
        body = F.trim(line)
        indented = line.rlike(r"^\s{21}")
        qualifier = line.rlike(r"^\s{21}/")
        found = qualifier & body.rlike(pattern)
        key = F.regexp_extract(body, pattern, 1)
        more_loc = line.rlike(r"^\s{21}[^/]") & ~F.contains(acc["loc"], F.lit(")"))
        more_text = indented & ~qualifier & ~more_loc & (acc["last"] != "")
        added = F.concat(acc["q"], F.array(F.struct(key.alias("k"), F.regexp_extract(body, pattern, 2).alias("v"))))
        extended = F.transform(acc["q"], lambda e, i: F.struct(e["k"].alias("k"), F.when(
            i == F.size(acc["q"]) - 1, F.concat(e["v"], F.replace(body, F.lit('"'), F.lit("")))).otherwise(e["v"]).alias("v")))
        return F.struct(
            acc["type"].alias("type"), F.when(more_loc, F.concat(acc["loc"], body)).otherwise(acc["loc"]).alias("loc"),
            F.when(found, added).when(more_text, extended).otherwise(acc["q"]).alias("q"),
            F.when(found, key).otherwise(acc["last"]).alias("last")).cast(FEATURE)

    return F.aggregate(_rest(rows), start, step)


def genbank_records(files: DataFrame, first_only: bool = False) -> DataFrame:
    """Whole GenBank texts (file_name, text) -> file_name, record_no, seq, features array<struct<type,loc,q>>.

    One row per record of a file (records end at a line of two slashes), or the first record of each file only. A file
    is one row in, so no shuffle is needed."""
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    texts = F.split(clean, "(?m)^//[^\n]*\n?")
    wanted = F.slice(texts, 1, 1) if first_only else F.filter(texts, lambda t, i: (i == 0) | t.rlike(r"\S"))
    return _parsed(files.select("*", F.posexplode(wanted).alias("record_no", "_body"))).select("file_name", "record_no", "seq", "features")


def _parsed(bodies: DataFrame) -> DataFrame:
    """Replace the text of one record (``_body``) by seq and features."""
    keep = [c for c in bodies.columns if c != "_body"]
    parts = F.split("_body", "(?m)^ORIGIN[^\n]*\n?", 2)
    df = bodies.select(*keep, F.get(parts, F.lit(0)).alias("_head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("_origin"))
    table = F.get(F.split("_head", "(?m)^FEATURES[^\n]*\n", 2), F.lit(1))
    blocks = F.filter(F.split(table, "\n(?= .{4}[^ \n])"), lambda b: b.rlike("^ .{4}[^ \n]"))
    features = F.transform(F.coalesce(blocks, F.array().cast("array<string>")), _parse_feature)
    return df.select(*keep, F.upper(F.regexp_replace("_origin", "[^a-zA-Z]", "")).alias("seq"), F.transform(
        features, lambda f: F.struct(f["type"].alias("type"), f["loc"].alias("loc"), f["q"].alias("q"))).alias("features"))


def read_genbank(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """Records of all GenBank files of a folder, as ``genbank_records`` gives them from whole texts, but read by record: a line of
    two slashes separates rows of the text reader, so a file of any size is split over many tasks and no row holds a file.

    Records are parsed once and staged with their split; the number of a record in its file is that of the splits before it (one
    row per split) plus its place in its own. A first line that opens the features or the sequence is taken as such; any other
    first line of a record is not read. An empty record before a separator on the first line of a file is counted, not returned."""
    raw = spark.read.option("lineSep", "\n//").text(path, pathGlobFilter=GENBANK_FILES, recursiveFileLookup=True)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    rows = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"), name.alias("file_name"), F.col("value"))
    clean = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r", "\n")
    body = F.regexp_replace(clean, r"\A(?!FEATURES|ORIGIN)[^\n]*\n?", "")
    rows = rows.select("_path", "_split", "file_name", F.startswith("value", F.lit("//")).alias("_lead"), F.explode(F.split(body, "(?m)^//[^\n]*\n?")).alias("_body"))
    rows = rows.withColumns({"_blank": ~F.col("_body").rlike(r"\S"), "_n": F.monotonically_increasing_id()})
    folder = staging_folder(spark, "genbank")
    parsed = _parsed(rows)
    parsed.write.parquet(folder)
    parsed = spark.read.schema(parsed.schema).parquet(folder)
    splits = parsed.groupBy("_path", "_split").agg(F.min("_n").alias("_first"), F.count_if(~F.col("_blank")).alias("_kept"), F.min_by("_blank", "_n").alias("_fb"),
                                                   F.min_by("_lead", "_n").alias("_fl"), F.array_sort(F.collect_list(F.when(F.col("_blank"), F.col("_n")))).alias("_blanks"))
    # A blank record counts only as the first of its file; so does what stands before a separator on the first line.
    order = Window.partitionBy("_path").orderBy("_split")
    head = F.first(F.when(F.col("_split") == 0, F.col("_fb").cast("int") + F.col("_fl").cast("int")).otherwise(0)).over(order)
    before = F.coalesce(F.sum("_kept").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_split", "_first", "_blanks", (before + head).alias("_before"))
    out = parsed.join(splits, ["_path", "_split"])
    opens = (F.col("_split") == 0) & (F.col("_n") == F.col("_first"))
    place = F.col("_n") - F.col("_first") - F.size(F.filter("_blanks", lambda b: b < F.col("_n")))
    number = F.when(opens & F.col("_blank"), 0).otherwise(F.col("_before") + place).cast("int")
    out = out.where(~F.col("_blank") | opens).select("file_name", number.alias("record_no"), "seq", "features")
    return out.where("record_no = 0") if first_only else out


def _ranges(loc: Column) -> Column:
    """Number pairs of a location (1-based) as array<struct<start,end>>; strand words are ignored."""
    nums = F.regexp_extract_all(loc, F.lit(r"(\d+)"), F.lit(1))
    pairs = F.floor(F.size(nums) / 2).cast("int")
    return F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(
        (F.get(nums, i * 2).cast("bigint") - 1).alias("start"), F.get(nums, i * 2 + 1).cast("bigint").alias("end")))).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _qualifier(feature: Column, key: str) -> Column:
    hits = F.filter(feature["q"], lambda e: e["k"] == key)
    return F.nullif(F.get(hits, F.size(hits) - 1)["v"], F.lit(""))


def genbank_models(records: DataFrame) -> DataFrame:
    """Parsed records -> models; records without sequence or CDS ranges are left out. Later records of a file are named file#2, file#3."""
    of = lambda *types: F.filter("features", lambda f: f["type"].isin(*types))
    gene, mrna = F.get(of("gene"), F.lit(0)), F.get(of("mRNA", "transcript"), F.lit(0))
    cds = F.get(F.filter(F.transform(of("CDS"), lambda f: _ranges(f["loc"])), lambda r: F.size(r) > 0), F.lit(0))

    def exon(f, i):
        label = F.coalesce(_qualifier(f, "label"), F.concat(F.lit("Exon "), (i + 1).cast("string")))
        number = F.nullif(F.regexp_extract(label, r"(?i)Exon\s+(\d+)", 1), F.lit("")).cast("int")
        r = F.get(_ranges(f["loc"]), F.lit(0))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.coalesce(number, i + 1).alias("exon_number"), label.alias("label"))

    df = records.select(
        F.when(F.col("record_no") == 0, F.col("file_name")).otherwise(F.concat("file_name", F.lit("#"), F.col("record_no") + 1)).alias("seq_id"),
        F.coalesce(_qualifier(gene, "label"), _qualifier(gene, "gene"), F.lit("Gene")).alias("gene"),
        F.coalesce(_qualifier(mrna, "transcript_id"), _qualifier(mrna, "label"), _qualifier(mrna, "gene"), F.lit("")).alias("transcript_id"),
        F.lit("").alias("assembly"), F.lit("genbank").alias("source"), "seq", cds.alias("segs"),
        F.transform(of("exon"), exon).alias("exons"))
    return finish_model(df.where(F.col("segs").isNotNull()))


def genbank_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .gb, .gbk, .genbank and .txt files of a folder as (file_name, text)."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=GENBANK_FILES, recursiveFileLookup=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("file_name"), F.col("value").alias("text"))


# --- manifests and request texts -----------------------------------------------------------------

MANIFEST_SCHEMA = ("gene_symbol string, ensembl_id string, mutation string, edit_type string, species string, cell_line string, "
                   "extra struct<reference_file:string,tag:string,homology_arm_length:string,custom_guides:string,"
                   "design_options:map<string,string>>")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Design manifests (one JSON document per file) -> request columns; an unknown edit type gives ``err``."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return manifest_requests(raw.select("*", F.col("_metadata.file_path").alias("manifest")))


def manifest_requests(raw: DataFrame) -> DataFrame:
    """Manifest records with their file path (``manifest``) -> request columns."""
    folder = F.regexp_replace("manifest", "/[^/]*$", "")
    ref = F.col("extra.reference_file")
    kind = norm.manifest_edit_class(F.col("edit_type"))
    guides = F.from_json("extra.custom_guides", "array<string>")
    return raw.select(
        "manifest", kind.alias("project_type"), F.coalesce("gene_symbol", F.lit("")).alias("gene"), F.coalesce("ensembl_id", F.lit("")).alias("ensembl_id"),
        F.coalesce("mutation", F.lit("")).alias("mutation"), F.coalesce("cell_line", F.lit("")).alias("cell_line"), "edit_type",
        F.coalesce("extra.tag", F.lit("")).alias("tag"),
        F.coalesce(F.nullif("extra.homology_arm_length", F.lit("")).cast("int"), F.lit(400)).alias("homology_arm"),
        F.when(F.startswith(F.ltrim("extra.custom_guides"), F.lit("[")), guides).alias("custom_guides"),
        F.col("extra.design_options").alias("design_options"),
        F.when(truthy(ref), F.when(F.startswith(ref, F.lit("/")), ref).otherwise(F.concat(folder, F.lit("/"), ref))).alias("reference_path"),
        F.when(kind.isNull(), F.concat(F.lit("Unsupported edit type: "), F.coalesce("edit_type", F.lit("")))).alias("err"))


def request_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts -> their non-empty lines with the 0-based line_index."""
    out = texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_index", "line"))
    return out.where(F.trim("line") != "")


def batch_definitions(texts: DataFrame, text: str = "text") -> DataFrame:
    """Definition texts (file, type, modification, arm, label; tab or comma) -> one row per definition line."""
    keys = [c for c in texts.columns if c != text]
    rows = texts.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("_i", "_l")).withColumn("_l", F.trim("_l"))
    rows = rows.where((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
    cells = F.transform(F.when(F.contains("_l", F.lit("\t")), F.split("_l", "\t")).otherwise(F.split("_l", ",")), lambda c: F.trim(c))
    rows = rows.withColumn("_c", cells)
    header = (F.col("_i") == 0) & F.lower(F.get("_c", F.lit(0))).isin("file", "filename", "genbank")
    cell = lambda i: F.coalesce(F.get("_c", F.lit(i)), F.lit(""))
    return rows.where(~header).select(
        *keys, (F.col("_i") + 1).alias("line_number"), cell(0).alias("file_token"), norm.batch_edit_class(cell(1)).alias("project_type"),
        cell(2).alias("modification"), cell(3).alias("homology_arm"), cell(4).alias("label"))


def folder_requests(folders: DataFrame, name: str = "name") -> DataFrame:
    """Project folder names -> request rows; 'Template' and 'Orders' are not projects."""
    df = folders.where(~F.col(name).isin("Template", "Orders")).withColumn("_title", norm.folder_title(F.col(name)))
    named = df.withColumn("_given", F.col(name)).drop(name)
    parsed = tx.parse_requests(named, "_title")
    return parsed.withColumns({"project_no": norm.project_number(F.col("_given")), "parent_no": norm.parent_number(F.col("_given")),
                               "project_folder": F.col("_given")}).drop("_given", "_title")
