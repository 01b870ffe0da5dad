"""Hand-worked cases of the parity rules and properties of the scan."""

from pyspark.sql import functions as F

from editloom.functions import seq as sq
from editloom.functions.numeric import half_up
from editloom.functions.text import exon_list, parse_requests
from editloom.operators import genome as gn
from editloom.operators import guides as gd


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_half_up_below_zero(spark):
    assert value(spark, half_up(F.lit(-2.5))) == -2
    assert value(spark, half_up(F.lit(-0.25), 1)) == -0.2


def test_reverse_complement_unknown_letters(spark):
    assert value(spark, sq.revcomp(F.lit("ACGTXN"))) == "NNACGT"


def test_exon_list_keeps_numbers(spark):
    rows = value(spark, exon_list(F.lit("1-10, bad\n20:30;9-9")))
    assert [(r.exon_number, r.start, r.end) for r in rows] == [(1, 0, 10), (3, 19, 30)]


def test_sample_lines(spark):
    lines = ["PSEN1 N32R BIHi005-A", "ECSIT knockout BIHi005-A", "SCN5A internal SPOT after P155 BIHi005-A",
             "INS C-terminal SD40-2xHA BIHi005-A", "SORCS1 N-terminal N:EGFP-Linker BIHi005-A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "request_id int, line string")
    rows = {r.request_id: r for r in parse_requests(df).collect()}
    assert [(rows[i].gene, rows[i].project_type) for i in range(5)] == [
        ("PSEN1", "pm"), ("ECSIT", "ko"), ("SCN5A", "it"), ("INS", "ct"), ("SORCS1", "nt")]
    assert (rows[0].mutation, rows[2].mutation, rows[2].tag) == ("N32R", "P155", "SPOT")
    assert (rows[3].tag, rows[4].tag) == ("SD40-2xHA", "N:EGFP-Linker")
    assert rows[1].parse_issue == "" and rows[0].parse_issue == "Needs GenBank"


def test_scan_does_not_depend_on_chunks(spark):
    import random
    rnd = random.Random(3)
    text = "".join(rnd.choice("ACGT") for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "seq_id bigint, seq string")
    got = {(r.ps, r.strand) for r in gn.scan_sequences(df, drop_runs=False).collect()}
    want = {(p, "+") for p in range(2978) if text[p + 21:p + 23] == "GG"} | {(p, "-") for p in range(2978) if text[p:p + 2] == "CC"}
    assert got == want
    small = df.select("seq_id", F.col("seq").alias("bases"), F.lit(0).cast("bigint").alias("bases_start"))
    pieces = gn.chunked(small, size=64, block=512)
    assert pieces.agg(F.sum(F.greatest(F.lit(0), F.least("owned", F.length("bases"))))).first()[0] >= 3000


def test_second_custom_guide_moves_to_its_other_site(spark):
    sites = spark.createDataFrame([
        (1, n, "A" * 20, "TGG", "+", cut, 0, cut - 17) for n in (1, 2) for cut in (100, 120)],
        "request_id int, guide_no int, spacer string, pam string, strand string, cut bigint, gc int, ps bigint").withColumn("target", F.lit(101).cast("bigint"))
    wanted = spark.createDataFrame([(1, 1, "A" * 20), (1, 2, "A" * 20)], "request_id int, guide_no int, spacer string").withColumn("target", F.lit(101).cast("bigint"))
    row = gd.resolve_custom_guides(sites, wanted, 30).first()
    assert row.err is None and [g.cut for g in row.guides] == [100, 120] and row.guide_window == 19


def test_review_items_name_unlike_reporters_and_missing_blocks(spark):
    from editloom.plans import review as rv
    d = spark.createDataFrame([(1, "nt", "X", "g.gb", "note"), (2, "ct", "X", "g.gb", "note"), (3, "it", "Y", "g.gb", "note")],
                              "request_id long, type string, tag string, file_name string, notes string")
    reporters = spark.createDataFrame([(2, 1, "EGFP", False), (2, 2, "mCherry", False), (2, 3, "other", True), (3, 1, "SPOT", False)],
                                      "request_id long, seg_no int, label string, matches boolean")
    segments = spark.createDataFrame([("X", "nt", "Tag"), ("X", "ct", "Tag"), ("X", "ct", "Stop")], "insert_name string, terminus string, label string")
    texts = {}
    for r in rv.review_items(d, reporters, segments).collect():
        texts.setdefault(r.request_id, []).append(r.text)
    assert any("start codon block" in t for t in texts[1]) and not any("stop codon block" in t for t in texts[2])
    assert [t.split()[0] for t in texts[2] if "does not match the designed HDR donor at the protein level" in t] == ["EGFP", "mCherry"]
    assert any(t.startswith("SPOT does not match the designed internal-tag donor") for t in texts[3])
    assert not any("codon block" in t for r in rv.review_items(d).collect() for t in [r.text])


def test_reference_only_knockout_needs_a_reference(spark):
    from editloom.plans import review as rv
    d = spark.createDataFrame([(1, "ko", True, None), (2, "ko", False, None), (3, "ko", True, "~475 bp")],
                              "request_id long, type string, reference_only boolean, amplicon string").withColumns({
        "err": F.lit(None).cast("string"), "guides": F.array(F.struct(F.lit(1).cast("bigint").alias("d")))})
    rows = {r.request_id: r.value for r in rv.snapshot_items(d).where("label = 'Primers'").collect()}
    assert rows == {1: "Needs reference", 2: "Pending", 3: "~475 bp"}


def test_every_genbank_record_is_read(spark):
    from editloom.sources import files as fl
    record = "LOCUS  x\nFEATURES             Location\n     CDS             1..6\nORIGIN\n        1 {}\n//\n"
    texts = spark.createDataFrame([("two.gb", record.format("acgtacgt") + record.format("ttttgggg")), ("one.gb", record.format("cccc").rstrip("/\n"))], "file_name string, text string")
    got = sorted((r.file_name, r.record_no, r.seq) for r in fl.genbank_records(texts).collect())
    assert got == [("one.gb", 0, "CCCC"), ("two.gb", 0, "ACGTACGT"), ("two.gb", 1, "TTTTGGGG")]
    assert fl.genbank_records(texts, first_only=True).count() == 2
    assert sorted(r.seq_id for r in fl.genbank_models(fl.genbank_records(texts)).collect()) == ["one.gb", "two.gb", "two.gb#2"]


def test_folder_readers(spark, tmp_path):
    import json
    from editloom.sources import files as fl
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gb").write_text("ORIGIN\n acgt\n//\n")
    (tmp_path / "in" / "b.txt").write_text("ORIGIN\n tttt\n//\n")
    (tmp_path / "in" / "c.csv").write_text("no")
    assert sorted(r.file_name for r in fl.genbank_folder(spark, str(tmp_path / "in")).collect()) == ["a.gb", "b.txt"]
    (tmp_path / "m").mkdir()
    for i, kind in enumerate(("Knockout", "swap")):
        (tmp_path / "m" / f"{i}.json").write_text(json.dumps({"gene_symbol": f"G{i}", "edit_type": kind, "extra": {"reference_file": "ref.gb"}}, indent=1))
    rows = {r.gene: r for r in fl.manifests(spark, str(tmp_path / "m")).collect()}
    assert rows["G0"].project_type == "ko" and rows["G0"].reference_path.endswith("/m/ref.gb") and rows["G1"].err.startswith("Unsupported edit type")


def test_oligo_measures_ignore_case(spark):
    from editloom.functions.oligo import oligo_quality
    df = spark.createDataFrame([("ACGTTGCATGCAGGTACCAT",), ("acgttgcatgcaggtaccat",), ("ACGTTgcatgcaggtACCAT",)], "s string")
    assert len({r.q for r in df.select(oligo_quality("s").alias("q")).collect()}) == 1
    assert len({tuple(r) for r in df.select(sq.melting_temperature(F.col("s")), sq.gc_percent(F.col("s")), sq.hairpin_run(F.col("s"))).collect()}) == 1
