"""Inputs that one task must not hold: files of many records, chromosome-size sequences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from editloom.operators import genome as gn
from editloom.sources import files as fl


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def record(i, end="\n"):
    body = [f"LOCUS       R{i}", "FEATURES             Location/Qualifiers", "     gene            1..60", f'                     /gene="G{i}"',
            f"     CDS             join(1..{i % 30 + 3},", "                     40..60)", "ORIGIN", f"        1 {'acgtacgtac' * 6}", "//"]
    return end.join(body) + end


@pytest.mark.parametrize("case", ["plain", "crlf", "cr", "blanks", "leading", "open end", "no end"])
def test_records_are_read_by_split(spark, tmp_path, small_splits, case):
    rng = random.Random(4)
    end = {"crlf": "\r\n", "cr": "\r"}.get(case, "\n")
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a.gb", 150), ("b.txt", 1), ("c.gbk", 40)):
        parts = [record(i, end) + (rng.choice(["", "//\n", "\n \n//\n"]) if case == "blanks" else "") for i in range(n)]
        text = ("//\n" if case == "leading" else "") + "".join(parts)
        text = text[:-1] if case == "open end" else text[:-3] if case == "no end" else text
        (folder / name).write_bytes(text.encode())
    (folder / "skip.csv").write_text("x")
    want = [r for r in fl.genbank_records(fl.genbank_folder(spark, str(folder))).collect() if case != "leading" or r["seq"]]
    got = fl.read_genbank(spark, str(folder)).collect()
    key = lambda r: (r["file_name"], r["record_no"], r["seq"], str(r["features"]))
    # The empty record before a leading separator is counted in both, and returned by the whole-file parser only.
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) >= 190
    if case != "cr":
        raw = spark.read.option("lineSep", "\n//").text(str(folder), pathGlobFilter="a.gb")
        assert raw.rdd.getNumPartitions() > 5
    assert fl.read_genbank(spark, str(folder), first_only=True).count() == (0 if case == "leading" else 3)


def brute_sites(seq):
    out = set()
    for m in re.finditer(r"(?=([ACGT]{20}[ACGT]GG))", seq):
        out.add((m.start(), "+", m.group(1)[:20]))
    flip = str.maketrans("ACGT", "TGCA")
    for m in re.finditer(r"(?=(CC[ACGT][ACGT]{20}))", seq):
        out.add((m.start(), "-", m.group(1)[3:].translate(flip)[::-1]))
    return {s for s in out if "TTTTT" not in s[2] and "AAAAA" not in s[2]}


def test_one_long_sequence_is_shared(spark, tmp_path):
    rng = random.Random(9)
    long = "".join(rng.choices("ACGT", k=900_000))
    edge = "".join(rng.choices("ACGT", k=gn.TILE))
    df = spark.createDataFrame([("long", long), ("edge", edge), ("edge1", edge + "G"), ("short", long[:500]), ("tiny", "ACGT"), ("none", "")], "seq_id string, seq string")
    df = df.withColumn("seq_len", F.length("seq"))
    sites = gn.scan_sequences(df).withColumn("task", F.spark_partition_id()).collect()
    for name, seq in (("long", long), ("edge", edge), ("edge1", edge + "G"), ("short", long[:500]), ("tiny", "ACGT")):
        assert sorted((r["ps"], r["strand"], r["spacer"]) for r in sites if r["seq_id"] == name) == sorted(brute_sites(seq))
    tasks = {r["task"] for r in sites if r["seq_id"] == "long"}
    assert len(tasks) >= 4
    path = str(tmp_path / "tiles")
    gn.write_tiles(df, path)
    tiles = spark.read.parquet(path)
    assert tiles.agg(F.max(F.length("bases"))).first()[0] <= gn.TILE + gn.HALO
    assert gn.scan_sequences(df.drop("seq_len")).count() == len(sites)
    again = gn.scan_tiles(tiles).select("seq_id", "ps", "strand").collect()
    assert sorted(map(tuple, again)) == sorted((r["seq_id"], r["ps"], r["strand"]) for r in sites)
    at = [0, 5, 65530, 65536, 65540, 131071, 600_000, 899_999]
    targets = spark.createDataFrame([("long", i) for i in at] + [("short", 250), ("gone", 1)], "seq_id string, target long")
    rows = {(r["seq_id"], r["target"]): r for r in gn.tile_windows(tiles, targets, 300).collect()}
    for i in at:
        r = rows["long", i]
        assert r["bases_start"] == max(0, i - 300) and r["bases"] == long[max(0, i - 300):i + 300] and r["seq_len"] == len(long)
    assert rows["short", 250]["bases"] == long[:500] and ("gone", 1) not in rows
    with pytest.raises(ValueError):
        gn.tile_windows(tiles, targets, 600)


def test_only_asked_sequences_are_matched(spark):
    rng = random.Random(3)
    seqs = {f"s{i}": "".join(rng.choices("ACGT", k=3000)) for i in range(20)}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    first = sorted(brute_sites(seqs["s3"]))[0]
    wanted = spark.createDataFrame([("s3", first[2], 1), ("s4", "A" * 20, 2)], "seq_id string, spacer string, k int")
    got = gn.match_spacers(df, wanted)
    assert [(r["seq_id"], r["ps"], r["k"]) for r in got.collect()] == [("s3", first[0], 1)]
    assert "LeftSemi" in got._jdf.queryExecution().toString()
