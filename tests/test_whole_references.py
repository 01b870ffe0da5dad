"""The package query copies whole references."""

from conftest import DATA

import __spark_entry__
from editloom.checks.fixtures import view


def test_raw_sequences_are_copied_whole(spark):
    rows = __spark_entry__.queries()["snk_4_package_files"](spark, DATA).where("section = 'Data' and file like 'GENE%.txt'").select("file", "text").collect()
    seqs = {r["gene"] + ".txt": r["seq"] for r in view(spark, DATA, "fx_sequences").select("gene", "seq").collect()}
    assert rows and all(r["text"] == seqs[r["file"]] and len(r["text"]) > 100 for r in rows)
