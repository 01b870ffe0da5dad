"""Registered queries against their SQL counterparts at the smallest scale."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from editloom.checks.compare import compare

# A spread over all operator families that runs in a few minutes; the whole list is run by
# ``python -m editloom.checks.compare``.
QUICK = [
    "win_1_top_guides_per_gene", "join_1_library_lookup", "des_12_target_lookup", "win_13_reference_pairs", "set_2_reporter_dedupe",
    "seq_9_complement_run", "seq_13_primer_assessment", "txt_5_cassette", "txt_10_request_rows", "gen_6_guide_scan", "gen_8_cut_context",
    "gen_9_guide_placement", "win_5_best_by_strand", "win_7_best_segment", "win_15_blocking_edit", "don_1_edit_oligo", "don_3_insert_validation",
    "join_11_history_match", "agg_4_history_counters", "agg_2_primer_summary", "src_6_genbank", "join_2_reference_files", "des_3_c_terminal_insert",
]


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    ok, line = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], DATA)
    assert ok, line
