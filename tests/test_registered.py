"""Every registered query against its SQL, in one task per key and in split runs."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Queries with ordered work on keys that are large enough at this size to be split.
ORDERED = [
    "a12_representative_frame", "j3_estimate_shift", "q1_dedupe_frames", "q2_recent_hash_filter", "q3_filter_scroll",
    "q4_collapse_page_turns", "q5_stitch_plan", "q6_merge_plan", "q13_compose_rows", "w1_frame_change", "x3_dhash",
    "t3_debounce_latest", "t3_current_answers", "w2_text_bands", "q7_pack_bands", "q8_resolve_overlaps", "q1_dedupe_frames_full", "q5_stitch_buffer",
]
# At the smallest size the sheets have no band of nine rows, so these are rightly empty.
SPARSE = {"q7_pack_bands", "q8_resolve_overlaps", "w2_active_bands", "w4_page_gaps"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    error, rows = oracle.check(spark, con, name, QUERIES[name], SQL[name], SF)
    assert error is None and (rows > 0 or name in SPARSE)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ORDERED)
def test_equals_sql_in_runs(small_runs, con, name):
    error, rows = oracle.check(small_runs, con, name, QUERIES[name], SQL[name], SF)
    assert error is None and (rows > 0 or name in SPARSE)


def test_names_and_columns_are_registered():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 92


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "page_no" in df.columns
