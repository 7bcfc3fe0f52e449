"""Catalogue contract, and a selection of queries against DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SELECTION = ("t12_fill_null_interpolate", "t25_quantile_transform", "t35_hash_encode", "t59_numeric_coercion", "f5_datetime_parts", "s2_tolerant_scan",
             "x4_cramers_v", "e7_decision_metrics", "k7_two_level_anonymity", "l12_mined_corrections", "r2_sessions", "r3_fitted_stream")


def test_every_sql_text_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 200


def test_flagship_query(spark):
    found = entry(spark)
    assert found.columns and found.count() > 0


@pytest.mark.parametrize("name", SELECTION)
def test_against_sql(spark, folder, name):
    assert compare(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) == ""
