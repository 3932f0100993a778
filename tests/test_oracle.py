"""Every registered query with an oracle equals its DuckDB SQL at sf0.01 (the driver's gate)."""

import os

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duckdb_conn

SF = "/root/testdata/sf0.01"
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, QUERIES[name], ORACLE[name], con)
    assert r["names_match"], r
    assert r["types_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["input_text", "output_text", "output_text_score", "file_path"]
    assert df.count() >= 0
