"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from harness import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(name, spark, duck_con):
    ok, message, *_ = compare(spark, duck_con, FOLDER, entry.queries()[name], SQL.get(name))
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"qid", "doc_id", "score", "rank"}
    assert df.limit(1).count() == 1
