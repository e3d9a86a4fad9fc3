"""Queries that have SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest
from sylva.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(str([r[c] for c in sorted(got.columns)]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
