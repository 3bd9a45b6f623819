"""Corpus queries with SQL against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from tendergrid.llm.oracles import ORACLES
from tendergrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.select(*order).fetchall())
