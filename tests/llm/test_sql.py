"""Queries that SQL can express against it, on the supplied tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from photonflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(got.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
