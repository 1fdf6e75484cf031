"""Every query with SQL against DuckDB on the smallest tables; the others have to run and return rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewell.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype != object and not str(df[c].dtype).startswith("str"):
            df[c] = pd.to_numeric(df[c]).astype(float) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), atol=1.1e-6, rtol=0, equal_nan=True), c
        else:
            assert list(a[c]) == list(b[c]), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
