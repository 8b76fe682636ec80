"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from counterspark import queries as q

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]) or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.SQL[name]).df()
    pd.testing.assert_frame_equal(norm(ours), norm(theirs), rtol=0, atol=2e-4)
    assert len(ours) or name == "first_departure"


@pytest.mark.parametrize("name", ["diagnostics_tidy", "residual_pacf", "residual_qq"])
def test_query_without_sql_has_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 10
