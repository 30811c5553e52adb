"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pointspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        p = f"{data}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def text(v):
    if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return ""
    if isinstance(v, (list, np.ndarray)):
        return str([text(x) for x in v])
    if isinstance(v, (int, float, np.number)) or hasattr(v, "quantize"):
        return repr(float(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, data, db, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
