"""Every query with SQL gives DuckDB's rows; every other one runs."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from storyloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(v) < 10**5 else str(int(v))
    return str(v)


def rows_of(frame):
    return sorted("|".join(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).toPandas() is not None
