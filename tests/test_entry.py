"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from partylens.plans import catalog

NAMES = sorted(catalog.queries())


def norm(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert list(got.columns)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert norm(got) == norm(con.execute(sql).df())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
