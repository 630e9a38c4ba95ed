"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from weftline.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = driver.queries()[name](spark, sf_dir)
    mine = rows(df.columns, df.collect())
    if name in SQL:
        r = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert mine == rows(r.columns, r.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 2
