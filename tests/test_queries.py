"""Every registered query against its SQL in DuckDB, over sf0.001."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].copy()
    for k in p.columns:
        text = p[k].dtype == object or str(p[k].dtype).startswith(("str", "datetime"))
        p[k] = p[k].astype(str).replace({"None": "~", "nan": "~", "NaT": "~"}) if text else p[k].astype(float).round(9)
    return p.sort_values(list(p.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), db.sql(SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
