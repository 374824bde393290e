"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.jobs import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _norm(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert _norm(got.select(*columns).collect()) == _norm(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
