"""Every registered query against its SQL, over whole tables; the columns of the others."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted(tuple(_same(r[c]) for c in order) for r in got.collect())
    right = sorted(tuple(_same(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
