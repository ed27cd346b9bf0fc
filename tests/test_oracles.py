"""Every query that has SQL against it, on the smallest tables; all others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrove.catalog import core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't there")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def compare(spark, db, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=repr)
    if sql is None:
        return
    r = db.sql(sql)
    assert sorted(r.columns) == names
    at = [r.columns.index(k) for k in names]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_core(spark, db, name):
    compare(spark, db, core.QUERIES[name], core.SQL.get(name))


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
