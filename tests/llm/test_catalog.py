"""Every query of the subpackage against its SQL, on the smallest tables; those without SQL run."""

import math
import os

import duckdb
import pytest

from lexigrove.llm import catalog

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


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        return
    r = db.sql(catalog.SQL[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(k) for k in names]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_found_queries_have_their_columns(spark):
    columns = {
        "p1_found": ["docno_a", "docno_b"],
        "p2_found": ["kind", "term", "mark"],
        "p4_found": ["topic_name", "dir_day", "stream_id"],
        "p5_found": ["query_id", "term"],
        "p6_found": ["model_name", "topic_name", "dir_day", "stream_id"],
        "p7_found": ["docno", "line_no"],
        "p8_found": ["doc_id", "item_id"],
        "p9_found": ["source"],
        "p10_found": ["doc_id", "subject"],
    }
    assert {k for k in catalog.QUERIES if k.endswith("_found")} == set(columns)
    for name, want in columns.items():
        assert catalog.QUERIES[name](spark, SF).columns == want
