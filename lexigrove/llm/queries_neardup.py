"""Queries on near-duplicate documents (1)."""

from pyspark.sql import functions as F

from lexigrove.llm import neardup as N
from lexigrove.session import table

#: As the table's description sets it for these documents.
SHINGLE, LEAST = 3, 0.6


def _links(spark, sf):
    return N.near_duplicates(table(spark, sf, "parsed_documents"), "docno", "text", SHINGLE, LEAST)


def p1_found(spark, sf):
    return N.found_pairs(*_links(spark, sf)).select(F.col("a").alias("docno_a"), F.col("b").alias("docno_b"))


def p1_groups(spark, sf):
    return N.groups(*_links(spark, sf)).select(F.col("id").alias("docno"), F.col("class").alias("class_docno"), "n_links")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups)}

_PAIRS = r"""
WITH RECURSIVE d AS (SELECT docno, max(text) AS text FROM parsed_documents WHERE text IS NOT NULL AND docno IS NOT NULL GROUP BY docno),
w AS (SELECT docno, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS ws FROM d),
s AS (SELECT DISTINCT docno, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
k AS (SELECT docno, count(*) AS n FROM s GROUP BY docno),
p AS (SELECT x.docno AS docno_a, y.docno AS docno_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.docno < y.docno GROUP BY ALL),
f AS (SELECT docno_a, docno_b FROM p JOIN k ka ON ka.docno = docno_a JOIN k kb ON kb.docno = docno_b WHERE c >= 0.6 * (ka.n + kb.n - c))
"""
SQL = {
    "p1_found": _PAIRS + "SELECT docno_a, docno_b FROM f",
    "p1_groups": _PAIRS
    + """, e AS (SELECT docno_a AS x, docno_b AS y FROM f UNION ALL SELECT docno_b, docno_a FROM f),
r(x, y) AS (SELECT docno, docno FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
n AS (SELECT e.x, count(DISTINCT wy.ws) AS n_links FROM e JOIN w wx ON wx.docno = e.x JOIN w wy ON wy.docno = e.y WHERE wx.ws <> wy.ws GROUP BY e.x)
SELECT r.x AS docno, min(r.y) AS class_docno, coalesce(any_value(n_links), 0) AS n_links FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x""",
}
