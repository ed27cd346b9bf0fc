"""Queries on lines that fail to parse, with their SQL."""

from pyspark.sql import functions as F

from lexigrove.operators.row_checks import check_rows, load_rows
from lexigrove.session import table


def p3_found(spark, sf):
    return check_rows(table(spark, sf, "crawl_log")).filter("reason is not null").select("line_id", "reason").distinct()


def p3_loaded(spark, sf):
    good = load_rows(table(spark, sf, "crawl_log"))
    return good.select("line_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "result", "size", "url", "mime", "annot")


def p3_reasons(spark, sf):
    return check_rows(table(spark, sf, "crawl_log")).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n_lines"))


QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded, "p3_reasons": p3_reasons}

_CHECKED = r"""
WITH t AS (SELECT line_id, regexp_replace(coalesce(line, ''), '^[ \t]+|[ \t\r\n]+$', '', 'g') AS l FROM crawl_log),
c AS (SELECT line_id,
  NOT (l = '' OR regexp_full_match(l, '("([^"]|"")*"|[^ \t"]+)([ \t]+("([^"]|"")*"|[^ \t"]+))*', 's')) AS broken,
  list_transform(regexp_extract_all(l, '"(?:[^"]|"")*"|[^ \t"]+'), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM t),
v AS (SELECT *, regexp_replace(f[1], '^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{3})$', '\1-\2-\3T\4:\5:\6.\7Z') AS iso FROM c),
r AS (SELECT *, CASE WHEN broken THEN 'broken_quote' WHEN len(f) < 12 THEN 'too_few_fields' WHEN len(f) > 12 THEN 'too_many_fields'
  WHEN NOT regexp_full_match(iso, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}Z') OR try_cast(iso[1:10] AS DATE) IS NULL THEN 'bad_time'
  WHEN NOT regexp_full_match(f[2], '-?[0-9]+') THEN 'bad_result'
  WHEN NOT regexp_full_match(f[3], '[0-9]+|-') THEN 'bad_size'
  WHEN NOT regexp_matches(f[4], '^[A-Za-z]+://[^/:]+[/:]') THEN 'bad_url' END AS reason FROM v)
"""

SQL = {
    "p3_found": _CHECKED + "SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_loaded": _CHECKED
    + "SELECT line_id, replace(iso[1:23], 'T', ' ') AS at, try_cast(f[2] AS BIGINT) AS result, try_cast(f[3] AS BIGINT) AS size, f[4] AS url, f[7] AS mime, f[12] AS annot FROM r WHERE reason IS NULL",
    "p3_reasons": _CHECKED + "SELECT coalesce(reason, 'good') AS reason, count(*) AS n_lines FROM r GROUP BY 1",
}
