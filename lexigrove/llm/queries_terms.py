"""Queries on terms of queries and on fields (2, 5)."""

from pyspark.sql import functions as F

from lexigrove.llm import terms as T
from lexigrove.session import table


def p2_found(spark, sf):
    marks = T.term_marks(T.query_records(table(spark, sf, "queries")), max_n=1).select(F.lit("term").alias("kind"), "term", "mark")
    fields = T.field_counts(table(spark, sf, "field_statistics")).select(F.lit("field").alias("kind"), "term", "mark")
    return marks.unionByName(fields).filter("mark is not null")


def p2_ngrams(spark, sf):
    return T.term_marks(T.query_records(table(spark, sf, "queries")), max_n=3).select(F.col("n").cast("long").alias("n"), "term", "occurrences", "records", "mark")


def p2_ngrams_any(spark, sf):
    """As p2_ngrams, of n-grams of any length."""
    return T.term_marks(T.query_records(table(spark, sf, "queries")), max_n=None).select(F.col("n").cast("long").alias("n"), "term", "occurrences", "records", "mark")


def p2_repeated(spark, sf):
    """N-grams of up to four tokens, and all longer ones that occur more than once."""
    return T.repeated_ngrams(T.query_records(table(spark, sf, "queries"))).select(F.col("n").cast("long").alias("n"), "term", "occurrences", "records")


def p2_fields(spark, sf):
    return T.field_counts(table(spark, sf, "field_statistics"))


def p5_found(spark, sf):
    weights = T.term_weights(T.query_records(table(spark, sf, "queries")))
    return T.distinctive_by_count(weights).select(F.col("rec").alias("query_id"), "term")


def p5_distinctive(spark, sf):
    """As p5_found, by log-entropy alone."""
    weights = T.term_weights(T.query_records(table(spark, sf, "queries"))).withColumn("log_entropy", F.round("log_entropy", 9))
    return T.most_distinctive(weights).select(F.col("rec").alias("query_id"), "term")


def p5_weights(spark, sf):
    w = T.term_weights(T.query_records(table(spark, sf, "queries")))
    return w.select(F.col("rec").alias("query_id"), "term", "n", "records", F.round("log_entropy", 6).alias("log_entropy"), F.round("tf_idf", 6).alias("tf_idf"))


QUERIES = {f.__name__: f for f in (p2_found, p2_ngrams, p2_ngrams_any, p2_repeated, p2_fields, p5_found, p5_distinctive, p5_weights)}

_RECORDS = r"""
WITH q AS (SELECT query_id,
  CASE WHEN tokens IS NOT NULL THEN list_filter(list_transform(tokens, lambda t: regexp_replace(lower(regexp_replace(t, '[.'']', '', 'g')), '^\s+|\s+$', '', 'g')), lambda t: t <> '') END AS tk,
  term_freq AS tf FROM queries WHERE query_id IS NOT NULL),
d AS (SELECT query_id, max(tk) AS tk, any_value(tf) AS tf FROM q GROUP BY query_id),
occ AS (SELECT query_id, unnest(tk) AS term, 1::BIGINT AS n FROM d WHERE tk IS NOT NULL
  UNION ALL SELECT query_id, regexp_replace(lower(regexp_replace(e.key, '[.'']', '', 'g')), '^\s+|\s+$', '', 'g'), e.value::BIGINT FROM (SELECT query_id, unnest(map_entries(tf)) AS e FROM d WHERE tk IS NULL)),
t AS (SELECT query_id, term, sum(n)::BIGINT AS n FROM occ WHERE term <> '' AND n > 0 GROUP BY ALL),
tot AS (SELECT count(DISTINCT query_id) AS total FROM t),
"""
_FIELDS = r"""
last AS (SELECT segment_id, lower(trim(field_name)) AS term, max(struct_pack(f := flushed_at, d := document_count, c := total_count)) AS x
  FROM field_statistics WHERE document_count IS NOT NULL AND field_name IS NOT NULL GROUP BY ALL),
sums AS (SELECT term, sum(x.c)::BIGINT AS occurrences, sum(x.d)::BIGINT AS records FROM last GROUP BY term),
fm AS (SELECT *, records / (SELECT records FROM sums WHERE term = 'document') AS share FROM sums),
fields AS (SELECT term, occurrences, records, CASE WHEN term = 'document' THEN NULL WHEN share < 0.002 THEN 'rare' WHEN share > 0.95 THEN 'common' END AS mark FROM fm)
"""
_MARK = "CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT total FROM tot) THEN 'common' END"
_W = """
s AS (SELECT term, count(*) AS records, sum(n) AS f, sum(n * ln(n)) AS fl FROM t GROUP BY term),
w AS (SELECT query_id, t.term, n, records, total, ln(1 + n) * (1 - (ln(f) - fl / f) / ln(total)) AS log_entropy, n * ln(total / records) AS tf_idf FROM t JOIN s USING (term), tot)
"""
SQL = {
    "p2_found": _RECORDS + "c AS (SELECT term, count(*) AS records FROM t GROUP BY term)," + _FIELDS + f"SELECT * FROM (SELECT 'term' AS kind, term, {_MARK} AS mark FROM c UNION ALL SELECT 'field', term, mark FROM fields) WHERE mark IS NOT NULL",
    "p2_fields": "WITH " + _FIELDS.strip() + " SELECT * FROM fields",
    "p2_ngrams": _RECORDS
    + f"""g AS (SELECT 1::BIGINT AS n, query_id, term, n AS k FROM t
  UNION ALL SELECT m, query_id, array_to_string(tk[i:i + m - 1], ' '), 1 FROM (SELECT query_id, tk, m, unnest(range(1, len(tk) - m + 2)) AS i FROM d, (VALUES (2), (3)) v(m) WHERE tk IS NOT NULL AND len(tk) >= m)),
c AS (SELECT n, term, sum(k)::BIGINT AS occurrences, count(DISTINCT query_id) AS records FROM g GROUP BY n, term)
SELECT n, term, occurrences, records, {_MARK} AS mark FROM c""",
    "p2_ngrams_any": _RECORDS
    + f"""g AS (SELECT 1::BIGINT AS n, query_id, term, n AS k FROM t
  UNION ALL SELECT j - i + 1, query_id, array_to_string(tk[i:j], ' '), 1 FROM (SELECT query_id, tk, i, unnest(range(i + 1, len(tk) + 1)) AS j FROM (SELECT query_id, tk, unnest(range(1, len(tk))) AS i FROM d WHERE tk IS NOT NULL))),
c AS (SELECT n, term, sum(k)::BIGINT AS occurrences, count(DISTINCT query_id) AS records FROM g GROUP BY n, term)
SELECT n, term, occurrences, records, {_MARK} AS mark FROM c""",
    "p2_repeated": _RECORDS
    + """g AS (SELECT 1::BIGINT AS n, query_id, term, n AS k FROM t
  UNION ALL SELECT j - i + 1, query_id, array_to_string(tk[i:j], ' '), 1 FROM (SELECT query_id, tk, i, unnest(range(i + 1, len(tk) + 1)) AS j FROM (SELECT query_id, tk, unnest(range(1, len(tk))) AS i FROM d WHERE tk IS NOT NULL))),
c AS (SELECT n, term, sum(k)::BIGINT AS occurrences, count(DISTINCT query_id) AS records FROM g GROUP BY n, term)
SELECT n, term, occurrences, records FROM c WHERE n <= 4 OR occurrences > 1""",
    "p5_found": _RECORDS
    + _W
    + "SELECT query_id, arg_min(term, (-tf_idf, term)) FILTER (records >= 2 AND records < total) AS term FROM w GROUP BY query_id HAVING count(*) >= 3 AND count(*) FILTER (records >= 2 AND records < total) > 0",
    "p5_distinctive": _RECORDS
    + _W
    + "SELECT query_id, arg_min(term, (-round(log_entropy, 9), term)) FILTER (records >= 2 AND records < total) AS term FROM w GROUP BY query_id HAVING count(*) >= 3 AND count(*) FILTER (records >= 2 AND records < total) > 0",
    "p5_weights": _RECORDS + _W + "SELECT query_id, term, n, records, round(log_entropy, 6) AS log_entropy, round(tf_idf, 6) AS tf_idf FROM w",
}
