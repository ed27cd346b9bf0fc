"""Queries on the corpus: leaked evaluation items (8) and the mix of sources (9)."""

from pyspark.sql import functions as F

from lexigrove.llm import leaks as L
from lexigrove.llm import mixing as M
from lexigrove.session import table


def p8_found(spark, sf):
    return L.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark_items")).filter("kind = 'verbatim'").select("doc_id", "item_id")


def p8_leaks(spark, sf):
    return L.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark_items"))


def _mixed(spark, sf):
    docs = M.sized(table(spark, sf, "documents"))
    plan = M.budgets(docs, table(spark, sf, "source_targets"))
    return plan, M.blend(docs, plan)


def p9_found(spark, sf):
    return M.shares(*_mixed(spark, sf)).filter("falls_short").select("source")


def p9_blend(spark, sf):
    return _mixed(spark, sf)[1]


def p9_blend_chars(spark, sf):
    """As p9_blend, sizes in characters and weights by letters, which SQL can follow to the document."""
    docs = M.sized(table(spark, sf, "documents"), size=F.length("text"), weight=M.letter_share(F.col("text")))
    return M.blend(docs, M.budgets(docs, table(spark, sf, "source_targets")))


def p9_shares(spark, sf):
    return M.shares(*_mixed(spark, sf)).select("source", F.round("share", 6).alias("share"), "available", F.round("budget", 2).alias("budget"), "epochs", "used", F.round("reached", 6).alias("reached"), "falls_short")


QUERIES = {f.__name__: f for f in (p8_found, p8_leaks, p9_found, p9_blend, p9_blend_chars, p9_shares)}

_SIZES = r"""
WITH d AS (SELECT doc_id, text, length(text) AS size, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source FROM documents WHERE text <> '' AND regexp_replace(source, '^\s+|\s+$', '', 'g') <> ''),
wt AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, sum(target_weight) AS w, max(max_repeats) AS most FROM source_targets WHERE source IS NOT NULL GROUP BY 1),
have AS (SELECT source, sum(size)::BIGINT AS available FROM d GROUP BY source),
b AS (SELECT wt.source, most, coalesce(available, 0) AS available, w / (SELECT sum(w) FROM wt) * (SELECT sum(size) FROM d) AS budget FROM wt LEFT JOIN have USING (source)),
plan AS (SELECT *, CASE WHEN available > 0 THEN floor(least(budget, most * available) / available) ELSE 0 END::BIGINT AS epochs, least(budget, most * available) - CASE WHEN available > 0 THEN floor(least(budget, most * available) / available) ELSE 0 END * available AS rest FROM b),
"""
SQL = {
    "p8_found": r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark_items),
dw AS (SELECT id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM w WHERE len(ws) >= 12),
iw AS (SELECT id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12)
SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (g)""",
    # No source is close to its limit, so that characters tell what tokens do.
    "p9_found": _SIZES + "x AS (SELECT 1) SELECT source FROM plan WHERE most * available < budget",
    "p9_blend_chars": _SIZES
    + r"""k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '42', text)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
  / greatest(length(regexp_replace(text, '[^\p{L}\s]+', '', 'g'))::DOUBLE / length(text), 0.1) AS key FROM d),
r AS (SELECT doc_id, source, size, epochs, rest, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN plan USING (source))
SELECT doc_id, source, size AS tokens, epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS copies FROM r WHERE epochs > 0 OR (rest > 0 AND run <= rest)""",
}
