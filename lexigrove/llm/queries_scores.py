"""Queries on the scores of stream items (4, 6)."""

from pyspark.sql import functions as F

from lexigrove.llm import ranking as R
from lexigrove.session import table


def p4_found(spark, sf):
    return R.winners(table(spark, sf, "stream_results"), table(spark, sf, "model_pools"))


def p4_ranking(spark, sf):
    items, _ = R.fuse(table(spark, sf, "stream_results"), table(spark, sf, "model_pools"))
    ranked = R.positions(items.select("topic_name", "dir_day", "stream_id", F.round("projection", 6).alias("projection")), ["topic_name", "dir_day"], ["projection", "stream_id"])
    return ranked.select("topic_name", "dir_day", "stream_id", "position", "projection")


def p4_places(spark, sf):
    items, _ = R.fuse(table(spark, sf, "stream_results"), table(spark, sf, "model_pools"))
    return items.select("topic_name", "dir_day", "stream_id", "n_items", F.col("total").alias("sum_places"))


def p6_found(spark, sf):
    best = R.best_scores(table(spark, sf, "stream_results"), table(spark, sf, "model_pools"))
    top = R.top_n(best, ["model_name", "topic_name", "dir_day"], "good", "stream_id", 10)
    return top.select("model_name", "topic_name", "dir_day", "stream_id")


def p6_ranked(spark, sf):
    best = R.best_scores(table(spark, sf, "stream_results"), table(spark, sf, "model_pools"))
    top = R.top_n(best, ["model_name", "topic_name", "dir_day"], "good", "stream_id", 10)
    return top.select("model_name", "topic_name", "dir_day", "stream_id", F.col("score").cast("long").alias("score"), F.col("rn").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (p4_found, p4_ranking, p4_places, p6_found, p6_ranked)}

_BEST = """
WITH best AS (SELECT r.model_name, topic_name, substr(dir_name, 1, 10) AS dir_day, stream_id,
  max(CASE WHEN coalesce(bigger_is_better, true) THEN score::BIGINT ELSE -score::BIGINT END) AS good,
  bool_and(coalesce(bigger_is_better, true)) AS up
  FROM stream_results r LEFT JOIN model_pools m ON r.model_name = m.model_name
  WHERE r.model_name IS NOT NULL AND topic_name IS NOT NULL AND stream_id IS NOT NULL AND dir_name IS NOT NULL AND score > -99999 GROUP BY ALL),
"""
_PLACES = (
    _BEST
    + """
pl AS (SELECT *, rank() OVER (PARTITION BY model_name, topic_name, dir_day ORDER BY good DESC) AS place FROM best),
sizes AS (SELECT topic_name, dir_day, count(DISTINCT stream_id) AS n_items FROM best GROUP BY ALL),
tot AS (SELECT pl.topic_name, pl.dir_day, stream_id, any_value(n_items) AS n_items, sum(place) + ((SELECT count(*) FROM model_pools) - count(*)) * any_value(n_items) AS s
  FROM pl JOIN sizes USING (topic_name, dir_day) GROUP BY ALL)
"""
)
_M5 = range(5)
#: Correlations of the five models' places as shares of the items, and 40 steps of the power method from equal loadings.
_COMPONENT = (
    _BEST
    + "pl AS (SELECT *, rank() OVER (PARTITION BY model_name, topic_name, dir_day ORDER BY good DESC) AS place FROM best), sizes AS (SELECT topic_name, dir_day, count(DISTINCT stream_id) AS n_items FROM best GROUP BY ALL), ms AS (SELECT model_name, row_number() OVER (ORDER BY model_name) - 1 AS i FROM model_pools), "
    + "x AS (SELECT pl.topic_name, pl.dir_day, stream_id, any_value(n_items) AS n_items, "
    + ", ".join(f"coalesce(max(place) FILTER (i = {i}), any_value(n_items)) AS p{i}" for i in _M5)
    + " FROM pl JOIN sizes USING (topic_name, dir_day) JOIN ms USING (model_name) GROUP BY ALL), cm AS (SELECT "
    + ", ".join(f"corr(p{i} / n_items, p{j} / n_items) AS c{i}{j}" for i in _M5 for j in _M5)
    + ", "
    + ", ".join(f"stddev_pop(p{i} / n_items) AS d{i}" for i in _M5)
    + " FROM x), v0 AS (SELECT "
    + ", ".join(f"1.0::DOUBLE AS v{i}" for i in _M5)
    + ")"
    + "".join(
        f", u{k} AS MATERIALIZED (SELECT " + ", ".join(" + ".join(f"c{i}{j} * v{j}" for j in _M5) + f" AS v{i}" for i in _M5) + f" FROM cm, v{k - 1}), v{k} AS MATERIALIZED (SELECT " + ", ".join(f"v{i} / sqrt(" + " + ".join(f"v{j} * v{j}" for j in _M5) + f") AS v{i}" for i in _M5) + f" FROM u{k})"
        for k in range(1, 41)
    )
    + ", wt AS (SELECT "
    + ", ".join(f"v{i} / d{i} / (" + " + ".join(f"abs(v{j} / d{j})" for j in _M5) + f") AS w{i}" for i in _M5)
    + " FROM cm, v40) SELECT topic_name, dir_day, stream_id, row_number() OVER (PARTITION BY topic_name, dir_day ORDER BY projection, stream_id) AS position, projection FROM (SELECT topic_name, dir_day, stream_id, round("
    + " + ".join(f"w{i} * p{i}" for i in _M5)
    + ", 6) AS projection FROM x, wt)"
)
_TOP = (
    _BEST
    + """
r AS (SELECT *, row_number() OVER (PARTITION BY model_name, topic_name, dir_day ORDER BY good DESC, stream_id) AS rn FROM best)
"""
)
SQL = {
    "p4_found": _PLACES + "SELECT topic_name, dir_day, arg_min(stream_id, (s, stream_id)) AS stream_id FROM tot WHERE n_items >= 12 GROUP BY topic_name, dir_day",
    "p4_places": _PLACES + "SELECT topic_name, dir_day, stream_id, n_items, s::BIGINT AS sum_places FROM tot",
    "p4_ranking": _COMPONENT,
    "p6_found": _TOP + "SELECT model_name, topic_name, dir_day, stream_id FROM r WHERE rn <= 10",
    "p6_ranked": _TOP + "SELECT model_name, topic_name, dir_day, stream_id, CASE WHEN up THEN good ELSE -good END AS score, rn AS place FROM r WHERE rn <= 10",
}
