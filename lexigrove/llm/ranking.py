"""Best items of every group, and one order out of several differently-scaled scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.session import broadcast_if_small, materialise, skew_safe_lookup

#: A score at or below this says "no score".
NO_SCORE = -99999

#: Items whose projection is within this share of the best one's are compared by their exact mean place.
CLOSE = 0.02


def best_scores(results: DataFrame, pools: DataFrame) -> DataFrame:
    """(model_name, topic_name, dir_day, stream_id, score, good): each item's best counting score.

    Rows with a NULL in a column or a score of NO_SCORE or less don't count. `good` is the score turned
    so that more is better; a model that pools doesn't name, or names without a direction, has bigger as better.
    Repeated rows fall together. Empty input gives no rows; other columns are ignored.
    """
    better = pools.groupBy("model_name").agg(F.max("bigger_is_better").alias("up"))
    better = broadcast_if_small(better, better.count())
    names = ["model_name", "topic_name", "stream_id", "score", "dir_name"]
    rows = results.select(*names).dropna("any").filter(F.col("score") > NO_SCORE)
    score = F.col("score").cast("long") if dict(results.dtypes)["score"] in ("tinyint", "smallint", "int") else F.col("score")  # as the negative of the least int
    rows = rows.join(better, "model_name", "left").withColumn("good", F.when(F.coalesce("up", F.lit(True)), score).otherwise(-score))
    keys = ["model_name", "topic_name", F.substring("dir_name", 1, 10).alias("dir_day"), "stream_id"]
    return rows.groupBy(*keys).agg(F.max("good").alias("good"), F.max_by("score", "good").alias("score"))


def top_n(items: DataFrame, groups: list[str], score: str | Column, tie: str, n: int = 10) -> DataFrame:
    """The n rows with the highest score of every group, of equals the smaller `tie` first, with their place `rn`.

    A row_number window with a filter on it: the optimiser's group limit keeps n rows of a
    group in each task before the shuffle, so a group of any size arrives as at most n rows a task.
    NULL scores come last; NULL groups are a group; fewer than n rows give all; n of 0 or an empty table gives none.
    """
    order = W.partitionBy(*groups).orderBy(F.desc_nulls_last(score) if isinstance(score, str) else score.desc_nulls_last(), F.asc(tie))
    return items.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def running(counts: DataFrame, groups: list[str], order: list[Column], n: str = "n", parts: int | None = None) -> DataFrame:
    """counts with `before`: the sum of n over the rows of the group that come earlier by `order`, no group in one task.

    Rows are range-partitioned by (group, order) and written; what comes earlier is the rows of the
    group in earlier parts plus those before it in its part. Of a group a task sorts one part, and one row for each part.
    """
    parts = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(counts.repartitionByRange(parts, *groups, *order).withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy(*groups, "part").agg(F.sum(n).alias("size"))
    earlier = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("parts_before"))
    within = W.partitionBy("part", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return cut.join(sizes, [*groups, "part"]).withColumn("before", F.col("before") + F.col("parts_before")).drop("part", "parts_before")


def places(scores: DataFrame, groups: list[str], score: str = "good") -> DataFrame:
    """scores with `place`: 1 + number of rows of the group with a higher score (of any type that has an order).

    Rows are counted by score, and the counts of higher scores are summed up by `running`, so that no group is sorted in one task.
    Ties share a place. A score that repeats by the million is one row there, and is looked up as a hot key.
    """
    counts = materialise(scores.groupBy(*groups, score).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = running(counts, groups, [F.desc(score)]).select(*groups, score, "n", (1 + F.col("before")).alias("place"))
    return skew_safe_lookup(scores, materialise(at), [*groups, score], "n", total).drop("n")


def place_table(best: DataFrame, models: list[str]) -> DataFrame:
    """A row for each item of a (topic_name, dir_day): its place in each model (p0, p1, ...) and n_items.

    An item without a score of a model takes n_items as its place. Models not in `models` don't count,
    but their items do.
    """
    at = places(materialise(best), ["model_name", "topic_name", "dir_day"])
    wide = at.groupBy("topic_name", "dir_day", "stream_id").agg(F.count("*").alias("n_models"), *[F.max(F.when(F.col("model_name") == m, F.col("place"))).alias(f"p{k}") for k, m in enumerate(models)])
    wide = materialise(wide)
    sizes = wide.groupBy("topic_name", "dir_day").agg(F.count("*").alias("n_items"))
    wide = wide.join(sizes, ["topic_name", "dir_day"])
    return wide.select("topic_name", "dir_day", "stream_id", "n_items", *[F.coalesce(f"p{k}", "n_items").alias(f"p{k}") for k in range(len(models))])


def first_component(table: DataFrame, k: int) -> list[float]:
    """Weights of the first principal component of the k rank-transformed scores (place / n_items), their magnitudes adding up to 1.

    Sums and products are aggregated by Spark in one row; the k x k correlation matrix is decomposed on
    the driver. Places count down from the best for every model, so that all declared directions are
    positive: the whole vector is turned to agree with their sum, and a model that runs against the others keeps
    its negative weight. Without variance (no rows, all ties) all weights are equal.
    """
    if not k:
        return []
    x = [F.col(f"p{i}") / F.col("n_items") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = table.agg(F.count("*"), *[F.sum(a) for a in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    n = row[0]
    if n < 2:
        return [1.0 / k] * k
    mean = np.array([v / n for v in row[1 : 1 + k]])
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :]):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    if (sd < 1e-12).any():
        return [1.0 / k] * k
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    first = vectors[:, -1]
    weights = (first if first.sum() >= 0 else -first) / sd
    return [float(w) for w in weights / np.abs(weights).sum()]


def fuse(results: DataFrame, pools: DataFrame) -> tuple[DataFrame, list[float]]:
    """Every item of every topic and day with its places, `projection` on the first component (less is
    better) and `total` of its places; and the component's weights.

    The models are those of pools, a table of a few rows; without any there are no items. NULLs, repeats and empty tables as in best_scores.
    """
    models = sorted(r[0] for r in pools.select("model_name").dropna().distinct().collect())
    best = best_scores(results, pools)
    wide = materialise(place_table(best if models else best.limit(0), models))
    weights = first_component(wide, len(models))
    total = sum((F.col(f"p{k}") for k in range(len(models))), F.lit(0))
    projection = sum((F.lit(w) * F.col(f"p{k}") for k, w in enumerate(weights)), F.lit(0.0))
    return wide.select("*", total.alias("total"), projection.alias("projection")), weights


def winners(results: DataFrame, pools: DataFrame, least_items: int = 12, close: float = CLOSE) -> DataFrame:
    """(topic_name, dir_day, stream_id): the first item of each topic and day with enough items.

    The projection decides; where it is close (items within the share `close` of the first one's), the exact mean place over the
    models, in which all weigh alike, decides among these, of equals the smaller stream_id.
    """
    items, _ = fuse(results, pools)
    items = items.filter(F.col("n_items") >= least_items)
    keys = ["topic_name", "dir_day"]
    best = items.groupBy(*keys).agg(F.min("projection").alias("lead"))
    near = items.join(best, keys).filter(F.col("projection") <= F.col("lead") + F.lit(close) * F.abs("lead") + 1e-9)
    return near.groupBy(*keys).agg(F.min(F.struct("total", "stream_id")).alias("w")).select(*keys, F.col("w.stream_id").alias("stream_id"))


def positions(items: DataFrame, groups: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """items with `position` 1, 2, ... within each group by `order` (which must tell all rows of a group apart), no group in one task."""
    rows = running(items.withColumn("one", F.lit(1).cast("long")), groups, [F.asc(c) for c in order], "one", parts)
    return rows.withColumn("position", F.col("before") + 1).drop("one", "before")
