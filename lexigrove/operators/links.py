"""Links between documents: PageRank, link counts, anchor texts, and priors out of ranks and files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.session import beside, materialise

#: Probability of relevance by rank bin 1..10, as estimated on web pages.
BIN_PROBABILITY = [2.21916e-10, 5.61952e-10, 1.94786e-09, 3.62742e-09, 1.00745e-08, 1.97616e-08, 3.46944e-08, 4.39146e-08, 1.74226e-07, 2.28983e-07]


def pagerank(links: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 10, epsilon: float = 0.0, every: int = 5) -> DataFrame:
    """(id, rank): iterations of rank = (1 - d) / N + d x sum of (rank / out-degree) over sources.

    links(src, dst), repeats and self-links as given but each distinct link once; nodes(id). Ranks of dangling nodes
    aren't handed on. Contributions are summed map-side before the shuffle by dst, so a page with any number of links in is no hot task.
    Lineage is cut every few rounds in the shared folder; with epsilon, rounds end once no rank moved further.
    """
    nodes = materialise(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    edges = links.select("src", "dst").dropna().distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    edges = materialise(edges.join(out, "src"))
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for k in range(1, iterations + 1):
        given = edges.join(ranks, edges["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("in"))
        new = nodes.join(given, nodes["id"] == given["dst"], "left").select("id", ((1 - damping) / n + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if k % every == 0 or epsilon:
            new = materialise(new)
        if epsilon:
            moved = new.alias("a").join(ranks.alias("b"), "id").agg(F.max(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
            ranks = new
            if moved <= epsilon:
                break
        ranks = new
    return ranks


def rank_bins(ranks: DataFrame, bins: int = 10) -> DataFrame:
    """(id, rank, bin, logprob): the best ranks in bin `bins`, each bin below larger by (N + 1)^(1/bins).

    Bin sizes are worked out on the driver from N alone; positions come from a range-partitioned sort, so no task holds all ranks.
    """
    from pyspark.sql.functions import spark_partition_id

    n = ranks.count()
    base = (n + 1) ** (1 / bins)
    size, left, bounds = int(base - 1), n, []
    at, top = 0, bins
    size = size if size > 0 else 0
    while left > 0 and top > 1:
        if size == 0:
            bounds.append((at, at, top))
            size = max(1, math.ceil(base * size))
            top -= 1
            continue
        bounds.append((at, at + size, top))
        at, left, top = at + size, left - size, top - 1
        size = math.ceil(base * size)
    cut = materialise(ranks.repartitionByRange(F.desc("rank"), "id").withColumn("part", spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in cut.groupBy("part").count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    starts = F.create_map(*[F.lit(v) for kv in before.items() for v in kv]) if before else F.create_map().cast("map<int,int>")
    place = F.element_at(starts, F.col("part")) + F.row_number().over(W.partitionBy("part").orderBy(F.desc("rank"), "id")) - 1
    bin_of = F.lit(1)
    for lo, hi, b in bounds:
        bin_of = F.when((F.col("place") >= lo) & (F.col("place") < hi), b).otherwise(bin_of)
    probability = F.array(*[F.lit(math.log(p)) for p in BIN_PROBABILITY])
    return cut.withColumn("place", place).select("id", "rank", bin_of.alias("bin")).withColumn("logprob", F.element_at(probability, F.least("bin", F.lit(len(BIN_PROBABILITY)))))


def link_counts(links: DataFrame) -> DataFrame:
    """(id, links_in, links_out) of distinct links."""
    e = links.select("src", "dst").dropna().distinct()
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select(F.col("src").alias("id"), F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("links_in"), F.sum("o").alias("links_out"))


def redirect_ends(redirects: DataFrame, rounds: int = 32) -> DataFrame:
    """(url, target): where each redirect of redirects(url, target) ends, by pointer doubling (a chain of k takes log2 k joins). Of several targets of a
    url the least holds; redirects that run in a ring lead nowhere and are left out, NULLs too."""
    first = redirects.select("url", "target").dropna().groupBy("url").agg(F.min("target").alias("target")).filter("url <> target")
    at = materialise(first)
    n = at.count()
    for _ in range(rounds):
        hop = at.select(F.col("url").alias("target"), F.col("target").alias("next"))
        new = materialise(at.join(hop, "target", "left").select("url", F.coalesce("next", "target").alias("target")))
        moved = new.join(at, ["url", "target"], "left_semi").count() < n
        at = new
        if not moved:
            break
    return at.join(first.select(F.col("url").alias("target")), "target", "left_anti").select("url", "target")


def resolved(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """links(src, dst, ...) with dst followed to the end of redirects(url, target)."""
    r = redirect_ends(redirects).select(F.col("url").alias("dst"), "target")
    return links.join(r, "dst", "left").withColumn("dst", F.coalesce("target", "dst")).drop("target").select(*links.columns)


def link_keys(links: DataFrame, column: str = "dst") -> DataFrame:
    """links with `key`, the SHA-1 of a column's text, as a join key of fixed width."""
    return links.withColumn("key", F.sha1(F.col(column)))


def anchor_texts(links: DataFrame) -> DataFrame:
    """(dst, n_links, anchors): anchor texts of a target, distinct and sorted."""
    rows = links.filter("anchor is not null and trim(anchor) <> ''").select("dst", F.trim("anchor").alias("anchor"))
    each = rows.groupBy("dst", "anchor").agg(F.count("*").alias("n"))
    return each.groupBy("dst").agg(F.sum("n").alias("n_links"), F.array_sort(F.collect_list("anchor")).alias("anchors"))


def with_anchor_text(c: Collection, anchors: DataFrame, field: str = "inlink") -> Collection:
    """The collection with (doc_id, anchor) texts as tokens at the ends of their documents, in extents of `field`."""
    from dataclasses import replace

    from lexigrove.functions.analysis import simple_tokens

    rows = anchors.groupBy("doc_id").agg(F.array_sort(F.collect_list("anchor")).alias("a"))
    parts = rows.select("doc_id", F.posexplode("a").alias("k", "anchor")).select("doc_id", "k", simple_tokens(F.col("anchor")).alias("ws"))
    before = F.coalesce(F.sum(F.size("ws")).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("b", before).join(c.lengths(), "doc_id", "left").withColumn("begin", (F.coalesce("length", F.lit(0)) + F.col("b")).cast("int"))
    tokens = parts.select("doc_id", "begin", F.posexplode("ws").alias("i", "term")).select("doc_id", (F.col("begin") + F.col("i")).alias("pos"), "term")
    none = F.lit(None).cast("long")
    fields = parts.select("doc_id", F.lit(field).alias("field"), "begin", (F.col("begin") + F.size("ws")).alias("end"), none.alias("number"), F.lit(0).alias("ordinal"), F.lit(0).alias("parent"))
    return replace(c, tokens=c.tokens.unionByName(tokens), fields=c.fields.unionByName(fields), _lengths=None)


def with_url_text(c: Collection, key: str = "url", field: str = "url") -> Collection:
    """The collection with the words of each document's address, from its metadata, as tokens in extents of `field`."""
    urls = c.docs.select("doc_id", F.regexp_replace(F.col("metadata")[key], r"^[A-Za-z]+://", "").alias("anchor")).filter("anchor is not null and anchor <> ''")
    return with_anchor_text(c, urls, field)


def prior_from_file(spark: SparkSession, c: Collection, path: str, log: bool = True) -> DataFrame:
    """(doc_id, logprob) from lines of `external id, value`, by blanks or tabs; values are log probabilities, or counts to be normalised."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).filter(F.size("v") >= 2)
    rows = lines.select(F.col("v")[0].alias("ext_id"), F.col("v")[1].try_cast("double").alias("x")).dropna()
    if not log:
        total = rows.agg(F.sum("x").alias("s"))
        rows = beside(rows, total).withColumn("x", F.log(F.col("x") / F.col("s")))
    return rows.join(c.docs.select("doc_id", "ext_id"), "ext_id").select("doc_id", F.col("x").alias("logprob"))
