"""Passages of result documents, and documents re-ranked by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.functions.columns import let
from lexigrove.operators.inspect import term_stats
from lexigrove.plans.compile import Compiler
from lexigrove.session import beside, materialise, skew_safe_lookup


def cut(terms: Column, size: int = 150, overlap: int = 50) -> Column:
    """array<array<string>>: runs of `size` terms that share `overlap` with the next; a tail of at most `overlap` new terms joins the last run."""
    step = size - overlap

    def made(t: Column) -> Column:
        n = F.size(t)
        extra = F.greatest(n - size, F.lit(0))
        whole = F.floor(extra / step).cast("int")
        tail = extra - whole * step
        runs = F.transform(
            F.sequence(F.lit(0), whole),
            lambda i: F.slice(t, i * step + 1, F.when((i == whole) & (tail <= overlap), F.lit(size) + tail).otherwise(F.lit(size)).cast("int")),
        )
        last = F.slice(t, (whole + 1) * step + 1, F.lit(size))
        return F.when(n == 0, F.array().cast("array<array<string>>")).when(tail > overlap, F.concat(runs, F.array(last))).otherwise(runs)

    return let(terms, made)


def passages(c: Collection, size: int = 150, overlap: int = 50, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, psg_id, terms) of each document, stopped slots left out; psg_id counts from 0."""
    t = c.tokens.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi") if doc_ids is not None else c.tokens
    docs = t.filter("term is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("x"))
    return docs.select("doc_id", F.posexplode(cut(F.col("x.term"), size, overlap)).alias("psg_id", "terms"))


def passage_scores(c: Collection, psgs: DataFrame, terms: list[str], mu: float = 2500.0) -> DataFrame:
    """(doc_id, psg_id, size, score): Dirichlet log score of the query's terms in each passage; terms that the collection lacks don't count."""
    total = Compiler(c).totals()[0] or 1.0
    cf = {r["term"]: r["cf"] for r in term_stats(c).filter(F.col("term").isin(terms)).collect()}
    n = F.size("terms")
    out = F.lit(0.0)
    for t in terms:
        if t in cf:
            tf = F.size("terms") - F.size(F.array_remove("terms", t))
            out = out + F.log((tf + mu * cf[t] / total) / (n + mu))
    return psgs.select("doc_id", "psg_id", n.alias("size"), out.alias("score"))


def best_passages(scores: DataFrame) -> DataFrame:
    """(doc_id, psg_id, score): the best passage of each document, of equals the first."""
    best = scores.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("psg_id")).alias("k"))).alias("b"))
    return best.select("doc_id", (-F.col("b.k")).cast("int").alias("psg_id"), F.col("b.score").alias("score"))


def cosine_homogeneity(c: Collection, psgs: DataFrame) -> DataFrame:
    """(doc_id, h): mean cosine between the tf-idf vectors of a document and of its passages; long-form products, never a matrix.

    Weights are floor(ln(N / df) x tf + 0.5). A document or passage without weight has cosine 0.
    """
    _, n = Compiler(c).totals()
    idf = materialise(term_stats(c).select("term", "cf", F.log(F.lit(n) / F.col("df")).alias("idf")))
    total = int(idf.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0])
    docs = psgs.select("doc_id").distinct()
    tf = c.tokens.filter("term is not null").join(docs, "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    weight = F.floor(F.col("idf") * F.col("tf") + 0.5)
    d = skew_safe_lookup(tf, idf, "term", "cf", total).select("doc_id", "term", weight.alias("dw"))
    p = psgs.select("doc_id", "psg_id", F.explode("terms").alias("term")).groupBy("doc_id", "psg_id", "term").agg(F.count("*").alias("tf"))
    p = skew_safe_lookup(p, idf, "term", "cf", total).select("doc_id", "psg_id", "term", weight.alias("pw"))
    norms = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    dots = p.join(d, ["doc_id", "term"]).groupBy("doc_id", "psg_id").agg(F.sum(F.col("pw") * F.col("dw")).alias("dot"), F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pn"))
    cos = F.when((F.col("pn") > 0) & (F.col("dn") > 0), F.col("dot") / (F.col("pn") * F.col("dn"))).otherwise(0.0)
    return dots.join(norms, "doc_id").groupBy("doc_id").agg(F.avg(cos).alias("h"))


def length_homogeneity(lengths: DataFrame) -> DataFrame:
    """(doc_id, h): 1 - (ln length - ln min) / (ln max - ln min) over the given documents; 1 if all are equally long."""
    ends = lengths.agg(F.log(F.min("length").cast("double")).alias("lo"), F.log(F.max("length").cast("double")).alias("hi"))
    x = (F.log(F.col("length").cast("double")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return beside(lengths, ends).select("doc_id", F.when(F.col("hi") > F.col("lo"), 1 - x).otherwise(1.0).alias("h"))


def interpolated(results: DataFrame, best: DataFrame, homogeneity: DataFrame) -> DataFrame:
    """(doc_id, score): h x document score + (1 - h) x score of its best passage."""
    rows = results.select("doc_id", F.col("score").alias("d")).join(best.select("doc_id", F.col("score").alias("p")), "doc_id").join(homogeneity, "doc_id")
    return rows.select("doc_id", (F.col("h") * F.col("d") + (1 - F.col("h")) * F.col("p")).alias("score"))


def top_passages(scores: DataFrame, k: int) -> DataFrame:
    """The k best passages overall, one a document."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "psg_id")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").orderBy(F.desc("score"), "doc_id").limit(k)
