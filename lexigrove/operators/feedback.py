"""Relevance models, query expansion and clarity, from the results of a query."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.functions.scoring import Counts, Smoothing, score
from lexigrove.operators.inspect import stats_of, term_stats
from lexigrove.plans.compile import Compiler, Config, ranked
from lexigrove.plans.parser import parse
from lexigrove.session import beside, broadcast_if_small, materialise


def feedback_results(c: Collection, query: str, docs: int = 10, config: Config | None = None) -> DataFrame:
    """The best results, written, with `p`, their posterior: exponentials of the scores, less the greatest, over their sum."""
    top = materialise(ranked(Compiler(c, config).run(parse(query)), docs))
    return posteriors(top)


def tokens_of(c: Collection, results: DataFrame) -> DataFrame:
    """Token rows beside the results of their documents; results are broadcast while they are counted to be few."""
    rows = materialise(results)
    return c.tokens.join(broadcast_if_small(rows, rows.count()), "doc_id")


def posteriors(top: DataFrame) -> DataFrame:
    best = top.agg(F.max("score").alias("best"))
    e = beside(top, best).withColumn("e", F.exp(F.col("score") - F.col("best"))).drop("best")
    total = e.agg(F.sum("e").alias("total"))
    return beside(e, total).withColumn("p", F.col("e") / F.col("total")).drop("e", "total")


def relevance_model(c: Collection, results: DataFrame, max_grams: int = 1, mu: float = 0.0) -> DataFrame:
    """(gram, n, weight): for runs of 1..max_grams words of the results, the sum over results of p x P(gram | result).

    P is occurrences by length, or Dirichlet-smoothed if mu is set. Grams with a stopped slot or anything but ASCII letters and digits are left out.
    results have p, as from feedback_results.
    """
    r = results.select("doc_id", F.col("begin").alias("rb"), F.col("end").alias("re"), "p")
    t = tokens_of(c, r).filter("pos >= rb and pos < re")
    grams = None
    order = W.partitionBy("doc_id", "rb", "re").orderBy("pos")
    for n in range(1, max_grams + 1):
        words = F.array(*[F.col("term") if k == 0 else F.lead("term", k).over(order) for k in range(n)])
        rows = t.select("doc_id", "rb", "re", "p", words.alias("w")).filter(F.forall("w", lambda x: F.coalesce(x.rlike(r"\A[A-Za-z0-9]+\z"), F.lit(False))))
        rows = rows.select("doc_id", "rb", "re", "p", F.array_join("w", " ").alias("gram"), F.lit(n).alias("n"))
        grams = rows if grams is None else grams.unionAll(rows)
    tf = grams.groupBy("gram", "n", "doc_id", "rb", "re", "p").agg(F.count("*").alias("tf"))
    if not mu:
        return tf.groupBy("gram", "n").agg(F.sum(F.col("p") * F.col("tf") / (F.col("re") - F.col("rb"))).alias("weight"))
    total = Compiler(c).totals()[0] or 1.0
    tf = materialise(tf.filter("n = 1"))
    wide = tf.join(stats_of(c, tf.select(F.col("gram").alias("term"))).select(F.col("term").alias("gram"), "cf"), "gram")
    share = F.col("cf") / F.lit(total)
    seen = wide.groupBy("gram", "n").agg(F.sum(F.col("p") * (F.col("tf") + mu * share) / (F.col("re") - F.col("rb") + mu)).alias("seen"), F.sum(F.col("p") * mu * share / (F.col("re") - F.col("rb") + mu)).alias("base"), F.first(mu * share).alias("ms"))
    rest = r.agg(F.sum(F.col("p") / (F.col("re") - F.col("rb") + mu)).alias("k"))
    return beside(seen, rest).select("gram", "n", (F.col("seen") - F.col("base") + F.col("ms") * F.col("k")).alias("weight"))


def _quoted(terms: list[tuple[str, float]]) -> str:
    return " ".join(f'{w:.12g} "{t}"' for t, w in terms if w)


def _mixed(query: str, weight: float, terms: list[tuple[str, float]]) -> str:
    """The query beside weighted terms; without any term the query itself."""
    if not any(w for _, w in terms):
        return f"#combine( {query} )"
    return f"#weight( {weight:g} #combine( {query} ) {1 - weight:g} #weight( {_quoted(terms)} ) )"


def expand_rm(c: Collection, query: str, docs: int = 10, terms: int = 10, weight: float = 0.5, mu: float = 0.0, config: Config | None = None) -> str:
    """The query mixed with the strongest terms of its relevance model; a restriction of the outer operator moves outside."""
    model = relevance_model(c, feedback_results(c, query, docs, config), 1, mu)
    best = [(r["gram"], r["weight"]) for r in model.orderBy(F.desc("weight"), "gram").limit(terms).collect()]
    m = re.match(r"(\s*#\w+)\[([^\]]*)\](.*)", query, re.DOTALL)
    if m:
        return f"#combine[{m.group(2)}]( {_mixed(m.group(1) + m.group(3), weight, best)} )"
    return _mixed(query, weight, best)


def ponte_model(c: Collection, results: DataFrame, mu: float = 0.0) -> DataFrame:
    """(term, odds, weight) of terms that occur twice or more in a result: summed log odds against the collection, and summed e^score x P(term | result)."""
    total = Compiler(c).totals()[0] or 1.0
    t = tokens_of(c, results.select("doc_id", "score")).filter("term is not null")
    tf = materialise(t.groupBy("term", "doc_id", "score").agg(F.count("*").alias("tf")).filter("tf >= 2"))
    rows = tf.join(c.lengths(), "doc_id").join(stats_of(c, tf), "term")
    share = F.col("cf") / F.lit(total)
    return rows.groupBy("term").agg(F.sum(F.log(F.col("tf") / F.col("length") / share)).alias("odds"), F.sum(F.exp("score") * (F.col("tf") + mu * share) / (F.col("length") + mu)).alias("weight"))


def expand_ponte(c: Collection, query: str, docs: int = 10, terms: int = 10, weight: float = 0.5, mu: float = 0.0, config: Config | None = None) -> str:
    top = ranked(Compiler(c, config).run(parse(query)), docs)
    best = [(r["term"], r["weight"]) for r in ponte_model(c, top, mu).orderBy(F.desc("odds"), "term").limit(terms).collect()]
    return _mixed(query, weight, best)


def rocchio_model(c: Collection, results: DataFrame, docs: int, k1: float = 1.2, b: float = 0.75, weight: float = 0.5) -> DataFrame:
    """(term, weight): mean over results of BM25 term frequency x idf, times weight; idf = ln((N + 1) / (df + 0.5))."""
    total, n = Compiler(c).totals()
    tf = materialise(tokens_of(c, results.select("doc_id")).filter("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("tf")))
    rows = tf.join(c.lengths(), "doc_id").join(stats_of(c, tf), "term")
    bm = k1 * F.col("tf") / (F.col("tf") + k1 * (1 - b) + k1 * b * F.col("length") / (total / n if n else 1.0))
    idf = F.log(F.lit(n + 1) / (F.col("df") + 0.5))
    count = results.agg(F.count("*").alias("k"))
    return beside(rows.groupBy("term").agg(F.sum(bm * idf).alias("s")), count).select("term", (F.col("s") / F.least(F.col("k"), F.lit(docs)) * weight).alias("weight"))


def expand_rocchio(c: Collection, query: str, docs: int = 10, terms: int = 10, weight: float = 0.5, k1: float = 1.2, b: float = 0.75, config: Config | None = None) -> str:
    """The query's own terms by idf and frequency, raised by the strongest terms of its results, and those terms."""
    _, n = Compiler(c).totals()
    words = [t for t in (c.term(w) for w in re.findall(r"\w+", query)) if t]
    df = {r["term"]: r["df"] for r in term_stats(c).filter(F.col("term").isin(words)).collect()}
    model: dict[str, float] = {}
    for w in dict.fromkeys(words):
        if w in df:
            q = words.count(w)
            idf = math.log((n + 1) / (df[w] + 0.5))
            model[w] = idf * 1000 * q / (q + 1000)
    top = ranked(Compiler(c, config).run(parse(query)), docs)
    for r in rocchio_model(c, top, docs, k1, b, weight).orderBy(F.desc("weight"), "term").limit(terms).collect():
        model[r["term"]] = model.get(r["term"], 0.0) + r["weight"]
    return f"#weight( {_quoted(sorted(model.items()))} )" if any(model.values()) else query


def clarity(c: Collection, query: str, docs: int = 5, terms: int | None = 10, mu: float = 0.0, config: Config | None = None) -> DataFrame:
    """(term, weight, part): of the strongest terms of the relevance model (None: of all), weight x log2(weight / collection share); the query's clarity is the sum of parts by the sum of weights."""
    model = relevance_model(c, feedback_results(c, query, docs, config), 1, mu)
    if terms is not None:
        model = model.orderBy(F.desc("weight"), "gram").limit(terms)
    total = Compiler(c).totals()[0] or 1.0
    model = materialise(model.withColumnRenamed("gram", "term"))
    rows = model.join(stats_of(c, model), "term")
    return rows.select("term", "weight", (F.col("weight") * F.log2(F.col("weight") / (F.col("cf") / F.lit(total)))).alias("part"))


def clarity_score(c: Collection, query: str, **options) -> DataFrame:
    """One row (clarity); 0 for a query without results."""
    return clarity(c, query, **options).agg(F.coalesce(F.sum("part") / F.sum("weight"), F.lit(0.0)).alias("clarity"))


def dirichlet(tf, length, cf: float, total: float, mu: float = 2500.0):
    """A single term's score, for passages and streams."""
    return score(Smoothing("dirichlet", {"mu": mu}), tf, length, Counts(cf, total, 0, 0, 0), True)
