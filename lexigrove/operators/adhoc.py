"""Ad-hoc runs: topics, each ranked by documents and their best passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.operators import passages
from lexigrove.operators.reformulate import friendly
from lexigrove.plans.compile import Compiler, Config
from lexigrove.plans.parser import parse
from lexigrove.session import materialise


def run_topics(c: Collection, topics: list[dict], k: int = 1000, size: int = 150, overlap: int = 50, mu: float = 2500.0, config: Config | None = None) -> DataFrame:
    """(topic, rank, doc_id, score): the k best documents of each topic {number, query}, by the score of the document and that of its best passage,
    mixed by how long the document is beside the collection's; of equals the greater doc_id first.

    Passages are cut once for the documents that any topic finds; a topic's plan is one union with the others', so that they run side by side.
    A topic without terms finds nothing.
    """
    found, terms = [], {}
    for t in topics:
        words = [w for w in (c.term(x) for x in friendly(t["query"].lower()).split()) if w]
        if words:
            terms[t["number"]] = list(dict.fromkeys(words))
            found.append(Compiler(c, config).run(parse(friendly(t["query"].lower()))).select(F.lit(t["number"]).alias("topic"), "doc_id", "score"))
    if not found:
        return c.docs.select(F.lit("").alias("topic"), F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    results = materialise(reduce(DataFrame.unionAll, found))
    cut = materialise(passages.passages(c, size, overlap, results))
    best = [passages.best_passages(passages.passage_scores(c, cut, ws, mu)).select(F.lit(n).alias("topic"), "doc_id", F.col("score").alias("p")) for n, ws in terms.items()]
    h = passages.length_homogeneity(c.lengths())
    rows = results.join(reduce(DataFrame.unionAll, best), ["topic", "doc_id"]).join(h, "doc_id")
    rows = rows.select("topic", "doc_id", (F.col("h") * F.col("score") + (1 - F.col("h")) * F.col("p")).alias("score"))
    order = W.partitionBy("topic").orderBy(F.round("score", 9).desc(), F.desc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("topic", "rank", "doc_id", "score")
