"""Hierarchical smoothing: every field's language model is mixed with its children's, bottom up, then with its parent's and the document's, top down."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.plans import ast as A
from lexigrove.plans.compile import Compiler, blocks_joined
from lexigrove.plans.extents import Extents, counted


@dataclass(frozen=True)
class Shrinkage:
    """lam: share of the collection; parent: of the parent's model; doc: of the document's; children: weight of a child field's
    model in its parent's (by field name, `default` for others), by length if by_length."""

    lam: float = 0.2
    parent: float = 0.2
    doc: float = 0.2
    default: float = 0.0
    children: dict[str, float] = field(default_factory=dict)
    by_length: bool = False


def smooth(nodes: list[tuple[int, int, str, int, float]], share: float, rules: Shrinkage) -> dict[int, float]:
    """Probability of the term by ordinal, for nodes (ordinal, parent, field, length, tf) of one document; the root's parent is 0."""
    length = {o: n for o, _, _, n, _ in nodes}
    name = {o: f for o, _, f, _, _ in nodes}
    parent = {o: p for o, p, _, _, _ in nodes}
    model = {o: (tf / n if n else 0.0) for o, _, _, n, tf in nodes}
    kids: dict[int, list[int]] = {}
    for o, p, *_ in nodes:
        if p in length and p != o:
            kids.setdefault(p, []).append(o)
    order, seen = [], set()
    stack = [o for o in length if parent[o] not in length or parent[o] == o]
    while stack:
        o = stack.pop()
        if o in seen:
            continue
        seen.add(o)
        order.append(o)
        stack += kids.get(o, [])
    for o in reversed(order):
        ws = [(rules.children.get(name[k], rules.default) * (length[k] if rules.by_length else 1.0), k) for k in kids.get(o, [])]
        total = sum(w for w, _ in ws)
        if total > 0:
            own = max(0.0, 1.0 - min(total, 1.0)) if not rules.by_length else length[o] / (length[o] + total)
            model[o] = own * model[o] + (1 - own) * sum(w * model[k] for w, k in ws) / total
    root = order[0] if order else None
    for o in order:
        p = parent[o]
        up = rules.parent if p in length and p != o else 0.0
        whole = rules.doc if o != root else 0.0
        rest = max(0.0, 1 - rules.lam - up - whole)
        model[o] = rest * model[o] + up * (model[p] if up else 0.0) + whole * (model[root] if whole else 0.0) + rules.lam * share
    return model


def leaf_models(compiler: Compiler, spots: DataFrame, leaf: A.Leaf, rules: Shrinkage, docs: DataFrame, fields: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """((doc_id, begin, end, p), p of extents outside these): the smoothed probability of a leaf with
    extents `spots` in every one of the fields (none: all) of the documents `docs`; of fields with equal extents the mean.

    The tree walk is a document's own work (applyInPandas by document); counts by field come from joins before it.
    """
    c = compiler.c
    total, _ = compiler.totals()
    occ = counted(spots, ["doc_id"], isinstance(leaf.extents, (A.Term, A.Empty))).agg(F.sum("tf")).first()[0] or 0.0
    share = occ / total if occ else 1 / (2 * max(total, 1))
    tree = c.fields.filter("ordinal > 0").select("doc_id", "field", "begin", "end", "ordinal", "parent")
    hits = blocks_joined(tree.filter("end > begin"), spots.select("doc_id", F.col("begin").alias("b"), F.col("end").alias("e"), "weight"), ["doc_id", "ordinal", "begin", "end"])
    tf = hits.groupBy("doc_id", "ordinal").agg(F.sum("weight").alias("tf"))
    rows = tree.join(docs, "doc_id", "left_semi").join(tf, ["doc_id", "ordinal"], "left").fillna(0.0, ["tf"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        model = smooth(list(zip(pdf["ordinal"], pdf["parent"], pdf["field"], pdf["end"] - pdf["begin"], pdf["tf"])), share, rules)
        kept = pdf[pdf["field"].isin(fields)] if fields else pdf
        return kept[["doc_id", "begin", "end"]].assign(p=[model[o] for o in kept["ordinal"]])

    made = rows.groupBy("doc_id").applyInPandas(walk, f"doc_id {dict(c.fields.dtypes)['doc_id']}, begin int, end int, p double")
    return made.groupBy("doc_id", "begin", "end").agg(F.avg("p").alias("p")), rules.lam * share


def shrinkage_scores(c: Collection, to: str, terms: list[str], rules: Shrinkage = Shrinkage()) -> DataFrame:
    """(doc_id, begin, end, score): mean log probability of the terms in each `to` field of documents that hold any of them.

    The tree walk is a document's own work (applyInPandas by document); counts by field come from joins before it.
    """
    total, _ = Compiler(c).totals()
    e = Extents(c)
    shares, parts = [], None
    tree = c.fields.filter("ordinal > 0").select("doc_id", "field", "begin", "end", "ordinal", "parent")
    for k, t in enumerate(terms):
        spots = e.of(A.Term(c.term(t) or ""))
        occ = counted(spots, ["doc_id"], True).agg(F.sum("tf")).first()[0] or 0.0
        shares.append(occ / total if occ else 1 / (2 * max(total, 1)))
        hit = tree.alias("f").join(spots.select("doc_id", F.col("begin").alias("p")), "doc_id").filter("p >= begin and p < end").groupBy("doc_id", "ordinal").agg(F.count("*").cast("double").alias("tf"))
        parts = hit.withColumn("k", F.lit(k)) if parts is None else parts.unionAll(hit.withColumn("k", F.lit(k)))
    docs = parts.select("doc_id").distinct()
    wide = parts.groupBy("doc_id", "ordinal").agg(*[F.sum(F.when(F.col("k") == k, F.col("tf"))).alias(f"t{k}") for k in range(len(terms))])
    rows = tree.join(docs, "doc_id", "left_semi").join(wide, ["doc_id", "ordinal"], "left").fillna(0.0, [f"t{k}" for k in range(len(terms))])
    kind = dict(c.fields.dtypes)["doc_id"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        models = [smooth(list(zip(pdf["ordinal"], pdf["parent"], pdf["field"], pdf["end"] - pdf["begin"], pdf[f"t{k}"])), s, rules) for k, s in enumerate(shares)]
        keep = pdf[pdf["field"] == to]
        score = [sum(math.log(max(m[o], 1e-300)) for m in models) / len(models) for o in keep["ordinal"]]
        return keep[["doc_id", "begin", "end"]].assign(score=score)

    return rows.groupBy("doc_id").applyInPandas(walk, f"doc_id {kind}, begin int, end int, score double")
