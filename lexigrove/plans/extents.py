"""Unscored nodes -> DataFrame(doc_id, begin, end, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.plans import ast as A
from lexigrove.session import materialise

#: Terms that a wildcard may stand for.
WILDCARD_TERMS = 100

COLUMNS = ["doc_id", "begin", "end", "weight"]


class Extents:
    """Compiles extent nodes over one collection; equal nodes are compiled once."""

    def __init__(self, collection: Collection, wildcard_terms: int = WILDCARD_TERMS, window_weight: str = "rest") -> None:
        self.c = collection
        self.limit = wildcard_terms
        self.all_weights = window_weight == "all"  # else a window's weight leaves out its first child's
        self.done: dict[A.Node, DataFrame] = {}

    def of(self, node: A.Node) -> DataFrame:
        if node not in self.done:
            self.done[node] = self.make(node)
        return self.done[node]

    def make(self, node: A.Node) -> DataFrame:
        t = self.c.tokens
        one = F.lit(1.0)
        spot = [F.col("pos").alias("begin"), (F.col("pos") + 1).alias("end")]
        if isinstance(node, A.Term):
            return t.filter(F.col("term") == node.text).select("doc_id", *spot, one.alias("weight"))
        if isinstance(node, A.Wildcard):
            terms = t.filter(F.col("term").startswith(node.prefix)).select("term").distinct().limit(self.limit + 1).count()
            if terms > self.limit:
                raise ValueError(f"{node.prefix}* stands for more than {self.limit} terms")
            return t.filter(F.col("term").startswith(node.prefix)).select("doc_id", *spot, one.alias("weight"))
        if isinstance(node, A.Empty):
            return t.filter(F.lit(False)).select("doc_id", *spot, one.alias("weight"))
        if isinstance(node, A.AnyField):
            f = self.c.fields
            f = f.filter(F.col("field") != "document").dropDuplicates(["doc_id", "begin", "end"]) if node.name == "*" else f.filter(F.col("field") == node.name)
            return f.select("doc_id", "begin", "end", one.alias("weight"))
        if isinstance(node, A.Compare):
            f = self.c.fields.filter((F.col("field") == node.field) & F.col("number").isNotNull())
            if node.low is not None:
                f = f.filter(F.col("number") >= node.low)
            if node.high is not None:
                f = f.filter(F.col("number") <= node.high)
            return f.select("doc_id", "begin", "end", one.alias("weight"))
        if isinstance(node, A.Syn):
            return reduce(DataFrame.unionAll, [self.of(c) for c in node.children])
        if isinstance(node, A.WSyn):
            parts = [self.of(c).withColumn("weight", F.col("weight") * w) for w, c in zip(node.weights, node.children)]
            return reduce(DataFrame.unionAll, parts)
        if isinstance(node, A.Ordered):
            return self.ordered(node)
        if isinstance(node, A.Unordered):
            return self.unordered(node)
        if isinstance(node, A.Both):
            return reduce(overlap, [self.of(c) for c in node.children])
        if isinstance(node, A.Inside):
            return inside(self.of(node.inner), self.of(node.outer), product=True)
        if isinstance(node, A.Path):
            return self.path(node)
        raise TypeError(f"no extents of {type(node).__name__}")

    def ordered(self, node: A.Ordered) -> DataFrame:
        """Children in order, each the first that begins at or after the end of the one before and near enough to it.

        Width 1 over single terms is a chain of equi-joins on (document, position); else each child's extents are
        sorted in with the windows so far, by document and from its end on, so that the next one is the last one seen: one pass.
        """
        parts = [self.of(c) for c in node.children]
        out = parts[0] if self.all_weights else parts[0].withColumn("weight", F.lit(1.0))
        exact = node.width == 1 and all(isinstance(c, A.Term) for c in node.children)
        for right in parts[1:]:
            if exact:
                r = right.select("doc_id", F.col("begin").alias("end"), F.col("end").alias("to"), F.col("weight").alias("w"))
                out = out.join(r, ["doc_id", "end"]).select("doc_id", "begin", F.col("to").alias("end"), (F.col("weight") * F.col("w")).alias("weight"))
                continue
            left = out.select("doc_id", F.col("end").alias("at"), F.lit(0).alias("kind"), F.struct("begin", "end", "weight").alias("x"))
            both = left.unionAll(right.select("doc_id", F.col("begin").alias("at"), F.lit(1).alias("kind"), F.struct("begin", "end", "weight").alias("x")))
            ahead = W.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("x.end")).rowsBetween(W.unboundedPreceding, -1)
            both = both.withColumn("n", F.last(F.when(F.col("kind") == 1, F.col("x")), ignorenulls=True).over(ahead)).filter((F.col("kind") == 0) & F.col("n").isNotNull())
            if node.width >= 0:
                both = both.filter(F.col("n.begin") - F.col("at") + 1 <= node.width)
            out = both.select("doc_id", "x.begin", F.col("n.end").alias("end"), (F.col("x.weight") * F.col("n.weight")).alias("weight"))
        return out

    def unordered(self, node: A.Unordered) -> DataFrame:
        """From each child extent on, the first extent of every child; a window if it ends within the width. Sorted from the document's end on: one pass."""
        n = len(node.children)
        rows = reduce(DataFrame.unionAll, [self.of(c).select(*COLUMNS, F.lit(k).alias("k")) for k, c in enumerate(node.children)])
        ahead = W.partitionBy("doc_id").orderBy(F.desc("begin"), F.desc("k"), F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
        firsts = [F.last(F.when(F.col("k") == k, F.struct("end", "weight")), ignorenulls=True).over(ahead).alias(f"n{k}") for k in range(n)]
        rows = rows.select("doc_id", "begin", *firsts).dropna(subset=[f"n{k}" for k in range(n)])
        end = F.greatest(*[F.col(f"n{k}.end") for k in range(n)]) if n > 1 else F.col("n0.end")
        weight = reduce(lambda a, b: a * b, [F.col(f"n{k}.weight") for k in range(0 if self.all_weights else 1, n)], F.lit(1.0))
        rows = rows.select("doc_id", "begin", end.alias("end"), weight.alias("weight"))
        return rows.filter(F.col("end") - F.col("begin") <= node.width) if node.width >= 0 else rows

    def path(self, node: A.Path) -> DataFrame:
        f = self.c.fields
        name = f.filter(F.col("field") == node.name) if node.name != "*" else f
        if node.axis == "inside":
            return inside(name.select("doc_id", "begin", "end", F.lit(1.0).alias("weight")), self.of(node.outer))
        outer = self.outer_fields(node.outer)
        out = name.alias("i").select("doc_id", "begin", "end", "ordinal", "parent")
        if node.axis == "child":
            found = out.join(outer.select("doc_id", F.col("ordinal").alias("parent")).distinct(), ["doc_id", "parent"], "left_semi")
        elif node.axis == "parent":
            found = out.join(outer.select("doc_id", F.col("parent").alias("ordinal")).distinct(), ["doc_id", "ordinal"], "left_semi")
        else:
            found = descendants(f, outer).join(out, ["doc_id", "ordinal"])
        return found.select("doc_id", "begin", "end", F.lit(1.0).alias("weight"))

    def outer_fields(self, node: A.Node) -> DataFrame:
        """Field rows, with ordinals, of the extents that a path starts from."""
        f = self.c.fields
        if isinstance(node, A.AnyField):
            return f.filter(F.col("field") == node.name)
        if isinstance(node, A.Path):
            return f.join(self.path(node).select("doc_id", "begin", "end").distinct(), ["doc_id", "begin", "end"], "left_semi").filter(F.col("field") == node.name)
        return f.join(self.of(node).select("doc_id", "begin", "end").distinct(), ["doc_id", "begin", "end"], "left_semi")


def descendants(fields: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc_id, ordinal) of all fields below the outer ones: one written join a level, until a level brings none.

    Ordinals count from 1; fields without one (0) have no place in the tree. Parents that form a ring end the walk too.
    """
    tree = fields.filter("ordinal > 0 and parent > 0").select("doc_id", "ordinal", "parent")
    level = outer.filter("ordinal > 0").select("doc_id", "ordinal").distinct()
    found = None
    while True:
        level = tree.join(level.select("doc_id", F.col("ordinal").alias("parent")), ["doc_id", "parent"]).select("doc_id", "ordinal").distinct()
        if found is not None:
            level = level.join(found, ["doc_id", "ordinal"], "left_anti")
        level = materialise(level)
        found = level if found is None else found.unionAll(level)
        if level.isEmpty():
            return found


def inside(inner: DataFrame, outer: DataFrame, product: bool = False) -> DataFrame:
    """inner extents contained in some outer one; empty outer extents contain nothing. With product, weights are multiplied by that of the
    outer extent that reaches furthest.

    Outer extents that may nest are first merged to the longest reach so far, so that one equi-join on documents and a
    frame suffice: sorted by begin, an inner extent is inside if the furthest outer end before it is at or after its own.
    """
    i = inner.select("doc_id", "begin", "end", "weight", F.lit(1).alias("kind"))
    o = outer.filter("end > begin").select("doc_id", "begin", "end", "weight", F.lit(0).alias("kind"))
    upto = W.partitionBy("doc_id").orderBy("begin", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = i.unionAll(o).withColumn("reach", F.max(F.when(F.col("kind") == 0, F.struct("end", "weight"))).over(upto)).filter("kind = 1 and reach.end >= end")
    return rows.select("doc_id", "begin", "end", (F.col("weight") * F.col("reach.weight")).alias("weight") if product else "weight")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersections of extents, touching pieces merged."""
    x, y = a.alias("x"), b.alias("y")
    cut = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.begin") < F.col("y.end")) & (F.col("y.begin") < F.col("x.end")))
    cut = cut.select(F.col("x.doc_id").alias("doc_id"), F.greatest("x.begin", "y.begin").alias("begin"), F.least("x.end", "y.end").alias("end"))
    order = W.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = cut.withColumn("new", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
    cut = cut.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return cut.groupBy("doc_id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end", F.lit(1.0).alias("weight"))


def weight_fold(extents):
    """Sum of weights of a sorted array<struct<begin,end,weight>>, leaving out extents that begin before the last counted one's end."""
    start = F.struct(F.lit(-1).alias("to"), F.lit(0.0).alias("sum"))
    step = lambda s, e: F.when(e["begin"] < s["to"], s).otherwise(F.struct(e["end"].alias("to"), (s["sum"] + e["weight"]).alias("sum")))
    return F.aggregate(extents, start, step)["sum"]


def counted(extents: DataFrame, keys: list[str], single: bool) -> DataFrame:
    """(keys, tf): extents of each key, those that overlap an earlier counted one left out; single terms never overlap."""
    if single:
        return extents.groupBy(*keys).agg(F.sum("weight").alias("tf"))
    rows = extents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "weight"))).alias("x"))
    return rows.select(*keys, weight_fold(F.col("x")).alias("tf"))
