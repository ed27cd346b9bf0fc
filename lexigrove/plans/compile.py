"""Scored nodes -> one DataFrame(doc_id, begin, end, score).

Phase 1 counts every leaf over the collection in one aggregation; phase 2 joins leaves to candidates, one shuffle by
document, and folds the belief tree into one Column, in which NULL says that a node has no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.functions.scoring import Counts, Smoothing, choose, score
from lexigrove.plans import ast as A
from lexigrove.plans import rewrite
from lexigrove.plans.extents import Extents, counted, inside

#: Log probability of documents that a prior doesn't list.
NO_PRIOR = -1e100

ORDER = ["score", "doc_id", "begin", "end"]


@dataclass
class Config:
    rules: list[str] = field(default_factory=list)
    baseline: str | None = None  # tfidf or okapi
    single_background: bool = False  # counts leave contexts out of account
    wildcard_terms: int = 100
    window_weight: str = "rest"
    score_siblings: bool = False  # extents without a match are scored too, in documents with one
    shrinkage: object | None = None  # operators.shrinkage.Shrinkage: leaves in restrictions are smoothed over the document's tree


@dataclass
class Part:
    """What a node gives for a unit: sum, number, greatest and summed exponentials of its results, and log of prod(1 - e^s)."""

    total: Column
    count: Column
    top: Column
    exps: Column
    none: Column

    @staticmethod
    def one(s: Column) -> Part:
        return Part(s, F.when(s.isNotNull(), 1).otherwise(0), s, F.exp(s), F.log1p(-F.exp(s)))


class Compiler:
    def __init__(self, collection: Collection, config: Config | None = None) -> None:
        self.c = collection
        self.config = config or Config()
        self.extents = Extents(collection, self.config.wildcard_terms, self.config.window_weight)
        self._totals: tuple[float, float] | None = None
        self._context: dict[A.Node | None, float] = {}

    # -- phase 1

    def totals(self) -> tuple[float, float]:
        """Tokens and documents of the collection, deleted ones included."""
        if self._totals is None:
            row = self.c.lengths().agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
            self._totals = float(row[0]), float(row[1])
        return self._totals

    @staticmethod
    def single(leaf: A.Leaf) -> bool:
        return isinstance(leaf.extents, (A.Term, A.Empty)) and leaf.context is None

    def matches(self, leaf: A.Leaf) -> DataFrame:
        found = self.extents.of(leaf.extents)
        return inside(found, self.extents.of(leaf.context)) if leaf.context is not None else found

    def counts(self, leaves: list[A.Leaf]) -> dict[A.Leaf, Counts]:
        """Occurrences and documents of every leaf by one job over the union of their extents; sizes of contexts by one other."""
        if not leaves:
            return {}
        parts = []
        single = {leaf.extents.text: k for k, leaf in enumerate(leaves) if isinstance(leaf.extents, A.Term) and (leaf.context is None or self.config.single_background)}
        if single:  # all plain terms by one scan and one shuffle
            tf = self.term_rows(list(single)).groupBy("term", "doc_id").agg(F.count("*").cast("double").alias("tf"))
            parts.append(tf.select(_lookup(single, F.col("term")).alias("k"), "tf"))
        for k, leaf in enumerate(leaves):
            use = A.Leaf(leaf.extents) if self.config.single_background else leaf
            if isinstance(use.extents, A.Term) and use.context is None:
                continue
            tf = counted(self.matches(use), ["doc_id"], isinstance(use.extents, (A.Term, A.Empty)))
            parts.append(tf.select(F.lit(k).alias("k"), "tf"))
        rows = {r[0]: r for r in reduce(DataFrame.unionAll, parts).groupBy("k").agg(F.sum("tf"), F.count("*")).collect()}
        size, n = self.totals()
        contexts = [c for c in dict.fromkeys(leaf.context for leaf in leaves) if c is not None and c not in self._context] if not self.config.single_background else []
        if contexts:
            sizes = [self.extents.of(c).select(F.lit(k).alias("k"), (F.col("end") - F.col("begin")).alias("s")) for k, c in enumerate(contexts)]
            found = {r[0]: r[1] for r in reduce(DataFrame.unionAll, sizes).groupBy("k").agg(F.sum("s")).collect()}
            self._context |= {c: float(found.get(k) or 0) for k, c in enumerate(contexts)}
        out = {}
        for k, leaf in enumerate(leaves):
            r = rows.get(k)
            context = size if leaf.context is None or self.config.single_background else self._context[leaf.context]
            out[leaf] = Counts(float(r[1]) if r else 0.0, context, float(r[2]) if r else 0.0, n, size / n if n else 0.0)
        return out

    def term_rows(self, terms: list[str]) -> DataFrame:
        return self.c.tokens.filter(F.col("term").isin(terms)).select("doc_id", "term")

    # -- phase 2

    def run(self, node: A.Node, doc_ids: DataFrame | None = None) -> DataFrame:
        """All results of the query, unordered."""
        node = rewrite.prepare(node, self.c.term)
        if self.config.baseline:
            node = rewrite.as_baseline(node)
        if isinstance(node, A.Include):
            out = self.included(node, doc_ids)
        else:
            units, child = self.units(node)
            out = self.scored(child, units, doc_ids, fields=_targets(node))
        if self.c.deleted is not None:
            out = out.join(self.c.deleted, "doc_id", "left_anti")
        return out

    def units(self, node: A.Node):
        """(scored units: None for whole documents, a Passages node, or extents; what is scored in them)."""
        if isinstance(node, A.Restrict):
            return self.extents.of(node.to), node.child
        if isinstance(node, A.Passages):
            return node, node.child
        return None, node

    def included(self, node: A.Include, doc_ids: DataFrame | None = None) -> DataFrame:
        """Results of the inner restriction, each halfway between its own score and that of the context in the outer extents around it."""
        inner = self.scored(node.inner.child, self.extents.of(node.inner.to), doc_ids, fields=_targets(node.inner))
        keys = ["doc_id", "begin", "end"]
        outer = blocks_joined(self.extents.of(node.outer).filter("end > begin"), inner.select("doc_id", F.col("begin").alias("b"), F.col("end").alias("e"), F.col("score").alias("own")), keys)
        around = self.scored(node.context, outer.select(*keys).distinct().withColumn("weight", F.lit(1.0)), every=True, fields=_targets(A.Restrict(node.outer, node.context)))
        rows = outer.join(around.withColumnRenamed("score", "context"), keys)
        return rows.select("doc_id", F.col("b").alias("begin"), F.col("e").alias("end"), (0.5 * F.col("own") + 0.5 * F.col("context")).alias("score"))

    def scored(self, node: A.Node, units: DataFrame | A.Passages | None, doc_ids: DataFrame | None = None, every: bool = False, fields: tuple[str, ...] = ()) -> DataFrame:
        """Results in the units, which are extents of `fields`; only units that a leaf occurs in, or with every (units are extents) all of them."""
        whole, cut = units is None, isinstance(units, A.Passages)
        keys = ["doc_id"] if whole else ["doc_id", "begin", "end"]
        leaves: dict[A.Leaf, int] = {}
        filters: dict[A.Node, int] = {}
        priors: dict[str, int] = {}
        nested: dict[A.Node, int] = {}
        _gather(node, leaves, filters, priors, nested)
        counts = self.counts(list(leaves))
        fitting = _positive(node)
        parts = []
        if not whole and not cut:
            units = units.filter("end > begin").groupBy(*keys).agg(F.max("weight").alias("unit_weight"))
        shrunk = self.config.shrinkage is not None and not whole and not cut
        models: dict[A.Leaf, float] = {}
        if shrunk and leaves:
            held = reduce(DataFrame.unionAll, [self.matches(leaf).select("doc_id") for leaf in leaves]).distinct()
        plain = {leaf.extents.text: (k, leaf in fitting) for leaf, k in leaves.items() if whole and isinstance(leaf.extents, A.Term) and leaf.context is None}
        if plain:  # occurrences add up in the one aggregation by document below
            what = _lookup({t: f"t{k}" for t, (k, _) in plain.items()}, F.col("term"))
            fits = _lookup({t: fit for t, (_, fit) in plain.items()}, F.col("term"))
            parts.append(self.term_rows(list(plain)).select("doc_id", what.alias("what"), F.lit(1.0).alias("tf"), fits.alias("fits")))
        for leaf, k in leaves.items():
            if whole and isinstance(leaf.extents, A.Term) and leaf.context is None:
                continue
            single = isinstance(leaf.extents, (A.Term, A.Empty))
            rows = self.matches(leaf)
            if shrunk:
                from lexigrove.operators.shrinkage import leaf_models

                model, models[leaf] = leaf_models(self, rows, leaf, self.config.shrinkage, held, fields)
                parts.append(units.select(*keys).join(model, keys).select(*keys, F.lit(f"m{k}").alias("what"), F.col("p").alias("tf"), F.lit(False).alias("fits")))
            if not whole:
                rows = contained(rows, units, keys)
            tf = counted(rows, keys, single) if whole else counted_in(rows, keys, single)
            parts.append(tf.select(*keys, F.lit(f"t{k}").alias("what"), "tf", F.lit(leaf in fitting).alias("fits")))
            if leaf.context is not None and whole:
                size = self.extents.of(leaf.context).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).cast("double").alias("tf"))
                parts.append(size.select("doc_id", F.lit(f"l{k}").alias("what"), "tf", F.lit(False).alias("fits")))
        for f, k in filters.items():
            rows = self.extents.of(f)
            if not whole:
                rows = contained(rows, units, keys)
            parts.append(rows.groupBy(*keys).agg(F.count("*").cast("double").alias("tf")).select(*keys, F.lit(f"f{k}").alias("what"), "tf", F.lit(False).alias("fits")))
        if not parts:
            parts.append(self.c.lengths().select("doc_id", *([] if whole else [F.lit(0).alias("begin"), F.lit(0).alias("end")]), F.lit("none").alias("what"), F.lit(0.0).alias("tf"), F.lit(False).alias("fits")))
        rows = reduce(DataFrame.unionAll, parts)
        names = [f"t{k}" for k in leaves.values()] + [f"m{leaves[leaf]}" for leaf in models] + [f"l{k}" for leaf, k in leaves.items() if leaf.context is not None and whole] + [f"f{k}" for k in filters.values()]
        wide = rows.groupBy(*keys).agg(F.max("fits").alias("fits"), *[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("tf"))), F.lit(0.0)).alias(n) for n in names])
        if nested:
            for sub, k in nested.items():
                results = self.nested(sub, units)
                wide = wide.join(results.withColumnsRenamed({"fits": f"fits{k}", **{c: f"{c}{k}" for c in ("total", "count", "top", "exps", "none")}}), keys, "full")
                wide = wide.withColumn("fits", F.coalesce("fits", F.lit(False)) | F.coalesce(F.col(f"count{k}") > 0, F.lit(False))).fillna(0.0, names)
        if doc_ids is not None:
            ids = doc_ids.select("doc_id").distinct()
            wide = ids.join(wide, "doc_id", "left").withColumn("fits", F.lit(True)).fillna(0.0, names) if whole else wide.join(ids, "doc_id", "left_semi")
        if not whole and not cut and (every or self.config.score_siblings):
            all_units = units.select(*keys)
            if not every:
                all_units = all_units.join(wide.filter("fits").select("doc_id").distinct(), "doc_id", "left_semi")
            wide = all_units.join(wide, keys, "left").withColumn("fits", F.lit(True)).fillna(0.0, names)
        wide = wide.filter("fits") if not whole or doc_ids is None else wide
        lengths = self.c.lengths()
        wide = wide.join(lengths, "doc_id")
        if cut:
            wide = wide.withColumn("end", F.least("end", F.col("length")).cast("int")).filter("end > begin")
        deep = {leaf: k for leaf, k in leaves.items() if leaf not in models and self.smoothing(leaf, whole, shrunk).document_level and not (whole and leaf.context is None)}
        if deep:  # the document's own occurrences, for models with a document level
            levels = [counted(self.extents.of(leaf.extents), ["doc_id"], isinstance(leaf.extents, (A.Term, A.Empty))).select("doc_id", F.lit(k).alias("k"), "tf") for leaf, k in deep.items()]
            level = reduce(DataFrame.unionAll, levels).groupBy("doc_id").agg(*[F.sum(F.when(F.col("k") == k, F.col("tf"))).alias(f"d{k}") for k in deep.values()])
            wide = wide.join(level, "doc_id", "left").fillna(0.0, [f"d{k}" for k in deep.values()])
        for name, k in priors.items():
            p = self.c.priors.filter(F.col("name") == name).select("doc_id", F.col("logprob").alias(f"p{k}"))
            wide = wide.join(p, "doc_id", "left").withColumn(f"p{k}", F.coalesce(f"p{k}", F.lit(NO_PRIOR)))
        size = F.col("length") if whole else F.col("end") - F.col("begin")

        def part(n: A.Node, qtf: float = 1.0) -> Part:
            if isinstance(n, A.Leaf):
                k = leaves[n]
                if n in models:
                    return Part.one(F.log(F.greatest(F.when(F.col(f"m{k}") > 0, F.col(f"m{k}")).otherwise(models[n]), F.lit(1e-300))))
                own = F.col(f"l{k}") if n.context is not None and whole else size
                of_doc = (F.col(f"d{k}"), F.col("length")) if n in deep else (None, None)
                return Part.one(score(self.smoothing(n, whole, shrunk), F.col(f"t{k}"), own, counts[n], whole and self.single(n), qtf, *of_doc))
            if n in nested:
                k = nested[n]
                return Part(*[F.col(f"{c}{k}") for c in ("total", "count", "top", "exps", "none")])
            if isinstance(n, A.Prior):
                return Part.one(F.col(f"p{priors[n.name]}"))
            if isinstance(n, A.Not):
                return Part.one(F.log1p(-F.exp(part(n.child).total)))
            if isinstance(n, A.LengthPrior):
                s = part(n.child).total
                return Part.one(s + n.exponent * F.log(F.greatest(size, F.lit(1e-10))))
            if isinstance(n, A.Filter):
                has = F.col(f"f{filters[n.condition]}") > 0
                inner = part(n.child)
                ok = has if n.keep else ~has
                return Part(*[F.when(ok, c) for c in (inner.total, inner.count, inner.top, inner.exps, inner.none)])
            if isinstance(n, A.Max):
                tops = [part(c).top for c in n.children]
                return Part.one(F.greatest(*tops) if len(tops) > 1 else tops[0])
            if isinstance(n, A.Or):
                nones = [F.coalesce(part(c).none, F.lit(0.0)) for c in n.children]
                return Part.one(F.log(1 - F.exp(reduce(lambda a, b: a + b, nones))))
            if isinstance(n, A.Plus):
                return Part.one(reduce(lambda a, b: a + b, [part(c, q).total for q, c in zip(n.frequencies, n.children)]))
            if isinstance(n, A.Weighted):
                inner = [part(c) for c in n.children]
                base = reduce(lambda a, b: a + b, [abs(w) * F.coalesce(p.count, F.lit(0)) for w, p in zip(n.weights, inner)])
                of = "total" if n.kind == "and" else "exps"
                top = reduce(lambda a, b: a + b, [F.coalesce(w * getattr(p, of), F.lit(0.0)) for w, p in zip(n.weights, inner)])
                mean = F.when(base > 0, top / base)
                return Part.one(mean if n.kind == "and" else F.log(mean))
            raise TypeError(f"no score of {type(n).__name__}")

        final = part(node).total
        if not whole and not cut:
            wide = wide.join(units, keys)
            final = final + F.when(F.col("unit_weight") != 1, F.log("unit_weight")).otherwise(0.0)
        span = [F.lit(0).alias("begin"), F.col("length").cast("int").alias("end")] if whole else ["begin", "end"]
        return wide.select("doc_id", *span, final.alias("score")).filter(F.col("score").isNotNull())

    def nested(self, node: A.Node, outer: DataFrame | None) -> DataFrame:
        """Results of a restriction or of passages within a belief, summed up by the unit around them."""
        units, child = self.units(node)
        inner = self.scored(child, units, fields=_targets(node))
        if outer is not None:
            inner = contained(inner.withColumn("weight", F.lit(1.0)), outer, ["doc_id", "begin", "end"], extra=["score"])
        keys = ["doc_id"] if outer is None else ["doc_id", "begin", "end"]
        s = F.col("score")
        return inner.groupBy(*keys).agg(F.sum(s).alias("total"), F.count("*").alias("count"), F.max(s).alias("top"), F.sum(F.exp(s)).alias("exps"), F.sum(F.log1p(-F.exp(s))).alias("none"))

    def smoothing(self, leaf: A.Leaf, whole: bool = True, shrunk: bool = False) -> Smoothing:
        if self.config.baseline:
            rule = next((r for r in self.config.rules), "")
            return Smoothing.of(f"{rule},method:{self.config.baseline}")
        kind = "window" if isinstance(leaf.extents, (A.Ordered, A.Unordered)) else "term"
        names = [n.name for n in _all(leaf) if isinstance(n, A.AnyField)]
        return choose(self.config.rules, kind, tuple(names), "shrinkage" if shrunk else "raw" if whole else "nested")


def _targets(node: A.Node) -> tuple[str, ...]:
    """Names of the fields that a restriction's units are extents of; none: any."""

    def names(to: A.Node) -> list[str]:
        if isinstance(to, (A.AnyField, A.Path)):
            return [to.name]
        if isinstance(to, A.Inside):
            return names(to.inner)
        return [n for c in A.children(to) for n in names(c)]

    found = names(node.to) if isinstance(node, A.Restrict) else []
    return () if "*" in found else tuple(found)


def _lookup(table: dict, key: Column) -> Column:
    """A query's few literals as a map."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _all(node: A.Node) -> list[A.Node]:
    return [node] + [x for c in A.children(node) for x in _all(c)]


def _gather(node: A.Node, leaves: dict, filters: dict, priors: dict, nested: dict) -> None:
    if isinstance(node, A.Leaf):
        leaves.setdefault(node, len(leaves))
    elif isinstance(node, (A.Restrict, A.Passages)):
        nested.setdefault(node, len(nested))
    elif isinstance(node, A.Prior):
        priors.setdefault(node.name, len(priors))
    elif isinstance(node, A.Filter):
        filters.setdefault(node.condition, len(filters))
        _gather(node.child, leaves, filters, priors, nested)
    else:
        for c in A.children(node):
            _gather(c, leaves, filters, priors, nested)


def _positive(node: A.Node) -> set[A.Node]:
    """Leaves that make a document a candidate: all but those below #not."""
    if isinstance(node, A.Not):
        return set()
    if isinstance(node, A.Leaf):
        return {node}
    if isinstance(node, A.Filter):
        return _positive(node.child)
    return {x for c in A.children(node) for x in _positive(c)}


def contained(rows: DataFrame, units: DataFrame | A.Passages, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """rows (doc_id, begin as b, end as e, weight, extra) beside every unit that contains them.

    The passages around an extent follow from its position, so that only occurrences are spread; a passage's end may lie beyond its document's here.
    """
    r = rows.select("doc_id", F.col("begin").alias("b"), F.col("end").alias("e"), "weight", *(extra or []))
    if isinstance(units, A.Passages):
        w, step = units.width, units.step
        first = F.greatest(F.ceil((F.col("e") - w) / step), F.lit(0)).cast("int")
        spread = r.withColumn("i0", first).withColumn("i1", F.floor(F.col("b") / step).cast("int")).filter("i0 <= i1")
        spread = spread.select("*", F.explode(F.sequence("i0", "i1")).alias("i")).withColumn("begin", (F.col("i") * step).cast("int"))
        return spread.withColumn("end", (F.col("begin") + w).cast("int")).drop("i", "i0", "i1")
    return blocks_joined(units, r, keys)


def blocks_joined(units: DataFrame, rows: DataFrame, keys: list[str], block: int = 256) -> DataFrame:
    """units (doc_id, begin, end) beside the rows (doc_id, b, e, ...) inside them. Units meet only rows that begin in a block of positions
    that they touch, and one document's blocks may go to many tasks."""
    u = units.select(*keys, F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    r = rows.withColumn("block", F.floor(F.col("b") / block))
    return u.join(r, ["doc_id", "block"]).filter((F.col("b") >= F.col("begin")) & (F.col("b") < F.col("end")) & (F.col("e") <= F.col("end"))).drop("block")


def counted_in(rows: DataFrame, keys: list[str], single: bool) -> DataFrame:
    if single:
        return rows.groupBy(*keys).agg(F.sum("weight").alias("tf"))
    from lexigrove.plans.extents import weight_fold

    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("begin"), F.col("e").alias("end"), "weight"))).alias("x"))
    return made.select(*keys, weight_fold(F.col("x")).alias("tf"))


def ranked(results: DataFrame, k: int = 1000, start: int = 0) -> DataFrame:
    """The best k results from `start` on: score, document, begin and end, each descending."""
    rows = results.orderBy(*[F.desc(c) for c in ORDER])
    return (rows.offset(start) if start else rows).limit(k)
