"""Statistics and inspection of a collection, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.plans import ast as A
from lexigrove.plans import rewrite
from lexigrove.plans.extents import Extents, counted
from lexigrove.plans.parser import parse_extent
from lexigrove.session import beside, broadcast_if_small, materialise


def corpus_stats(c: Collection) -> DataFrame:
    """total_terms (stopped slots included), n_docs (deleted ones not), n_unique terms."""
    lengths = c.lengths()
    live = lengths.join(c.deleted, "doc_id", "left_anti") if c.deleted is not None else lengths
    sizes = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_terms"))
    docs = live.agg(F.count("*").alias("n_docs"))
    terms = c.tokens.select("term").dropna().distinct().agg(F.count("*").alias("n_unique"))
    return beside(beside(sizes, docs), terms)


def term_stats(c: Collection) -> DataFrame:
    """(term, cf, df) of the whole vocabulary: term counts are summed by document first, so that a term of any frequency is a row a document at most."""
    return c.tokens.filter("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def stats_of(c: Collection, terms: DataFrame) -> DataFrame:
    """(term, cf, df) of the given terms only: rows of all others are left out before anything is counted."""
    wanted = materialise(terms.select("term").dropna().distinct())
    rows = c.tokens.select("term", "doc_id").join(broadcast_if_small(wanted, wanted.count()), "term", "left_semi")
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def vocabulary(c: Collection, prefix: str = "") -> DataFrame:
    return term_stats(c).filter(F.col("term").startswith(prefix)) if prefix else term_stats(c)


def postings(c: Collection) -> DataFrame:
    """(doc_id, term, tf, positions), a document's positions in order."""
    rows = c.tokens.filter("term is not null").groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.select("doc_id", "term", F.size("positions").alias("tf"), "positions")


def inverted_list(c: Collection, term: str) -> DataFrame:
    """Postings of one term; only its rows are read."""
    return postings(Collection(c.docs, c.tokens.filter(F.col("term") == term), c.fields, c.priors))


def document_vectors(c: Collection, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, terms array<string> by position, NULL for stopped slots)."""
    t = c.tokens.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi") if doc_ids is not None else c.tokens
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("x"))
    return rows.select("doc_id", F.col("x.term").alias("terms"))


def field_stats(c: Collection) -> DataFrame:
    """(field, cf: tokens inside, df: documents, n: extents)."""
    return c.fields.groupBy("field").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("cf"), F.countDistinct("doc_id").alias("df"), F.count("*").alias("n"))


def term_field_stats(c: Collection, field: str) -> DataFrame:
    """(term, cf, df) of terms inside a field; nested extents of the field count a token once."""
    from lexigrove.plans.extents import inside

    t = c.tokens.filter("term is not null").select("doc_id", F.col("pos").alias("begin"), (F.col("pos") + 1).alias("end"), F.lit(1.0).alias("weight"), "term")
    e = Extents(c).of(A.AnyField(field))
    spots = inside(t.select("doc_id", "begin", "end", "weight"), e).select("doc_id", "begin")
    rows = t.join(spots, ["doc_id", "begin"], "left_semi")
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def expression_list(c: Collection, text: str) -> DataFrame:
    """(doc_id, begin, end, weight) of all extents of an unscored expression."""
    return Extents(c).of(_extents(c, text))


def expression_counts(c: Collection, text: str) -> DataFrame:
    """(doc_id, n): occurrences of an expression by document, overlapping ones counted once."""
    node = _extents(c, text)
    return counted(Extents(c).of(node), ["doc_id"], isinstance(node, A.Term)).select("doc_id", F.col("tf").alias("n"))


def expression_totals(c: Collection, text: str) -> DataFrame:
    """One row (cf, df) of an expression."""
    return expression_counts(c, text).agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("cf"), F.count("*").alias("df"))


def _extents(c: Collection, text: str) -> A.Node:
    return rewrite.single_children(rewrite.stopped_windows(rewrite.analyse_terms(parse_extent(text), c.term)))


def by_metadata(c: Collection, key: str, values: list[str]) -> DataFrame:
    """Documents whose metadata value of key is one of values."""
    return c.docs.filter(F.col("metadata").getItem(key).isin(values))


def metadata_values(c: Collection, key: str, doc_ids: DataFrame | None = None) -> DataFrame:
    rows = c.docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi") if doc_ids is not None else c.docs
    return rows.select("doc_id", F.col("metadata").getItem(key).alias("value"))


def path_names(c: Collection, results: DataFrame) -> DataFrame:
    """results with the names of their fields from the outermost down, as a path; results outside any field have `/`."""
    f = c.fields.select("doc_id", "field", F.col("begin").alias("fb"), F.col("end").alias("fe"), "ordinal")
    rows = results.join(f, "doc_id", "left").withColumn("in", (F.col("fb") <= F.col("begin")) & (F.col("fe") >= F.col("end")))
    names = F.array_sort(F.collect_list(F.when(F.col("in"), F.struct("ordinal", "field"))))
    return rows.groupBy(*results.columns).agg(F.concat(F.lit("/"), F.array_join(F.transform(names, lambda x: x["field"]), "/")).alias("path"))


def validate(c: Collection) -> DataFrame:
    """(problem, n): positions that aren't 0..length-1, extents that lie outside their document, orphaned rows; none for a sound collection."""
    n = c.tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.min("pos").alias("lo"))
    gaps = n.filter("n <> d or m + 1 <> n or lo <> 0").agg(F.lit("positions").alias("problem"), F.count("*").alias("n"))
    outside = c.fields.join(c.lengths(), "doc_id", "left").filter("begin < 0 or end < begin or end > coalesce(length, 0)").agg(F.lit("extents").alias("problem"), F.count("*").alias("n"))
    orphans = c.tokens.select("doc_id").distinct().join(c.docs, "doc_id", "left_anti").agg(F.lit("orphans").alias("problem"), F.count("*").alias("n"))
    return gaps.unionAll(outside).unionAll(orphans).filter("n > 0")
