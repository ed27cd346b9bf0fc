"""A searchable collection: token, field-extent, document and prior tables, and how they come about."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.functions import analysis, markup
from lexigrove.session import exists, remove, settle

FIELDS = "begin int, end int, number long, ordinal int, parent int"


@dataclass
class Collection:
    """docs(doc_id, ext_id, text, metadata), tokens(doc_id, pos, term), fields(doc_id, field, begin, end, number, ordinal, parent),
    priors(name, doc_id, logprob); `term` turns a query word into a term as documents have it (None: stopped)."""

    docs: DataFrame
    tokens: DataFrame
    fields: DataFrame
    priors: DataFrame
    deleted: DataFrame | None = None
    stopwords: tuple[str, ...] = ()
    stemmer: str | None = None
    positions: DataFrame | None = None
    _lengths: DataFrame | None = field(default=None, repr=False)

    # -- building

    @staticmethod
    def flat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: list[str] | None = None, stopwords: tuple[str, ...] = (), stemmer: str | None = None, offsets: bool = False) -> Collection:
        """Plain texts: simple tokens at array positions; stopped ones keep their slot as NULL. With offsets, `positions` tells where in the text each token
        begins and ends, in characters (of its lower-cased form)."""
        spark = docs.sparkSession
        rows = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
        tokens = rows.select(F.col(doc_id).alias("doc_id"), F.posexplode(analysis.simple_tokens(F.col(text))).alias("pos", "term"))
        tokens = _analysed(tokens, stopwords, stemmer)
        keep = metadata if metadata is not None else [c for c in docs.columns if c not in (doc_id, text)]
        meta = F.map_from_arrays(F.array(*[F.lit(c) for c in keep]), F.array(*[F.col(c).cast("string") for c in keep])) if keep else F.create_map().cast("map<string,string>")
        table = rows.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("ext_id"), F.col(text).alias("text"), meta.alias("metadata"))
        kind = dict(docs.dtypes)[doc_id]
        spots = None
        if offsets:  # what lies before each token, and the token, add up to where it ends
            part = lambda k: F.regexp_extract_all(F.lower(F.col(text)), F.lit("([^a-z0-9]*)([a-z0-9]+)"), F.lit(k))
            pairs = rows.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.arrays_zip(part(1).alias("gap"), part(2).alias("term"))).alias("pos", "p"))
            end = F.sum(F.length("p.gap") + F.length("p.term")).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("int")
            spots = pairs.withColumn("end", end).select("doc_id", "pos", (F.col("end") - F.length("p.term")).alias("begin"), "end")
        return Collection(table, tokens, spark.createDataFrame([], f"doc_id {kind}, field string, {FIELDS}"), no_priors(spark, kind), None, stopwords, stemmer, spots)

    @staticmethod
    def tagged(docs: DataFrame, doc_id: str, text: str, rules: markup.Markup = markup.Markup(), url: str | None = None, stopwords: tuple[str, ...] = (), stemmer: str | None = None) -> Collection:
        """Documents with tags: one pass of the tag parser gives tokens, field extents, metadata and links."""
        kind = dict(docs.dtypes)[doc_id]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                parsed = pd.DataFrame(markup.rows(b["text"], b["url"], rules))
                yield pd.concat([b.reset_index(drop=True), parsed], axis=1)

        source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(url) if url else F.lit(None).cast("string")).alias("url")).dropna(subset=["doc_id", "text"])
        parsed = source.mapInPandas(work, f"doc_id {kind}, text string, url string, {markup.schema()}")
        tokens = parsed.select("doc_id", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "pos", F.col("t.term").alias("term"))
        fields = parsed.select("doc_id", F.explode("extents").alias("e")).select("doc_id", F.col("e.field").alias("field"), F.col("e.begin").alias("begin"), F.col("e.end").alias("end"), "e.number", "e.ordinal", "e.parent")
        spots = parsed.select("doc_id", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "pos", F.col("t.begin").alias("begin"), F.col("t.end").alias("end"))
        table = parsed.select("doc_id", F.col("doc_id").cast("string").alias("ext_id"), "text", "metadata")
        return Collection(table, _analysed(tokens, stopwords, stemmer), fields, no_priors(docs.sparkSession, kind), None, stopwords, stemmer, spots)

    @staticmethod
    def pieces(docs: DataFrame, doc_id: str, text: str) -> Collection:
        """Tagged texts taken as a row of (tag, text up to the next tag) pieces, all in built-in expressions: each piece is an extent of its tag."""
        pattern = r"<([A-Za-z][A-Za-z0-9]*)[^<>]*>([^<]*)"
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropna("any")
        names, inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
        parts = rows.select("doc_id", F.posexplode(F.arrays_zip(names.alias("n"), inner.alias("i"))).alias("k", "p")).select("doc_id", "k", F.lower("p.n").alias("field"), analysis.simple_tokens(F.col("p.i")).alias("ws"))
        before = F.coalesce(F.sum(F.size("ws")).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
        parts = parts.withColumn("begin", before)
        tokens = parts.select("doc_id", "begin", F.posexplode("ws").alias("i", "term")).select("doc_id", (F.col("begin") + F.col("i")).alias("pos"), "term")
        none = F.lit(None).cast("long")
        fields = parts.select("doc_id", "field", "begin", (F.col("begin") + F.size("ws")).alias("end"), none.alias("number"), (F.col("k") + 2).alias("ordinal"), F.lit(1).alias("parent"))
        table = rows.select("doc_id", F.col("doc_id").cast("string").alias("ext_id"), "text", F.create_map().cast("map<string,string>").alias("metadata"))
        return Collection(table, tokens, fields, no_priors(docs.sparkSession, dict(docs.dtypes)[doc_id]))

    # -- incremental maintenance

    def append(self, other: Collection) -> Collection:
        """This collection and another segment of the same layout; also what a repository of several indexes is."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.unionByName(b)

        gone = self.deleted if other.deleted is None else other.deleted if self.deleted is None else both(self.deleted, other.deleted)
        spots = both(self.positions, other.positions) if self.positions is not None and other.positions is not None else None
        return replace(self, docs=both(self.docs, other.docs), tokens=both(self.tokens, other.tokens), fields=both(self.fields, other.fields), priors=both(self.priors, other.priors), deleted=gone, positions=spots, _lengths=None)

    def delete(self, ids: DataFrame) -> Collection:
        """Marks documents (doc_id) as deleted: they are no results any more, but counts keep them until compact()."""
        ids = ids.select("doc_id").distinct()
        return replace(self, deleted=ids if self.deleted is None else self.deleted.unionByName(ids).distinct())

    def compact(self) -> Collection:
        """Without the rows of deleted documents, from tables and so from counts."""
        if self.deleted is None:
            return self
        drop = lambda df: df.join(self.deleted, "doc_id", "left_anti")
        return replace(self, docs=drop(self.docs), tokens=drop(self.tokens), fields=drop(self.fields), priors=drop(self.priors), deleted=None, positions=drop(self.positions) if self.positions is not None else None, _lengths=None)

    def with_fields(self, add: DataFrame | None = None, remove: list[str] | None = None) -> Collection:
        """Other indexed fields over the same tokens."""
        f = self.fields.filter(~F.col("field").isin(remove)) if remove else self.fields
        return replace(self, fields=f.unionByName(add) if add is not None else f)

    def with_priors(self, name: str, table: DataFrame) -> Collection:
        """A named prior from (doc_id, logprob)."""
        return replace(self, priors=self.priors.filter(F.col("name") != name).unionByName(table.select(F.lit(name).alias("name"), "doc_id", "logprob")))

    def save(self, path: str, parts: int | None = None) -> None:
        """Parquet tables under path. Tokens go to `parts` files (the session's shuffle partitions) by ranges of (term, document), sorted, so that
        no term is one task's and a query reads the files and row groups of its terms only; extents likewise by field."""

        def ranged(df: DataFrame, *by: str) -> DataFrame:
            return df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)

        ranged(self.tokens, "term", "doc_id").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/tokens")
        ranged(self.fields, "field", "doc_id").sortWithinPartitions("field", "doc_id").write.mode("overwrite").parquet(f"{path}/fields")
        self.lengths().write.mode("overwrite").parquet(f"{path}/lengths")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        optional = {"deleted": self.deleted, "positions": self.positions}
        for name, df in optional.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
            else:
                remove(self.docs.sparkSession, f"{path}/{name}")

    @staticmethod
    def open(spark: SparkSession, *paths: str) -> Collection:
        """One or several saved collections, as one. What can't be read raises; only tables that aren't there are taken as none."""
        settle(spark)
        parts = []
        for p in paths:
            read = lambda n, p=p: spark.read.parquet(f"{p}/{n}")
            maybe = lambda n, p=p: spark.read.parquet(f"{p}/{n}") if exists(spark, f"{p}/{n}") else None
            parts.append(Collection(read("docs"), read("tokens"), read("fields"), read("priors"), maybe("deleted"), positions=maybe("positions"), _lengths=read("lengths")))
        out = parts[0]
        for part in parts[1:]:
            out = out.append(part)
        return out

    # -- derived

    def lengths(self) -> DataFrame:
        """(doc_id, length): tokens of each document, stopped slots included."""
        return self._lengths if self._lengths is not None else self.tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))

    def term(self, word: str) -> str | None:
        t = analysis.normalise(word)
        if t in self.stopwords:
            return None
        return analysis.stemmer(self.stemmer)(t) if self.stemmer else t


def no_priors(spark: SparkSession, kind: str) -> DataFrame:
    settle(spark)
    return spark.createDataFrame([], f"name string, doc_id {kind}, logprob double")


def _analysed(tokens: DataFrame, stopwords: tuple[str, ...], stemmer: str | None) -> DataFrame:
    term = analysis.stopped(F.col("term"), list(stopwords))
    tokens = tokens.withColumn("term", term)
    return tokens.withColumn("term", analysis.stem_udf(stemmer)("term")) if stemmer else tokens
