"""Collections over the given tables, built once a session and table folder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.functions.analysis import simple_tokens
from lexigrove.session import materialise, table
from lexigrove.streaming import filtering

_built: dict[tuple[str, str, str], Collection] = {}


def _once(spark, sf: str, name: str, make) -> Collection:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def indexed(c: Collection) -> Collection:
    """Tables written; tokens in ranges of (term, document), so that a query's scan skips to its terms by row-group statistics."""
    tokens = materialise(c.tokens.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "pos"))
    out = replace(c, tokens=tokens, fields=materialise(c.fields.sortWithinPartitions("field", "doc_id")))
    return replace(out, _lengths=materialise(out.lengths()))


def documents(spark, sf) -> Collection:
    """documents: tokens; lines (split at line ends) in paragraphs (split at blank lines) in the document; number fields size and date; prior size."""

    def make() -> Collection:
        docs = table(spark, sf, "documents")
        c = Collection.flat(docs, metadata=["lang", "source", "schost", "stream_id"])
        lines = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        lines = lines.select("doc_id", "i", F.size(simple_tokens(F.col("line"))).alias("n"), (F.trim(F.regexp_replace("line", r"\s+", "")) == "").cast("int").alias("gap"))
        order = W.partitionBy("doc_id").orderBy("i")
        lines = lines.withColumn("end", F.sum("n").over(order).cast("int")).withColumn("para", F.sum("gap").over(order)).withColumn("begin", F.col("end") - F.col("n").cast("int")).filter("n > 0")
        number = F.lit(None).cast("long")
        paras = lines.groupBy("doc_id", "para").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        paras = paras.withColumn("o", (2 * F.row_number().over(W.partitionBy("doc_id").orderBy("begin"))).cast("int"))  # even ordinals; lines have odd ones from 3 on
        inner = lines.join(paras.select("doc_id", "para", "o"), ["doc_id", "para"])
        lengths = c.lengths()
        sizes = docs.select("doc_id", F.col("n_chars").alias("number")).join(lengths, "doc_id")
        dates = docs.select("doc_id", F.datediff(F.timestamp_seconds(F.split("stream_id", "-")[0].try_cast("long")).cast("date"), F.lit("1600-01-01").cast("date")).cast("long").alias("number")).join(lengths, "doc_id")
        whole = lambda df, name, o: df.select("doc_id", F.lit(name).alias("field"), F.lit(0).alias("begin"), F.col("length").cast("int").alias("end"), "number", F.lit(o).alias("ordinal"), F.lit(0 if o == 1 else 1).alias("parent"))
        fields = (
            whole(lengths.withColumn("number", number), "document", 1)
            .unionByName(whole(sizes, "size", 0))
            .unionByName(whole(dates, "date", 0))
            .unionByName(paras.select("doc_id", F.lit("para").alias("field"), "begin", "end", number.alias("number"), F.col("o").alias("ordinal"), F.lit(1).alias("parent")))
            .unionByName(inner.select("doc_id", F.lit("line").alias("field"), "begin", "end", number.alias("number"), (2 * F.col("i") + 3).alias("ordinal"), F.col("o").alias("parent")))
        )
        total = docs.filter("text is not null").agg(F.sum("n_chars")).first()[0] or 1
        priors = docs.filter("n_chars > 0").select(F.lit("size").alias("name"), "doc_id", F.log(F.col("n_chars") / F.lit(total)).alias("logprob"))
        return indexed(replace(c, fields=fields, priors=materialise(priors)))

    return _once(spark, sf, "documents", make)


def pages(spark, sf) -> Collection:
    """parsed_documents by docno, as rows of tagged pieces."""

    def make() -> Collection:
        rows = table(spark, sf, "parsed_documents").filter("docno is not null").groupBy("docno").agg(F.max("text").alias("text"))
        return indexed(Collection.pieces(rows, "docno", "text"))

    return _once(spark, sf, "pages", make)


_terms: dict = {}


def item_terms(spark, sf):
    """Terms of the stream's items, built once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _terms:
        _terms[key] = materialise(filtering.item_terms(items(spark, sf)))
    return _terms[key]


_rows: dict = {}


def item_rows(spark, sf):
    """(terms of the topics, the stream's items as rows of them), built once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _rows:
        q = materialise(filtering.query_terms(table(spark, sf, "topics")))
        _rows[key] = q, materialise(filtering.item_rows(items(spark, sf), q))
    return _rows[key]


def items(spark, sf):
    """(stream_id, day, text, other_content) of stream items, each once, by the day of their directory."""
    docs = table(spark, sf, "documents").filter("stream_id is not null").groupBy("stream_id").agg(F.max("text").alias("text"))
    rows = table(spark, sf, "stream_items").filter("stream_id is not null and dir_name is not null").groupBy("stream_id").agg(F.min(F.substring("dir_name", 1, 10)).alias("day"))
    return rows.join(docs, "stream_id")
