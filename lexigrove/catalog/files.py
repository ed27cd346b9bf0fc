"""Queries on readers, sinks, collections and text functions: tables are written as files of each format and read again; with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.catalog import corpora
from lexigrove.catalog import sqltext as S
from lexigrove.collection import Collection
from lexigrove.engine import Engine
from lexigrove.functions import analysis as T
from lexigrove.operators import inspect, links
from lexigrove.plans.compile import Compiler, ranked
from lexigrove.plans.parser import parse
from lexigrove.session import materialise, own_folder, table
from lexigrove.sources import readers, sinks
from lexigrove.streaming import filtering as Z

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, run, sql: str | None = None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _lines(df: DataFrame) -> str:
    """Writes a table of one text column to a folder of its own in the shared one."""
    path = own_folder(df.sparkSession)
    df.write.text(path)
    return path


# readers


def tagged(spark, sf):
    rows = table(spark, sf, "parsed_documents").filter("text is not null and file_class = 'trecweb'")
    docs = readers.documents(spark, _lines(rows.select("text")), "trecweb")
    return docs.select("docno", F.col("metadata")["url"].alias("url"), F.coalesce(F.col("metadata")["title"], F.lit("")).alias("title"))


add(
    "read_trecweb",
    tagged,
    r"""SELECT trim(regexp_extract(text, '<DOCNO>(.*?)</DOCNO>', 1)) AS docno, regexp_extract(text, '<DOCHDR>\s*(\S+)', 1) AS url, trim(regexp_extract(text, '(?is)<(?:title|headline)>(.*?)</(?:title|headline)>', 1)) AS title
FROM parsed_documents WHERE text IS NOT NULL AND file_class = 'trecweb'""",
)


def warc(spark, sf):
    rows = table(spark, sf, "documents").filter("text is not null and doc_id is not null")
    record = F.concat(F.lit("WARC/1.0\nWARC-Type: response\nWARC-TREC-ID: "), F.col("doc_id").cast("string"), F.lit("\nContent-Length: "), F.octet_length("text").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    docs = readers.documents(spark, _lines(rows.select(record.alias("value"))), "warc")
    return docs.select("docno", F.md5("text").alias("hash"))


add("read_warc", warc, "SELECT doc_id::VARCHAR AS docno, md5(text) AS hash FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")


def mbox(spark, sf):
    rows = table(spark, sf, "queries").filter("query is not null and query_id is not null").select("query_id", F.regexp_replace("query", r"\s+", " ").alias("q"))
    message = F.concat(F.lit("From sender\nMessage-ID: <"), F.col("query_id").cast("string"), F.lit(">\nSubject: query\nContent-Type: text/plain; charset=utf-8\n\nQ: "), F.col("q"))
    docs = readers.documents(spark, _lines(rows.select(message.alias("value"))), "mbox")
    return docs.select("docno", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("body"), F.col("metadata")["subject"].alias("subject"))


add("read_mbox", mbox, r"SELECT '<' || query_id || '>' AS docno, trim('Q: ' || regexp_replace(query, '\s+', ' ', 'g')) AS body, 'query' AS subject FROM queries WHERE query IS NOT NULL AND query_id IS NOT NULL")


def triples(spark, sf):
    e = table(spark, sf, "topics").select("target_id", "label", F.explode("related_entities").alias("o")).dropna()
    line = F.concat(F.lit("<"), "target_id", F.lit("> <http://related> <"), "o", F.lit("> ."))
    name = F.concat(F.lit("<"), "target_id", F.lit('> <http://label> "'), "label", F.lit('"@en .'))
    t = readers.triples(spark, _lines(e.select(line.alias("value")).unionAll(e.select(name).distinct())))
    return readers.objects(t, predicate="http://related").unionAll(readers.objects(t, predicate="http://label"))


add(
    "read_triples",
    triples,
    """WITH e AS (SELECT target_id, label, unnest(related_entities) AS o FROM topics WHERE target_id IS NOT NULL AND label IS NOT NULL)
SELECT target_id AS s, 'http://related' AS p, o FROM e WHERE o IS NOT NULL UNION ALL SELECT DISTINCT target_id, 'http://label', label FROM e WHERE o IS NOT NULL""",
)


def annotations(spark, sf):
    """The first word of every document as a field, told by offsets in a file."""
    docs = table(spark, sf, "documents").filter("doc_id is not null and text is not null")
    c = Collection.flat(docs, metadata=[], offsets=True)
    first = c.positions.filter("pos = 0").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("TAG"), F.lit("1"), F.lit("Lead"), F.col("begin").cast("string"), (F.col("end") - F.col("begin")).cast("string"), F.lit("7"), F.lit("0")).alias("value"))
    fields = readers.annotated_fields(c.positions, c.docs, readers.offset_annotations(spark, _lines(first)))
    return inspect.expression_counts(replace(c, fields=fields), "#any:lead").join(fields.select("doc_id", "number"), "doc_id").select("doc_id", F.col("n").cast("long").alias("n"), "number")


add("read_annotations", annotations, "SELECT doc_id, 1::BIGINT AS n, 7::BIGINT AS number FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(lower(text), '[a-z0-9]')")


def prior_file(spark, sf):
    c = corpora.documents(spark, sf)
    lines = table(spark, sf, "documents").filter("n_chars > 0").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("value"))
    p = links.prior_from_file(spark, c, _lines(lines.distinct()), log=False)
    return Compiler(c.with_priors("chars", p)).run(parse("#combine(court #prior(chars))")).select("doc_id", F.round("score", 6).alias("score"))


_COURT = S.dirichlet(0)
add(
    "read_prior",
    prior_file,
    S.query(
        [S.term("court")],
        f"({_COURT} + coalesce(ln(n_chars / (SELECT sum(n_chars) FROM documents WHERE text IS NOT NULL AND n_chars > 0)), -1e100)) / 2",
        where="JOIN documents d USING (doc_id)",
    ),
)


def more_metadata(spark, sf):
    c = corpora.documents(spark, sf)
    extra = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("docno"), F.lit("length").alias("key"), F.col("n_chars").cast("string").alias("value"))
    extra = extra.unionAll(extra.select("docno", F.lit("lang"), F.lit("never")))  # keys that are there keep their value
    return readers.with_metadata(c.docs, extra).select("doc_id", F.col("metadata")["length"].alias("length"), F.col("metadata")["lang"].alias("lang"))


add("add_metadata", more_metadata, "SELECT doc_id, n_chars::VARCHAR AS length, lang FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")

# sinks


def run_lines(spark, sf):
    c = corpora.documents(spark, sf)
    top = ranked(Compiler(c).run(parse("court jury meeting")), 50).join(c.docs.select("doc_id", "ext_id"), "doc_id")
    lines = sinks.trec_run(top.withColumn("score", F.round("score", 9)), "7", "run")
    path = own_folder(spark)
    sinks.write_lines(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_D3 = "(" + " + ".join(S.dirichlet(k) for k in range(3)) + ") / 3"
_TOP = S.query([S.term("court"), S.term("jury"), S.term("meeting")], _D3).replace("round(" + _D3 + ", 6)", "round(" + _D3 + ", 9)")
add(
    "run_lines",
    run_lines,
    f"WITH r AS ({_TOP}), t AS (SELECT * FROM r ORDER BY score DESC, doc_id DESC LIMIT 50) SELECT '7 Q0 ' || doc_id || ' ' || row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR DESC) || ' ' || printf('%.6f', score) || ' run' AS line FROM t",
)

# collections


def _scored(c: Collection) -> DataFrame:
    return Compiler(c).run(parse("#combine(court jury)")).select("doc_id", F.round("score", 6).alias("score"))


_TWO = [S.term("court"), S.term("jury")]
_D2 = f"({S.dirichlet(0)} + {S.dirichlet(1)}) / 2"


def two_segments(spark, sf):
    docs = table(spark, sf, "documents")
    parts = [Collection.flat(docs.filter(w), metadata=["lang"]) for w in ("lang = 'en'", "lang <> 'en' or lang is null")]
    return _scored(parts[0].append(parts[1]))


add("two_segments", two_segments, S.query(_TWO, _D2))


def saved(spark, sf):
    path = own_folder(spark)
    corpora.documents(spark, sf).save(path)
    return _scored(Collection.open(spark, path))


add("saved_index", saved, S.query(_TWO, _D2))
add(
    "deleted_documents",
    lambda s, d: _scored(corpora.documents(s, d).delete(table(s, d, "documents").filter("lang = 'en' and source is not null").select("doc_id"))),
    S.query(_TWO, _D2, where="JOIN documents d USING (doc_id) WHERE NOT coalesce(lang = 'en' AND source IS NOT NULL, false)"),
)
_LEFT = S.TOK.replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND NOT coalesce(lang = 'en' AND source IS NOT NULL, false)")
add(
    "compacted_documents",
    lambda s, d: _scored(corpora.documents(s, d).delete(table(s, d, "documents").filter("lang = 'en' and source is not null").select("doc_id")).compact()),
    S.query(_TWO, _D2, base=_LEFT),
)


def other_fields(spark, sf):
    c = corpora.documents(spark, sf)
    heads = c.fields.filter("field = 'para' and begin = 0").withColumn("field", F.lit("lead"))
    return inspect.field_stats(c.with_fields(heads, ["line", "size", "date"])).filter("field in ('lead', 'document', 'line')").select("field", "df", "n")


add(
    "modified_fields",
    other_fields,
    f"WITH {S.TOK} SELECT unnest(['lead', 'document']) AS field, count(*) AS df, count(*) AS n FROM len",
)


def statistics(spark, sf):
    e = Engine(corpora.documents(spark, sf))
    values = {
        "terms": e.term_count(),
        "unique": e.term_count_unique(),
        "court": e.term_count("Court"),
        "documents": e.document_count(),
        "with_court": e.document_count("court"),
        "phrase": e.expression_count("#1(the court)"),
        "with_phrase": e.document_expression_count("#1(the court)"),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in values.items()], "name string, value long")


add(
    "statistics",
    statistics,
    f"""WITH {S.TOK}, x AS ({S.phrase('the', 'court')}) SELECT 'terms' AS name, count(*) AS value FROM tok UNION ALL SELECT 'unique', count(DISTINCT term) FROM tok UNION ALL SELECT 'court', count(*) FROM tok WHERE term = 'court'
UNION ALL SELECT 'documents', count(*) FROM len UNION ALL SELECT 'with_court', count(DISTINCT doc_id) FROM tok WHERE term = 'court' UNION ALL SELECT 'phrase', count(*) FROM x UNION ALL SELECT 'with_phrase', count(DISTINCT doc_id) FROM x""",
)


def many(spark, sf):
    e = Engine(corpora.documents(spark, sf))
    return e.search_many({"a": "court jury meeting", "b": "#combine(court #1(the court))"}, 20).select("query", "doc_id", F.round("score", 6).alias("score"))


_ONE = S.query([S.term("court"), S.phrase("the", "court")], f"({S.dirichlet(0)} + {S.dirichlet(1)}) / 2").replace(f"round(({S.dirichlet(0)} + {S.dirichlet(1)}) / 2, 6)", f"({S.dirichlet(0)} + {S.dirichlet(1)}) / 2")
_BOTH = _TOP.replace("round(" + _D3 + ", 9)", _D3)
add(
    "search_many",
    many,
    f"SELECT 'a' AS query, doc_id, round(score, 6) AS score FROM (SELECT * FROM ({_BOTH}) ORDER BY round(score, 12) DESC, doc_id DESC LIMIT 20) UNION ALL SELECT 'b', doc_id, round(score, 6) FROM (SELECT * FROM ({_ONE}) ORDER BY round(score, 12) DESC, doc_id DESC LIMIT 20)",
)

# functions on text


def text_functions(spark, sf):
    q = table(spark, sf, "queries").filter("query is not null and query_id is not null").select("query_id", "query").distinct()
    words = T.split_ws(F.col("query"), ["the", "of"], 2)
    return q.select(
        "query_id",
        F.array_join(words, "|").alias("words"),
        F.array_join(T.ngrams(words, 2), "|").alias("bigrams"),
        F.array_join(T.split_cases(F.col("query")), "|").alias("cases"),
        T.sanitised(F.col("query")).alias("sanitised"),
        T.normalised(F.col("query")).alias("normalised"),
        F.array_join(T.characters(F.col("query")), "").alias("characters"),
        T.first_number(F.col("query")).alias("number"),
        T.transcoded(F.encode("query", "UTF-16"), "utf-16").alias("transcoded"),
    )


add(
    "text_functions",
    text_functions,
    r"""WITH q AS (SELECT DISTINCT query_id, query FROM queries WHERE query IS NOT NULL AND query_id IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(trim(query), '\s+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'of')) AS ws FROM q)
SELECT query_id, array_to_string(ws, '|') AS words, array_to_string(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), '|') AS bigrams,
array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(query, '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '\s+'), lambda x: x <> ''), '|') AS cases,
regexp_replace(query, '[^A-Za-z0-9 ]', '', 'g') AS sanitised, lower(regexp_replace(query, '[.'']', '', 'g')) AS normalised, regexp_replace(query, '\s', '', 'g') AS characters,
coalesce(try_cast(regexp_extract(query, '(-?[0-9]+)', 1) AS BIGINT), 0) AS number, query AS transcoded FROM w""",
)


def frequencies(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null and doc_id is not null")
    counts = docs.select("doc_id", F.explode(T.term_frequencies(T.simple_tokens(F.col("text")))).alias("term", "tf"))
    return counts.select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


add("term_frequencies", frequencies, f"WITH {S.TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")


def poisson(spark, sf):
    tf = corpora.documents(spark, sf).tokens.filter("term = 'court'").groupBy("doc_id").agg(F.count("*").alias("tf"))
    return tf.select("doc_id", F.round(Z.poisson(F.col("tf"), F.lit(1.7)), 6).alias("logprob"))


add("poisson", poisson, f"WITH {S.TOK} SELECT doc_id, round(count(*) * ln(1.7) - 1.7 - lgamma(count(*) + 1.0), 6) AS logprob FROM tok WHERE term = 'court' GROUP BY doc_id")


def url_fields(spark, sf):
    """Words of addresses as tokens behind the text, found by their field."""
    rows = table(spark, sf, "parsed_documents").filter("docno is not null and content is not null").groupBy("docno").agg(F.max("content").alias("content"), F.max("url").alias("url"))
    c = links.with_url_text(Collection.flat(rows, "docno", "content", metadata=["url"]))
    return inspect.term_field_stats(replace(c, tokens=materialise(c.tokens)), "url")


add(
    "url_text",
    url_fields,
    r"""WITH p AS (SELECT docno, max(content) AS content, max(url) AS url FROM parsed_documents WHERE docno IS NOT NULL AND content IS NOT NULL GROUP BY docno),
w AS (SELECT docno, unnest(regexp_extract_all(lower(regexp_replace(url, '^[A-Za-z]+://', '')), '[a-z0-9]+')) AS term FROM p WHERE url IS NOT NULL) SELECT term, count(*) AS cf, count(DISTINCT docno) AS df FROM w GROUP BY term""",
)
