"""Queries of the retrieval core over documents, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lexigrove.catalog import corpora
from lexigrove.catalog import sqltext as S
from lexigrove.collection import Collection
from lexigrove.engine import Engine
from lexigrove.functions import scoring
from lexigrove.operators import inspect
from lexigrove.plans import ast as A
from lexigrove.plans.compile import Compiler, Config
from lexigrove.plans.extents import Extents
from lexigrove.operators.shrinkage import Shrinkage, shrinkage_scores
from lexigrove.plans.parser import parse, parse_extent
from lexigrove.plans.xpath import parse_paths
from lexigrove.session import table

QUERIES: dict = {}
SQL: dict = {}


def scores(name: str, text: str, sql: str, **config):
    """Registers a ranked query whose every scored document is compared."""

    def run(spark, sf):
        c = corpora.documents(spark, sf)
        return Compiler(c, Config(**config)).run(parse(text)).select("doc_id", F.round("score", 6).alias("score"))

    QUERIES[name], SQL[name] = run, sql


def extents(name: str, text: str, sql: str):
    def run(spark, sf):
        return inspect.expression_list(corpora.documents(spark, sf), text).select("doc_id", "begin", "end", "weight")

    QUERIES[name] = run
    SQL[name] = f"WITH {S.TOK} SELECT doc_id, b::INTEGER AS \"begin\", e::INTEGER AS \"end\", w::DOUBLE AS weight FROM ({sql})"


def plain(name: str, run, sql: str | None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# statistics

plain("tokens", lambda s, d: corpora.documents(s, d).tokens.select("doc_id", F.col("pos").cast("long").alias("pos"), "term"), f"WITH {S.TOK} SELECT doc_id, pos, term FROM tok")
plain("doc_length", lambda s, d: corpora.documents(s, d).lengths().select("doc_id", F.col("length").cast("long").alias("length")), f"WITH {S.TOK} SELECT doc_id, length FROM len")
plain("corpus_stats", lambda s, d: inspect.corpus_stats(corpora.documents(s, d)), f"WITH {S.TOK} SELECT (SELECT total FROM c)::BIGINT AS total_terms, (SELECT n FROM c)::BIGINT AS n_docs, (SELECT count(DISTINCT term) FROM tok) AS n_unique")
plain("term_stats", lambda s, d: inspect.term_stats(corpora.documents(s, d)), f"WITH {S.TOK} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term")
plain("vocabulary", lambda s, d: inspect.vocabulary(corpora.documents(s, d), "co"), f"WITH {S.TOK} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM tok WHERE term LIKE 'co%' GROUP BY term")
plain(
    "invlist",
    lambda s, d: inspect.inverted_list(corpora.documents(s, d), "court").select("doc_id", F.col("tf").cast("long").alias("tf"), F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions")),
    f"WITH {S.TOK} SELECT doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok WHERE term = 'court' GROUP BY doc_id",
)
plain(
    "doc_vector",
    lambda s, d: inspect.document_vectors(corpora.documents(s, d)).select("doc_id", F.md5(F.array_join("terms", " ")).alias("vector")),
    f"WITH {S.TOK} SELECT doc_id, md5(string_agg(term, ' ' ORDER BY pos)) AS vector FROM tok GROUP BY doc_id",
)
plain("postings", lambda s, d: inspect.postings(corpora.documents(s, d)).select("doc_id", "term", F.col("tf").cast("long").alias("tf")), f"WITH {S.TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
plain(
    "expr_count_phrase",
    lambda s, d: inspect.expression_totals(corpora.documents(s, d), "#1(copies of the)"),
    f"WITH {S.TOK}, x AS ({S.phrase('copies', 'of', 'the')}) SELECT count(*) AS cf, count(DISTINCT doc_id) AS df FROM x",
)
plain(
    "expr_df_window",
    lambda s, d: inspect.expression_counts(corpora.documents(s, d), "#uw8(the court)").select("doc_id", F.col("n").cast("long").alias("n")),
    f"WITH {S.TOK}, {S.leaf(0, S.unordered(8, 'the', 'court'))} SELECT doc_id, tf::BIGINT AS n FROM l0",
)
plain(
    "metadata_lookup",
    lambda s, d: inspect.by_metadata(corpora.documents(s, d), "lang", ["de", "fr"]).select("doc_id", F.col("metadata")["lang"].alias("lang")),
    "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND text IS NOT NULL",
)


def estimated(spark, sf):
    n = Engine(corpora.documents(spark, sf)).estimated_matches("#combine(court jury #1(the court))")
    return spark.range(1).select(F.lit(n).cast("long").alias("matches"))


plain("estimated_matches", estimated, f"WITH {S.TOK} SELECT max(df) AS matches FROM (SELECT count(DISTINCT doc_id) AS df FROM tok WHERE term IN ('court', 'jury') GROUP BY term)")
plain("field_stats", lambda s, d: inspect.field_stats(corpora.pages(s, d)), f"WITH {S.PAGES} SELECT field, sum(\"end\" - \"begin\")::BIGINT AS cf, count(DISTINCT doc_id) AS df, count(*) AS n FROM ext GROUP BY field")

# smoothing

_CJ = [S.term("court"), S.term("jury"), S.term("meeting")]
_D3 = "(" + " + ".join(S.dirichlet(k) for k in range(3)) + ") / 3"
scores("combine_dirichlet", "#combine(court jury meeting)", S.query(_CJ, _D3))
_JM = "(" + " + ".join(f"ln(0.6 * coalesce(l{k}.tf, 0) / length + 0.4 * {S.share(k)})" for k in range(3)) + ") / 3"
scores("combine_jm", "court jury meeting", S.query(_CJ, _JM), rules=["method:jm,lambda:0.4"])
_TS = "(" + " + ".join(f"ln(0.6 * (coalesce(l{k}.tf, 0) + 2500 * {S.share(k)}) / (length + 2500) + 0.4 * {S.share(k)})" for k in range(3)) + ") / 3"
scores("combine_twostage", "court jury meeting", S.query(_CJ, _TS), rules=["method:twostage"])
_TSW = f"ln(0.6 * (coalesce(l0.tf, 0) + 2500 * coalesce(l0.tf, 0) / length) / (length + 2500) + 0.4 * {S.share(0)})"
scores("window_twostage", "#combine(#uw8(the court))", S.query([S.unordered(8, "the", "court")], _TSW), rules=["method:twostage"])
_TL = f"ln((coalesce(l0.tf, 0) + 500 * (1000 * {S.share(0)} + coalesce(l0.tf, 0)) / (length + 1000)) / (length + 500))"
scores("combine_two_level", "#combine(#1(the court))", S.query([S.phrase("the", "court")], _TL), rules=["method:dirichlet,mu:1000,documentmu:500"])
_TF = " + ".join(
    f"(SELECT ln((n + 1) / (df + 0.5)) * ln((n + 1) / (df + 0.5)) * 1000 * 1.0 / 1001 FROM s{k}, c) * 1.2 * coalesce(l{k}.tf, 0) / (coalesce(l{k}.tf, 0) + 0.3 + 0.9 * length / (SELECT total / n FROM c))" for k in range(3)
)
scores("baseline_tfidf", "court jury meeting", S.query(_CJ, _TF), baseline="tfidf")
_OK = " + ".join(
    f"(SELECT ln((n - df + 0.5) / (df + 0.5)) FROM s{k}, c) * {q} * 2.2 * coalesce(l{k}.tf, 0) / (coalesce(l{k}.tf, 0) + 0.3 + 0.9 * length / (SELECT total / n FROM c))" for k, q in ((0, "(8 * 2.0 / 9)"), (1, "1.0"))
)
scores("baseline_okapi", "court jury court", S.query(_CJ[:2], _OK), baseline="okapi")
scores("rules_last_match", "#combine(court #1(the court))", S.query([S.term("court"), S.phrase("the", "court")], f"({S.dirichlet(0, 1000)} + {S.dirichlet(1, 50)}) / 2"), rules=["method:dirichlet,mu:1000", "operator:window,method:dirichlet,mu:50"])

# beliefs

_D = [S.dirichlet(k) for k in range(4)]
scores("weight", "#weight(2 court 1 jury -0.5 meeting)", S.query(_CJ, f"(2 * {_D[0]} + {_D[1]} - 0.5 * {_D[2]}) / 3.5"))
scores("wand", "#wand(3 court 1 jury)", S.query(_CJ[:2], f"(3 * {_D[0]} + {_D[1]}) / 4"))
scores("wsum", "#wsum(3 court 1 jury)", S.query(_CJ[:2], f"ln((3 * exp({_D[0]}) + exp({_D[1]})) / 4)"))
scores("sum_", "#sum(court jury)", S.query(_CJ[:2], f"ln((exp({_D[0]}) + exp({_D[1]})) / 2)"))
scores("quoted", '#combine("court" "Jury" meeting)', S.query([S.term("court"), S.term("Jury"), S.term("meeting")], _D3))
scores("base64", "#combine(#base64(Y291cnQ=) #base64quote(anVyeQ==))", S.query(_CJ[:2], f"({_D[0]} + {_D[1]}) / 2"))
scores("number_terms", "#combine(17 2011 court)", S.query([S.term("17"), S.term("2011"), S.term("court")], _D3))
scores("or_", "#or(court jury)", S.query(_CJ[:2], f"ln(1 - (1 - exp({_D[0]})) * (1 - exp({_D[1]})))"))
scores("not_", "#combine(court #not(jury))", S.query(_CJ[:2], f"({_D[0]} + ln(1 - exp({_D[1]}))) / 2", gate=[0]))
scores("max_", "#max(court jury meeting)", S.query(_CJ, f"greatest({_D[0]}, {_D[1]}, {_D[2]})"))
scores(
    "nested_beliefs",
    "#weight(1 #combine(court jury) 2 #or(meeting #not(village)) 1 #max(court meeting))",
    S.query(_CJ + [S.term("village")], f"(({_D[0]} + {_D[1]}) / 2 + 2 * ln(1 - (1 - exp({_D[2]})) * exp({_D[3]})) + greatest({_D[0]}, {_D[2]})) / 4", gate=[0, 1, 2]),
)

# extents

extents("syn", "#syn(court jury)", S.syn("court", "jury"))
extents("wsyn", "#wsyn(2 court 0.5 jury)", f"SELECT doc_id, b, e, 2.0 AS w FROM ({S.term('court')}) UNION ALL SELECT doc_id, b, e, 0.5 FROM ({S.term('jury')})")
extents("od1", "#1(copies of the)", S.phrase("copies", "of", "the"))
extents("odn", "#5(the court)", S.ordered("the", "court", 5))
extents("od_unlimited", "#od(the court)", S.ordered("the", "court", None))
extents("uwn", "#uw8(court the)", S.unordered(8, "court", "the"))
extents("uw_unlimited", "#uw(court the meeting)", S.unordered(None, "court", "the", "meeting"))
extents("band", "#band(court jury)", S.unordered(None, "court", "jury"))
extents("hyphen", "copies-of", S.phrase("copies", "of"))
extents("wildcard", "court*", "SELECT doc_id, pos AS b, pos + 1 AS e, 1.0 AS w FROM tok WHERE term LIKE 'court%'")


def stopped_windows(spark, sf):
    c = replace(corpora.documents(spark, sf), stopwords=("of",))
    return inspect.expression_list(c, "#1(copies of the)").unionAll(inspect.expression_list(c, "#uw6(copies of the)")).select("doc_id", "begin", "end", "weight")


plain(
    "stopped_windows",
    stopped_windows,
    f"WITH {S.TOK} SELECT doc_id, b::INTEGER AS \"begin\", e::INTEGER AS \"end\", w::DOUBLE AS weight FROM (({S.ordered('copies', 'the', 2)}) UNION ALL ({S.unordered(6, 'copies', 'the')}))",
)
plain(
    "term_positions",
    lambda s, d: inspect.inverted_list(corpora.documents(s, d), "jury").select("doc_id", F.explode("positions").alias("pos")),
    f"WITH {S.TOK} SELECT doc_id, pos::INTEGER AS pos FROM tok WHERE term = 'jury'",
)
plain(
    "token_offsets",
    lambda s, d: Collection.flat(table(s, d, "documents"), offsets=True).positions,
    """WITH z AS (SELECT doc_id, regexp_extract_all(lower(text), '([^a-z0-9]*)([a-z0-9]+)', 1) AS g, regexp_extract_all(lower(text), '([^a-z0-9]*)([a-z0-9]+)', 2) AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(g) AS g, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS pos FROM z), e AS (SELECT doc_id, pos, length(t) AS n, sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM u)
SELECT doc_id, pos::INTEGER AS pos, (e - n)::INTEGER AS "begin", e::INTEGER AS "end" FROM e""",
)
plain(
    "expr_df_phrase",
    lambda s, d: inspect.expression_counts(corpora.documents(s, d), "#1(copies of the)").select("doc_id", F.col("n").cast("long").alias("n")),
    f"WITH {S.TOK}, {S.leaf(0, S.phrase('copies', 'of', 'the'))} SELECT doc_id, tf::BIGINT AS n FROM l0",
)
extents("expr_list_phrase", "#1(the court)", S.phrase("the", "court"))
scores("score_window", "#combine(court #uw8(the court))", S.query([S.term("court"), S.unordered(8, "the", "court")], f"({_D[0]} + {_D[1]}) / 2"))
scores("score_syn", "#combine(<court jury> meeting)", S.query([S.syn("court", "jury"), S.term("meeting")], f"({_D[0]} + {_D[1]}) / 2"))

# filters, working sets, numbers and dates

_HAS = "EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = cand.doc_id AND t.term = 'village')"
scores("filreq", "#filreq(village #combine(court jury))", S.query(_CJ[:2], f"({_D[0]} + {_D[1]}) / 2", where=f"WHERE {_HAS}"))
scores("filrej", "#filrej(village #combine(court jury))", S.query(_CJ[:2], f"({_D[0]} + {_D[1]}) / 2", where=f"WHERE NOT {_HAS}"))


def working_set(spark, sf):
    c = corpora.documents(spark, sf)
    ids = inspect.by_metadata(c, "lang", ["de"])
    return Compiler(c).run(parse("#combine(court jury)"), ids).select("doc_id", F.round("score", 6).alias("score"))


plain(
    "working_set",
    working_set,
    f"WITH {S.TOK}, {S.leaf(0, S.term('court'))}, {S.leaf(1, S.term('jury'))} SELECT doc_id, round(({_D[0]} + {_D[1]}) / 2, 6) AS score FROM documents d JOIN len USING (doc_id) LEFT JOIN l0 USING (doc_id) LEFT JOIN l1 USING (doc_id) WHERE lang = 'de'",
)


def numbers(name: str, condition: str, where: str):
    scores(name, f"#filreq({condition} court)", S.query(_CJ[:1], _D[0], where=f"JOIN documents d USING (doc_id) WHERE {where}"))


_DAY = "(split_part(stream_id, '-', 1)::BIGINT // 86400)"
numbers("less", "#less(size 800)", "n_chars < 800")
numbers("greater", "#greater(size 1200)", "n_chars > 1200")
numbers("between", "#between(size 700 900)", "n_chars BETWEEN 700 AND 900")
numbers("equals", "#equals(date 150389)", f"{_DAY} = date_diff('day', DATE '1970-01-01', DATE '1600-01-01') + 150389")
numbers("date_equals", "#dateequals(2 october 2011)", f"{_DAY} = date_diff('day', DATE '1970-01-01', DATE '2011-10-02')")
numbers("date_after", "#dateafter(10/1/2011)", f"{_DAY} > date_diff('day', DATE '1970-01-01', DATE '2011-10-01')")
numbers("date_before", "#datebefore(10/2/2011)", f"{_DAY} < date_diff('day', DATE '1970-01-01', DATE '2011-10-02')")
numbers("date_between", "#datebetween(1 october 2011, 3 october 2011)", f"{_DAY} BETWEEN date_diff('day', DATE '1970-01-01', DATE '2011-10-01') AND date_diff('day', DATE '1970-01-01', DATE '2011-10-03')")

# priors, order, paging

scores("prior", "#combine(court #prior(size))", S.query(_CJ[:1], f"({_D[0]} + coalesce(ln(n_chars / (SELECT sum(n_chars) FROM documents WHERE text IS NOT NULL)), -1e100)) / 2", where="JOIN documents d USING (doc_id)"))


def length_prior(spark, sf):
    node = A.LengthPrior(0.5, A.Leaf(A.Term("court")))
    return Compiler(corpora.documents(spark, sf)).run(node).select("doc_id", F.round("score", 6).alias("score"))


plain("length_prior", length_prior, S.query(_CJ[:1], f"{_D[0]} + 0.5 * ln(length)"))
_ORDERED = S.query(_CJ, _D3).replace("round(" + _D3 + ", 6)", _D3)
plain("topk_ties", lambda s, d: Engine(corpora.documents(s, d)).search("court jury meeting", 50).select("doc_id", F.round("score", 6).alias("score")), f"SELECT doc_id, round(score, 6) AS score FROM ({_ORDERED}) ORDER BY round(score, 12) DESC, doc_id DESC LIMIT 50")
plain("paging", lambda s, d: Engine(corpora.documents(s, d)).search("court jury meeting", 20, 30).select("doc_id", F.round("score", 6).alias("score")), f"SELECT doc_id, round(score, 6) AS score FROM ({_ORDERED}) ORDER BY round(score, 12) DESC, doc_id DESC LIMIT 20 OFFSET 30")

# passages

_PSG = f"""WITH {S.TOK}, p AS (SELECT doc_id, b, least(b + 50, length) AS e FROM (SELECT doc_id, length, unnest(range(0, length, 25)) AS b FROM len)),
s AS (SELECT term, count(*)::DOUBLE AS occ FROM tok WHERE term IN ('court', 'jury') GROUP BY term),
tf AS (SELECT p.doc_id, p.b, p.e, count(*) FILTER (term = 'court') AS t0, count(*) FILTER (term = 'jury') AS t1 FROM p JOIN tok ON tok.doc_id = p.doc_id AND pos >= b AND pos < e WHERE term IN ('court', 'jury') GROUP BY ALL),
r AS (SELECT doc_id, b, e, (ln((t0 + 2500 * (SELECT occ / total FROM s, c WHERE term = 'court')) / (e - b + 2500)) + ln((t1 + 2500 * (SELECT occ / total FROM s, c WHERE term = 'jury')) / (e - b + 2500))) / 2 AS score FROM tf)"""
plain(
    "passage",
    lambda s, d: Compiler(corpora.documents(s, d)).run(parse("#combine[passage50:25](court jury)")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    _PSG + ' SELECT doc_id, b::INTEGER AS "begin", e::INTEGER AS "end", round(score, 6) AS score FROM r',
)
plain("passage_max", lambda s, d: Compiler(corpora.documents(s, d)).run(parse("#max(#combine[passage50:25](court jury))")).select("doc_id", F.round("score", 6).alias("score")), _PSG + " SELECT doc_id, round(max(score), 6) AS score FROM r GROUP BY doc_id")

# The document's own counts come in where a model has a document level.
plain(
    "passage_two_level",
    lambda s, d: Compiler(corpora.documents(s, d), Config(rules=["method:dirichlet,mu:1000,documentmu:500"])).run(parse("#combine[passage50:25](court)")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    f"""WITH {S.TOK}, p AS (SELECT doc_id, length, b, least(b + 50, length) AS e FROM (SELECT doc_id, length, unnest(range(0, length, 25)) AS b FROM len)),
d AS (SELECT doc_id, count(*) AS dtf FROM tok WHERE term = 'court' GROUP BY doc_id),
tf AS (SELECT p.doc_id, length, b, e, count(*) AS t FROM p JOIN tok ON tok.doc_id = p.doc_id AND pos >= b AND pos < e WHERE term = 'court' GROUP BY ALL)
SELECT doc_id, b::INTEGER AS "begin", e::INTEGER AS "end", round(ln((t + 500 * (1000 * (SELECT sum(dtf) / max(total) FROM d, c) + dtf) / (length + 1000)) / (e - b + 500)), 6) AS score FROM tf JOIN d USING (doc_id)""",
)
plain(
    "passage_twostage",
    lambda s, d: Compiler(corpora.documents(s, d), Config(rules=["method:twostage,mu:1500,lambda:0.3"])).run(parse("#combine[passage40:40](jury)")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    f"""WITH {S.TOK}, p AS (SELECT doc_id, length, b, least(b + 40, length) AS e FROM (SELECT doc_id, length, unnest(range(0, length, 40)) AS b FROM len)),
d AS (SELECT doc_id, count(*) AS dtf FROM tok WHERE term = 'jury' GROUP BY doc_id),
tf AS (SELECT p.doc_id, length, b, e, count(*) AS t FROM p JOIN tok ON tok.doc_id = p.doc_id AND pos >= b AND pos < e WHERE term = 'jury' GROUP BY ALL)
SELECT doc_id, b::INTEGER AS "begin", e::INTEGER AS "end", round(ln(0.7 * (t + 1500 * dtf / length) / (e - b + 1500) + 0.3 * (SELECT sum(dtf) / max(total) FROM d, c)), 6) AS score FROM tf JOIN d USING (doc_id)""",
)

# fields


def pages_query(text: str, **config):
    return lambda s, d: Compiler(corpora.pages(s, d), Config(**config)).run(parse(text)).select("doc_id", "begin", "end", F.round("score", 6).alias("score"))


_IN = "SELECT DISTINCT tok.doc_id, pos AS b, pos + 1 AS e, 1.0 AS w FROM tok JOIN ext ON ext.doc_id = tok.doc_id AND field = '{f}' AND pos >= \"begin\" AND pos < \"end\" WHERE term = '{t}'"


def _whole(sql: str) -> str:
    return sql.replace("SELECT doc_id, round(", 'SELECT doc_id, 0 AS "begin", length::INTEGER AS "end", round(')


plain("field_restrict", pages_query("#combine(court.title jury.p)"), _whole(S.query([_IN.format(f="title", t="court"), _IN.format(f="p", t="jury")], f"({_D[0]} + {_D[1]}) / 2", base=S.PAGES)))
_CTX = "ln((coalesce(l0.tf, 0) + 2500 * (SELECT occ / (SELECT sum(\"end\" - \"begin\") FROM ext WHERE field = 'title') FROM s0)) / (coalesce((SELECT sum(\"end\" - \"begin\") FROM ext x WHERE x.doc_id = cand.doc_id AND field = 'title'), 0) + 2500))"
plain("field_context", pages_query("#combine(court.(title))"), _whole(S.query([_IN.format(f="title", t="court")], _CTX, base=S.PAGES)))
plain(
    "field_extent_retrieval",
    pages_query("#combine[p](court jury)"),
    f"""WITH {S.PAGES}, u AS (SELECT DISTINCT doc_id, "begin", "end" FROM ext WHERE field = 'p' AND "end" > "begin"),
sz AS (SELECT sum("end" - "begin")::DOUBLE AS ctx FROM ext WHERE field = 'p'),
h AS (SELECT u.doc_id, u."begin", u."end", count(*) FILTER (term = 'court') AS t0, count(*) FILTER (term = 'jury') AS t1 FROM u JOIN tok ON tok.doc_id = u.doc_id AND pos >= "begin" AND pos < "end" WHERE term IN ('court', 'jury') GROUP BY ALL),
o AS (SELECT sum(t0)::DOUBLE AS o0, sum(t1)::DOUBLE AS o1 FROM h)
SELECT doc_id, "begin"::INTEGER AS "begin", "end"::INTEGER AS "end", round((ln((t0 + 2500 * CASE WHEN o0 > 0 THEN o0 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500)) + ln((t1 + 2500 * CASE WHEN o1 > 0 THEN o1 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500))) / 2, 6) AS score FROM h, o, sz""",
)
_P_UNITS = f"""WITH {S.PAGES}, u AS (SELECT DISTINCT doc_id, "begin", "end" FROM ext WHERE field = 'p' AND "end" > "begin"), sz AS (SELECT sum("end" - "begin")::DOUBLE AS ctx FROM ext WHERE field = 'p'),
h AS (SELECT u.doc_id, u."begin", u."end", count(*) FILTER (term = 'court') AS t0, count(*) FILTER (term = 'jury') AS t1 FROM u JOIN tok ON tok.doc_id = u.doc_id AND pos >= "begin" AND pos < "end" GROUP BY ALL),
o AS (SELECT sum(t0)::DOUBLE AS o0, sum(t1)::DOUBLE AS o1 FROM h), dl AS (SELECT doc_id, count(*) FILTER (term = 'court')::DOUBLE AS d0, count(*) AS n FROM tok GROUP BY doc_id)
"""
plain(
    "sibling_scores",
    pages_query("#combine[p](court jury)", score_siblings=True),
    _P_UNITS
    + """SELECT doc_id, "begin"::INTEGER AS "begin", "end"::INTEGER AS "end", round((ln((t0 + 2500 * CASE WHEN o0 > 0 THEN o0 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500)) + ln((t1 + 2500 * CASE WHEN o1 > 0 THEN o1 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500))) / 2, 6) AS score
FROM h, o, sz WHERE doc_id IN (SELECT doc_id FROM h WHERE t0 + t1 > 0)""",
)
plain(
    "field_jm_document",
    pages_query("#combine[p](court)", rules=["method:jm,lambda:0.4,documentlambda:0.2"]),
    _P_UNITS + """SELECT h.doc_id, "begin"::INTEGER AS "begin", "end"::INTEGER AS "end", round(ln(0.4 * t0 / ("end" - "begin") + 0.2 * d0 / n + 0.4 * o0 / ctx), 6) AS score FROM h JOIN dl ON dl.doc_id = h.doc_id, o, sz WHERE t0 > 0""",
)
plain(
    "context_twostage",
    pages_query("#combine(court.(p))", rules=["method:twostage"]),
    _P_UNITS
    + """, x AS (SELECT doc_id, sum(t0) AS t FROM h GROUP BY doc_id HAVING sum(t0) > 0), xl AS (SELECT doc_id, sum("end" - "begin") AS l FROM ext WHERE field = 'p' GROUP BY doc_id)
SELECT x.doc_id, 0 AS "begin", n::INTEGER AS "end", round(ln(0.6 * (t + 2500 * d0 / n) / (l + 2500) + 0.4 * o0 / ctx), 6) AS score FROM x JOIN xl ON xl.doc_id = x.doc_id JOIN dl ON dl.doc_id = x.doc_id, o, sz""",
)
scores("rules_by_node", "#combine(court jury)", S.query(_CJ[:2], f"({S.dirichlet(0, 100)} + {S.dirichlet(1, 100)}) / 2"), rules=["method:dirichlet,mu:100", "node:NestedRawScorerNode,method:dirichlet,mu:7"])


def registered(spark, sf):
    scoring.register("saturation", lambda p, tf, length, counts: F.log(0.01 + tf / (tf + p.get("k", 1.0))))
    return Compiler(corpora.documents(spark, sf), Config(rules=["method:saturation,k:2"])).run(parse("#combine(court jury)")).select("doc_id", F.round("score", 6).alias("score"))


plain("registered_score", registered, S.query(_CJ[:2], "(ln(0.01 + coalesce(l0.tf, 0) / (coalesce(l0.tf, 0) + 2)) + ln(0.01 + coalesce(l1.tf, 0) / (coalesce(l1.tf, 0) + 2))) / 2"))
plain(
    "any_field",
    lambda s, d: Extents(corpora.pages(s, d)).of(parse_extent("#any:h1")).select("doc_id", "begin", "end"),
    f"WITH {S.PAGES} SELECT doc_id, \"begin\"::INTEGER AS \"begin\", \"end\"::INTEGER AS \"end\" FROM ext WHERE field = 'h1'",
)
plain(
    "extent_inside",
    lambda s, d: Extents(corpora.pages(s, d)).of(parse_extent("#1(the court).p")).select("doc_id", "begin", "end"),
    f"""WITH {S.PAGES}, x AS ({S.phrase('the', 'court')}) SELECT doc_id, b::INTEGER AS "begin", e::INTEGER AS "end" FROM x WHERE EXISTS (SELECT 1 FROM ext WHERE ext.doc_id = x.doc_id AND field = 'p' AND "begin" <= b AND "end" >= e)""",
)
plain(
    "term_field_stats",
    lambda s, d: inspect.term_field_stats(corpora.pages(s, d), "title"),
    f"WITH {S.PAGES} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT tok.doc_id, tok.pos, term FROM tok JOIN ext ON ext.doc_id = tok.doc_id AND field = 'title' AND pos >= \"begin\" AND pos < \"end\") GROUP BY term",
)

# structure

_LINES = f"""WITH {S.TOK}, sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM sp),
lc AS (SELECT doc_id, i, len(regexp_extract_all(lower(l), '[a-z0-9]+')) AS n, CASE WHEN regexp_replace(l, '\\s+', '', 'g') = '' THEN 1 ELSE 0 END AS gap FROM ln),
lp AS (SELECT doc_id, n, sum(n) OVER w AS e, sum(gap) OVER w AS para FROM lc WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
li AS (SELECT doc_id, (e - n)::INTEGER AS "begin", e::INTEGER AS "end", para FROM lp WHERE n > 0),
pa AS (SELECT doc_id, min("begin") AS "begin", max("end") AS "end" FROM li GROUP BY doc_id, para)
"""


def path_query(axis: str, name: str, outer: A.Node):
    return lambda s, d: Extents(corpora.documents(s, d)).of(A.Path(axis, name, outer)).select("doc_id", "begin", "end")


plain("child", path_query("child", "line", A.AnyField("para")), _LINES + 'SELECT doc_id, "begin", "end" FROM li')
plain("parent", path_query("parent", "para", A.AnyField("line")), _LINES + 'SELECT doc_id, "begin", "end" FROM pa')
plain("descendant", path_query("descendant", "line", A.AnyField("document")), _LINES + 'SELECT doc_id, "begin", "end" FROM li')
plain(
    "line_retrieval",
    lambda s, d: Compiler(corpora.documents(s, d)).run(parse("#combine[line](court)")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    _LINES
    + """, h AS (SELECT li.doc_id, "begin", "end", count(*) AS tf FROM li JOIN tok ON tok.doc_id = li.doc_id AND pos >= "begin" AND pos < "end" WHERE term = 'court' GROUP BY ALL)
SELECT doc_id, "begin", "end", round(ln((tf + 2500 * (SELECT sum(tf) FROM h) / (SELECT sum("end" - "begin") FROM li)) / ("end" - "begin" + 2500)), 6) AS score FROM h""",
)


def lines_query(text: str, language=parse, **config):
    return lambda s, d: Compiler(corpora.documents(s, d), Config(**config)).run(language(text)).select("doc_id", "begin", "end", F.round("score", 6).alias("score"))


#: Lines and paragraphs with their occurrences and the log scores of `court` and `jury` in their kind.
_SCORED_LINES = (
    _LINES
    + """, tt AS (SELECT doc_id, pos, term FROM tok WHERE term IN ('court', 'jury')),
hl AS (SELECT li.doc_id, para, "begin", "end", count(*) FILTER (term = 'court') AS c, count(*) FILTER (term = 'jury') AS j FROM li LEFT JOIN tt ON tt.doc_id = li.doc_id AND pos >= "begin" AND pos < "end" GROUP BY ALL),
hp AS (SELECT pa.doc_id, "begin", "end", count(*) FILTER (term = 'court') AS c, count(*) FILTER (term = 'jury') AS j FROM pa LEFT JOIN tt ON tt.doc_id = pa.doc_id AND pos >= "begin" AND pos < "end" GROUP BY ALL),
nl AS (SELECT sum("end" - "begin") AS n, sum(c) AS oc, sum(j) AS oj FROM hl), np AS (SELECT sum("end" - "begin") AS n, sum(c) AS oc, sum(j) AS oj FROM hp),
sl AS (SELECT hl.*, ln((c + 2500 * oc / n) / ("end" - "begin" + 2500)) AS sc, ln((j + 2500 * oj / n) / ("end" - "begin" + 2500)) AS sj FROM hl, nl),
pq AS (SELECT hp.*, ln((c + 2500 * oc / n) / ("end" - "begin" + 2500)) AS sc FROM hp, np)
"""
)
plain(
    "child_query",
    lines_query("#combine[para](#max(#combine[./line](court)))"),
    _SCORED_LINES + 'SELECT pq.doc_id, pq."begin", pq."end", round(max(sl.sc), 6) AS score FROM pq JOIN sl ON sl.doc_id = pq.doc_id AND sl."begin" >= pq."begin" AND sl."end" <= pq."end" WHERE sl.c > 0 GROUP BY ALL',
)
plain(
    "descendant_query",
    lines_query("#combine[document](#max(#combine[.//line](court)))"),
    _SCORED_LINES + 'SELECT doc_id, 0 AS "begin", length::INTEGER AS "end", round(max(sc), 6) AS score FROM sl JOIN len USING (doc_id) WHERE c > 0 GROUP BY ALL',
)
plain(
    "two_step_path",
    lines_query("//para[about(., court)]//line[about(., jury)]", parse_paths),
    _SCORED_LINES + 'SELECT sl.doc_id, sl."begin", sl."end", round((sl.sj + pq.sc) / 2, 6) AS score FROM sl JOIN pq ON sl.doc_id = pq.doc_id AND sl."begin" >= pq."begin" AND sl."end" <= pq."end" WHERE sl.j > 0',
)
plain(
    "path_logic",
    lines_query('//line[about(., "the court" -jury) or about(., +court)]', parse_paths),
    _SCORED_LINES
    + f""", ph AS ({S.phrase('the', 'court')}), hq AS (SELECT hl.doc_id, hl."begin", hl."end", count(b) AS q FROM hl LEFT JOIN ph ON ph.doc_id = hl.doc_id AND b >= "begin" AND e <= "end" GROUP BY ALL), nq AS (SELECT sum(q) AS oq FROM hq),
z AS (SELECT sl.*, q, (ln((q + 2500 * oq / n) / (sl."end" - sl."begin" + 2500)) + ln(1 - exp(sj))) / 2 AS a FROM sl JOIN hq ON hq.doc_id = sl.doc_id AND hq."begin" = sl."begin" AND hq."end" = sl."end", nq, nl)
SELECT doc_id, "begin", "end", round(ln(1 - (1 - exp(a)) * (1 - exp(sc))), 6) AS score FROM z WHERE q > 0 OR c > 0""",
)
plain(
    "path_fields",
    lambda s, d: Compiler(corpora.pages(s, d)).run(parse_paths("//(h1|title)[about(., court)]")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    f"""WITH {S.PAGES}, u AS (SELECT DISTINCT doc_id, "begin", "end" FROM ext WHERE field IN ('h1', 'title') AND "end" > "begin"), sz AS (SELECT sum("end" - "begin")::DOUBLE AS ctx FROM ext WHERE field IN ('h1', 'title')),
h AS (SELECT u.doc_id, u."begin", u."end", count(*) AS t FROM u JOIN tok ON tok.doc_id = u.doc_id AND pos >= "begin" AND pos < "end" AND term = 'court' GROUP BY ALL)
SELECT doc_id, "begin"::INTEGER AS "begin", "end"::INTEGER AS "end", round(ln((t + 2500 * (SELECT sum(t) FROM h) / ctx) / ("end" - "begin" + 2500)), 6) AS score FROM h, sz""",
)
#: Shrinkage: lines into paragraphs into documents by 0.3 a child, then 0.2 from the parent, the document and the collection each.
_RULES = Shrinkage(children={"line": 0.3, "para": 0.3})


def _shrunk(t: str) -> str:
    return f"""m{t} AS (SELECT doc_id, para, {t}::DOUBLE / ("end" - "begin") AS m FROM hl),
lp{t} AS (SELECT doc_id, para, avg(m) AS m, least(0.3 * count(*), 1) AS w FROM m{t} GROUP BY ALL),
p{t} AS (SELECT b.doc_id, b.para, b."begin", b."end", (1 - w) * {t}::DOUBLE / (b."end" - b."begin") + w * m AS m FROM (SELECT doc_id, para, min("begin") AS "begin", max("end") AS "end", sum({t}) AS {t} FROM hl GROUP BY ALL) b JOIN lp{t} USING (doc_id, para)),
dp{t} AS (SELECT doc_id, avg(m) AS m, least(0.3 * count(*), 1) AS w FROM p{t} GROUP BY ALL),
d{t} AS (SELECT doc_id, 0.8 * ((1 - w) * x / length + w * m) + 0.2 * g AS m, x, g FROM dp{t} JOIN (SELECT doc_id, sum({t})::DOUBLE AS x FROM hl GROUP BY ALL) USING (doc_id) JOIN len USING (doc_id), (SELECT sum({t}) / (SELECT total FROM c) AS g FROM hl)),
f{t} AS (SELECT p{t}.doc_id, "begin", "end", 0.4 * p{t}.m + 0.4 * d{t}.m + 0.2 * g AS m FROM p{t} JOIN d{t} ON d{t}.doc_id = p{t}.doc_id)"""


_SHRUNK = _SCORED_LINES + f", {_shrunk('c')}, {_shrunk('j')} "
plain(
    "shrinkage",
    lambda s, d: shrinkage_scores(corpora.documents(s, d), "para", ["court", "jury"], _RULES).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    _SHRUNK + 'SELECT fc.doc_id, fc."begin", fc."end", round((ln(fc.m) + ln(fj.m)) / 2, 6) AS score FROM fc JOIN fj USING (doc_id, "begin", "end") WHERE fc.doc_id IN (SELECT doc_id FROM hl WHERE c + j > 0)',
)
plain(
    "path_shrinkage",
    lines_query("//para[about(., court jury)]", parse_paths, shrinkage=_RULES),
    _SHRUNK + 'SELECT hp.doc_id, hp."begin", hp."end", round((ln(fc.m) + ln(fj.m)) / 2, 6) AS score FROM hp JOIN fc ON fc.doc_id = hp.doc_id AND fc."begin" = hp."begin" AND fc."end" = hp."end" JOIN fj ON fj.doc_id = hp.doc_id AND fj."begin" = hp."begin" AND fj."end" = hp."end" WHERE hp.c + hp.j > 0',
)
