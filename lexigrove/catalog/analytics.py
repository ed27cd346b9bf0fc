"""Queries of feedback, dependence models, links, passages and the stream filter, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.catalog import corpora
from lexigrove.catalog import sqltext as S
from lexigrove.operators import feedback, links, passages, reformulate, snippets
from lexigrove.plans.compile import Compiler, ranked
from lexigrove.plans.parser import parse
from lexigrove.plans.xpath import parse_paths
from lexigrove.session import table
from lexigrove.streaming import filtering as Z

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, run, sql: str | None = None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# feedback: models over the ten best documents of `court jury`

_TWO = [S.term("court"), S.term("jury")]
_SCORE = f"({S.dirichlet(0)} + {S.dirichlet(1)}) / 2"
_PLAIN = f"SELECT doc_id, round({_SCORE}, 6) AS score FROM cand"
_TOP = (
    S.query(_TWO, _SCORE).replace(") " + _PLAIN, f"), res AS (SELECT doc_id, length, {_SCORE} AS score FROM cand")
    + "), top AS (SELECT * FROM res ORDER BY round(score, 12) DESC, doc_id DESC LIMIT 10), post AS (SELECT doc_id, length, score, exp(score - (SELECT max(score) FROM top)) / (SELECT sum(exp(score - (SELECT max(score) FROM top))) FROM top) AS p FROM top)"
)
_STATS = ", ts AS (SELECT term, count(*)::DOUBLE AS cf, count(DISTINCT doc_id)::DOUBLE AS df FROM tok GROUP BY term), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok SEMI JOIN top USING (doc_id) GROUP BY ALL)"


def _results(spark, sf):
    return feedback.feedback_results(corpora.documents(spark, sf), "court jury", 10)


add(
    "relevance_model",
    lambda s, d: feedback.relevance_model(corpora.documents(s, d), _results(s, d)).select(F.col("gram").alias("term"), F.round("weight", 6).alias("weight")),
    _TOP + _STATS + " SELECT term, round(sum(p * tf / length), 6) AS weight FROM tf JOIN post USING (doc_id) GROUP BY term",
)
add(
    "relevance_model_smoothed",
    lambda s, d: feedback.relevance_model(corpora.documents(s, d), _results(s, d), mu=1000).select(F.col("gram").alias("term"), F.round("weight", 6).alias("weight")),
    _TOP
    + _STATS
    + ", g AS (SELECT DISTINCT term FROM tf) SELECT g.term, round(sum(p * (coalesce(tf, 0) + 1000 * cf / total) / (length + 1000)), 6) AS weight FROM g JOIN ts USING (term) JOIN post ON true LEFT JOIN tf ON tf.term = g.term AND tf.doc_id = post.doc_id, c GROUP BY g.term",
)
add(
    "relevance_bigrams",
    lambda s, d: feedback.relevance_model(corpora.documents(s, d), _results(s, d), max_grams=2).filter("n = 2").select("gram", F.round("weight", 6).alias("weight")),
    _TOP + " SELECT a.term || ' ' || b.term AS gram, round(sum(p / length), 6) AS weight FROM post JOIN tok a USING (doc_id) JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 GROUP BY 1",
)
add(
    "rocchio_model",
    lambda s, d: feedback.rocchio_model(corpora.documents(s, d), _results(s, d), 10).select("term", F.round("weight", 6).alias("weight")),
    _TOP
    + _STATS
    + " SELECT term, round(sum(1.2 * tf / (tf + 0.3 + 0.9 * length / (total / n)) * ln((n + 1) / (df + 0.5))) / (SELECT count(*) FROM top) * 0.5, 6) AS weight FROM tf JOIN top USING (doc_id) JOIN ts USING (term), c GROUP BY term",
)
add(
    "ponte_model",
    lambda s, d: feedback.ponte_model(corpora.documents(s, d), _results(s, d)).select("term", F.round("odds", 6).alias("odds"), F.round("weight", 9).alias("weight")),
    _TOP + _STATS + " SELECT term, round(sum(ln(tf / length / (cf / total))), 6) AS odds, round(sum(exp(score) * tf / length), 9) AS weight FROM tf JOIN top USING (doc_id) JOIN ts USING (term), c WHERE tf >= 2 GROUP BY term",
)
add(
    "clarity",
    lambda s, d: feedback.clarity_score(corpora.documents(s, d), "court jury", docs=10, terms=None).select(F.round("clarity", 6).alias("clarity")),
    _TOP + _STATS + ", rm AS (SELECT term, sum(p * tf / length) AS weight FROM tf JOIN post USING (doc_id) GROUP BY term) SELECT round(sum(weight * log2(weight / (cf / total))) / sum(weight), 6) AS clarity FROM rm JOIN ts USING (term), c",
)


def expanded(model):
    def run(spark, sf):
        c = corpora.documents(spark, sf)
        return Compiler(c).run(parse(model(c, "court jury"))).select("doc_id", F.round("score", 6).alias("score"))

    return run


# What weighted terms m(term, w) add to a document: the mean, by weight, of all terms' scores, absent ones included.
_OF_TERMS = """, rt AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok WHERE term IN (SELECT term FROM m) GROUP BY ALL),
cm AS (SELECT doc_id FROM rt UNION SELECT doc_id FROM res),
mb AS (SELECT sum(w) AS sw, sum(w * ln(2500 * cf / total)) AS b FROM m JOIN ts USING (term), c),
ma AS (SELECT doc_id, sum(w * (ln(tf + 2500 * cf / total) - ln(2500 * cf / total))) AS a FROM rt JOIN m USING (term) JOIN ts USING (term), c GROUP BY doc_id),
ms AS (SELECT doc_id, (b + coalesce(a, 0)) / sw - ln(length + 2500) AS m FROM cm JOIN len USING (doc_id) LEFT JOIN ma USING (doc_id), mb)
"""
_MIXED = _OF_TERMS + f"SELECT doc_id, round(0.5 * {_SCORE} + 0.5 * m, 6) AS score FROM ms JOIN len USING (doc_id) LEFT JOIN l0 USING (doc_id) LEFT JOIN l1 USING (doc_id)"
add("rm_expand", expanded(feedback.expand_rm), _TOP + _STATS + ", m AS (SELECT term, sum(p * tf / length) AS w FROM tf JOIN post USING (doc_id) GROUP BY term ORDER BY round(w, 12) DESC, term LIMIT 10)" + _MIXED)
add(
    "ponte_expand",
    expanded(feedback.expand_ponte),
    _TOP
    + _STATS
    + ", m AS (SELECT term, w FROM (SELECT term, sum(ln(tf / length / (cf / total))) AS odds, sum(exp(score) * tf / length) AS w FROM tf JOIN top USING (doc_id) JOIN ts USING (term), c WHERE tf >= 2 GROUP BY term) ORDER BY round(odds, 12) DESC, term LIMIT 10)"
    + _MIXED,
)
add(
    "rocchio_expand",
    expanded(feedback.expand_rocchio),
    _TOP
    + _STATS
    + """, rc AS (SELECT * FROM (SELECT term, sum(1.2 * tf / (tf + 0.3 + 0.9 * length / (total / n)) * ln((n + 1) / (df + 0.5))) / (SELECT count(*) FROM top) * 0.5 AS w FROM tf JOIN top USING (doc_id) JOIN ts USING (term), c GROUP BY term) ORDER BY round(w, 12) DESC, term LIMIT 10),
m AS (SELECT term, sum(w) AS w FROM (SELECT * FROM rc UNION ALL SELECT term, ln((n + 1) / (df + 0.5)) * 1000 / 1001 FROM ts, c WHERE term IN ('court', 'jury')) GROUP BY term)"""
    + _OF_TERMS.replace("SELECT doc_id FROM rt UNION SELECT doc_id FROM res", "SELECT DISTINCT doc_id FROM rt")
    + "SELECT doc_id, round(m, 6) AS score FROM ms",
)

# dependence models


def reformulated(model: str):
    def run(spark, sf):
        q = reformulate.reformulate("What is the court of the jury meeting?", model=model, frames=("why is", "what is the", "what is"))
        return Compiler(corpora.documents(spark, sf)).run(parse(q)).select("doc_id", F.round("score", 6).alias("score"))

    return run


_T3 = [S.term("court"), S.term("jury"), S.term("meeting")]
_P = [S.phrase("court", "jury"), S.phrase("jury", "meeting")]
_D = [S.dirichlet(k) for k in range(9)]
add("sdm", reformulated("sdm"), S.query(_T3 + _P + [S.unordered(8, "court", "jury"), S.unordered(8, "jury", "meeting")], f"0.85 * ({_D[0]} + {_D[1]} + {_D[2]}) / 3 + 0.1 * ({_D[3]} + {_D[4]}) / 2 + 0.05 * ({_D[5]} + {_D[6]}) / 2"))
add(
    "fdm",
    reformulated("fdm"),
    S.query(
        _T3 + [_P[0], S.phrase("court", "jury", "meeting"), _P[1], S.unordered(8, "court", "jury"), S.unordered(12, "court", "jury", "meeting"), S.unordered(8, "jury", "meeting")],
        f"0.85 * ({_D[0]} + {_D[1]} + {_D[2]}) / 3 + 0.1 * ({_D[3]} + {_D[4]} + {_D[5]}) / 3 + 0.05 * ({_D[6]} + {_D[7]} + {_D[8]}) / 3",
    ),
)
add(
    "xpath_query",
    lambda s, d: Compiler(corpora.pages(s, d)).run(parse_paths("//p[about(., court jury)]")).select("doc_id", "begin", "end", F.round("score", 6).alias("score")),
    f"""WITH {S.PAGES}, u AS (SELECT DISTINCT doc_id, "begin", "end" FROM ext WHERE field = 'p' AND "end" > "begin"), sz AS (SELECT sum("end" - "begin")::DOUBLE AS ctx FROM ext WHERE field = 'p'),
h AS (SELECT u.doc_id, u."begin", u."end", count(*) FILTER (term = 'court') AS t0, count(*) FILTER (term = 'jury') AS t1 FROM u JOIN tok ON tok.doc_id = u.doc_id AND pos >= "begin" AND pos < "end" WHERE term IN ('court', 'jury') GROUP BY ALL),
o AS (SELECT sum(t0)::DOUBLE AS o0, sum(t1)::DOUBLE AS o1 FROM h)
SELECT doc_id, "begin"::INTEGER AS "begin", "end"::INTEGER AS "end", round((ln((t0 + 2500 * CASE WHEN o0 > 0 THEN o0 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500)) + ln((t1 + 2500 * CASE WHEN o1 > 0 THEN o1 / ctx ELSE 0.5 / ctx END) / ("end" - "begin" + 2500))) / 2, 6) AS score FROM h, o, sz""",
)


def snippet(spark, sf):
    c = corpora.documents(spark, sf)
    top = ranked(Compiler(c).run(parse("court jury")), 100)
    return snippets.snippets(c, "court jury", top)


add("snippet", snippet)
add("annotations", lambda s, d: snippets.annotate(corpora.documents(s, d), "#combine(court #1(the court))", Compiler(corpora.documents(s, d)).run(parse("#combine(court #1(the court))"))), f"WITH {S.TOK}, x0 AS ({S.term('court')}), x1 AS ({S.phrase('the', 'court')}) SELECT doc_id, 'n0' AS node, b::INTEGER AS \"begin\", e::INTEGER AS \"end\" FROM x0 UNION ALL SELECT doc_id, 'n1', b::INTEGER, e::INTEGER FROM x1")

# links among topics


def _links(spark, sf):
    t = table(spark, sf, "topics")
    e = t.select(F.col("target_id").alias("src"), F.explode("related_entities").alias("dst"), F.col("label").alias("anchor"))
    return e, t.select(F.col("target_id").alias("id"))


def pagerank(spark, sf):
    e, n = _links(spark, sf)
    return links.pagerank(e, n, 0.85, 5).select("id", F.round("rank", 9).alias("rank"))


_PR = "WITH e0 AS (SELECT DISTINCT target_id AS src, unnest(related_entities) AS dst FROM topics), o AS (SELECT src, count(*) AS k FROM e0 GROUP BY src), e AS (SELECT src, dst, k FROM e0 JOIN o USING (src)), n AS (SELECT DISTINCT target_id AS id FROM topics), m AS (SELECT count(*)::DOUBLE AS m FROM n), r0 AS (SELECT id, 1 / m AS r FROM n, m)"
for _i in range(1, 6):
    _PR += f", r{_i} AS (SELECT n.id, 0.15 / any_value(m) + 0.85 * coalesce(sum(p.r / k), 0) AS r FROM n CROSS JOIN m LEFT JOIN (e JOIN r{_i - 1} p ON p.id = e.src) ON dst = n.id GROUP BY n.id)"
add("pagerank", pagerank, _PR + " SELECT id, round(r, 9) AS rank FROM r5")


def bins(spark, sf):
    e, n = _links(spark, sf)
    return links.rank_bins(links.pagerank(e, n, 0.85, 5).select("id", F.round("rank", 9).alias("rank"))).select("id", F.col("bin").cast("long").alias("bin"))


# Bin k from the top holds as many ranks as all before it times a factor; the first has none.
add(
    "rank_bins",
    bins,
    _PR.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, base AS (SELECT power(count(*) + 1, 0.1) AS f, count(*) AS n FROM n),
b(bin, lo, hi, size) AS (SELECT 10, 0::BIGINT, floor(f - 1)::BIGINT, floor(f - 1)::BIGINT FROM base
  UNION ALL SELECT bin - 1, hi, hi + CASE WHEN size = 0 THEN 1 ELSE ceil(f * size)::BIGINT END, CASE WHEN size = 0 THEN 1 ELSE ceil(f * size)::BIGINT END FROM b, base WHERE bin > 2 AND hi < n),
pl AS (SELECT id, row_number() OVER (ORDER BY round(r, 9) DESC, id) - 1 AS place FROM r5) SELECT id, coalesce((SELECT max(bin) FROM b WHERE place >= lo AND place < hi), 1)::BIGINT AS bin FROM pl""",
)


def redirected(spark, sf):
    t = table(spark, sf, "topics").filter("size(related_entities) > 0")
    moved = t.select(F.col("target_id").alias("url"), F.element_at("related_entities", 1).alias("target"))
    return links.link_keys(links.resolved(_links(spark, sf)[0], moved)).select("src", "dst", "key")


add(
    "redirected_links",
    redirected,
    """WITH RECURSIVE f AS (SELECT target_id AS url, min(related_entities[1]) AS target FROM topics WHERE len(related_entities) > 0 AND target_id IS NOT NULL AND related_entities[1] IS NOT NULL GROUP BY target_id HAVING min(related_entities[1]) <> target_id),
w(url, target, k) AS (SELECT url, target, 1 FROM f UNION ALL SELECT w.url, f.target, k + 1 FROM w JOIN f ON f.url = w.target WHERE k <= (SELECT count(*) FROM f)),
e AS (SELECT url, target FROM w WHERE target NOT IN (SELECT url FROM f)), l AS (SELECT target_id AS src, unnest(related_entities) AS dst FROM topics)
SELECT src, coalesce(target, dst) AS dst, sha1(coalesce(target, dst)) AS key FROM l LEFT JOIN e ON dst = url""",
)
add(
    "link_counts",
    lambda s, d: links.link_counts(_links(s, d)[0]),
    "WITH e AS (SELECT DISTINCT target_id AS src, unnest(related_entities) AS dst FROM topics) SELECT id, sum(i)::BIGINT AS links_in, sum(o)::BIGINT AS links_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY id",
)
add(
    "anchor_text",
    lambda s, d: links.anchor_texts(_links(s, d)[0]).select("dst", "n_links", F.array_join("anchors", "|").alias("anchors")),
    "WITH e AS (SELECT unnest(related_entities) AS dst, trim(label) AS anchor FROM topics WHERE trim(label) <> '') SELECT dst, sum(n)::BIGINT AS n_links, string_agg(anchor, '|' ORDER BY anchor) AS anchors FROM (SELECT dst, anchor, count(*) AS n FROM e GROUP BY ALL) GROUP BY dst",
)

# passages

_CUT = f"""WITH {S.TOK}, d AS (SELECT doc_id, list(term ORDER BY pos) AS ts FROM tok GROUP BY doc_id),
z AS (SELECT doc_id, ts, len(ts) AS n, greatest(len(ts) - 60, 0) // 40 AS whole, greatest(len(ts) - 60, 0) % 40 AS tail FROM d),
i AS (SELECT *, unnest(range(0, whole + 1 + CASE WHEN tail > 20 THEN 1 ELSE 0 END)) AS psg_id FROM z),
ps AS (SELECT doc_id, psg_id::INTEGER AS psg_id, ts[psg_id * 40 + 1 : psg_id * 40 + 60 + CASE WHEN psg_id = whole AND tail <= 20 THEN tail ELSE 0 END] AS ts FROM i)"""
_LM = " + ".join(f"ln((len(list_filter(ts, lambda x: x = '{t}')) + 2500 * (SELECT count(*)::DOUBLE FROM tok WHERE term = '{t}') / total) / (len(ts) + 2500))" for t in ("court", "jury"))
_PSCORE = _CUT + f", sc AS (SELECT doc_id, psg_id, len(ts) AS size, {_LM} AS score FROM ps, c)"


def _psgs(spark, sf):
    return passages.passages(corpora.documents(spark, sf), 60, 20)


def _pscores(spark, sf):
    c = corpora.documents(spark, sf)
    return passages.passage_scores(c, _psgs(spark, sf), ["court", "jury"])


add("sliding_passages", lambda s, d: _psgs(s, d).select("doc_id", "psg_id", F.size("terms").cast("long").alias("size"), F.md5(F.array_join("terms", " ")).alias("hash")), _CUT + " SELECT doc_id, psg_id, len(ts) AS size, md5(array_to_string(ts, ' ')) AS hash FROM ps")
add("passage_lm", lambda s, d: _pscores(s, d).select("doc_id", "psg_id", F.round("score", 6).alias("score")), _PSCORE + " SELECT doc_id, psg_id, round(score, 6) AS score FROM sc")
add("best_passage", lambda s, d: passages.best_passages(_pscores(s, d)).select("doc_id", F.round("score", 6).alias("score")), _PSCORE + " SELECT doc_id, round(max(score), 6) AS score FROM sc GROUP BY doc_id")
_COS = (
    _CUT
    + """, ts0 AS (SELECT term, ln((SELECT n FROM c) / count(DISTINCT doc_id)) AS idf FROM tok GROUP BY term),
dw AS (SELECT doc_id, term, floor(any_value(idf) * count(*) + 0.5) AS w FROM tok JOIN ts0 USING (term) GROUP BY ALL),
pw AS (SELECT doc_id, psg_id, term, floor(any_value(idf) * count(*) + 0.5) AS w FROM (SELECT doc_id, psg_id, unnest(ts) AS term FROM ps) JOIN ts0 USING (term) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id),
x AS (SELECT pw.doc_id, psg_id, sum(pw.w * dw.w) AS dot, sqrt(sum(pw.w * pw.w)) AS pn FROM pw JOIN dw ON dw.doc_id = pw.doc_id AND dw.term = pw.term GROUP BY ALL),
hom AS (SELECT doc_id, avg(CASE WHEN pn > 0 AND dn > 0 THEN dot / (pn * dn) ELSE 0 END) AS h FROM x JOIN dn USING (doc_id) GROUP BY doc_id)"""
)
add("cosine_homogeneity", lambda s, d: passages.cosine_homogeneity(corpora.documents(s, d), _psgs(s, d)).select("doc_id", F.round("h", 6).alias("h")), _COS + " SELECT doc_id, round(h, 6) AS h FROM hom")
_LH = "SELECT doc_id, CASE WHEN hi > lo THEN 1 - (ln(length) - lo) / (hi - lo) ELSE 1 END AS h FROM len, (SELECT ln(min(length)) AS lo, ln(max(length)) AS hi FROM len)"
add("length_homogeneity", lambda s, d: passages.length_homogeneity(corpora.documents(s, d).lengths()).select("doc_id", F.round("h", 6).alias("h")), f"WITH {S.TOK} SELECT doc_id, round(h, 6) AS h FROM ({_LH})")


def interpolated(spark, sf):
    c = corpora.documents(spark, sf)
    results = Compiler(c).run(parse("court jury"))
    return passages.interpolated(results, passages.best_passages(_pscores(spark, sf)), passages.length_homogeneity(c.lengths())).select("doc_id", F.round("score", 6).alias("score"))


add(
    "interpolated_passage",
    interpolated,
    _PSCORE
    + f", {S.leaf(0, _TWO[0])}, {S.leaf(1, _TWO[1])}, cand AS (SELECT doc_id FROM l0 UNION SELECT doc_id FROM l1), r AS (SELECT doc_id, {_SCORE} AS d FROM cand JOIN len USING (doc_id) LEFT JOIN l0 USING (doc_id) LEFT JOIN l1 USING (doc_id)), hom AS ({_LH}) SELECT doc_id, round(h * d + (1 - h) * p, 6) AS score FROM r JOIN hom USING (doc_id) JOIN (SELECT doc_id, max(score) AS p FROM sc GROUP BY doc_id) USING (doc_id)",
)

# the stream filter over stream items and topics

_STREAM = r"""WITH it AS (SELECT stream_id, min(substr(dir_name, 1, 10)) AS day FROM stream_items WHERE stream_id IS NOT NULL AND dir_name IS NOT NULL GROUP BY stream_id),
dx AS (SELECT stream_id, max(text) AS text FROM documents WHERE stream_id IS NOT NULL GROUP BY stream_id HAVING max(text) IS NOT NULL),
ws AS (SELECT stream_id, day, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2) AS ws FROM it JOIN dx USING (stream_id)),
tm AS (SELECT stream_id, day, size, term, count(*) AS tf FROM (SELECT stream_id, day, len(ws) AS size, unnest(ws) AS term FROM ws) GROUP BY ALL),
q0 AS (SELECT target_id, 'label' AS kind, lower(unnest(label_tokens)) AS term FROM topics UNION ALL SELECT target_id, 'abstract', t FROM (SELECT target_id, unnest(regexp_extract_all(lower(abstract), '[a-z0-9]+')) AS t FROM topics) WHERE length(t) > 2),
q1 AS (SELECT target_id, kind, term, count(*) AS qtf FROM q0 WHERE term <> '' GROUP BY ALL),
q AS (SELECT *, sum(qtf) OVER (PARTITION BY target_id, kind) AS qlen, max(CASE WHEN kind = 'abstract' THEN 1 ELSE 0 END) OVER (PARTITION BY target_id) AS has FROM q1),
dt AS (SELECT day, count(*) AS docs, sum(size)::BIGINT AS tokens FROM (SELECT DISTINCT stream_id, day, size FROM tm) GROUP BY day),
rt AS (SELECT day, coalesce(sum(docs) OVER w, 0)::BIGINT AS docs, coalesce(sum(tokens) OVER w, 0)::BIGINT AS tokens FROM dt WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dd AS (SELECT day, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tm WHERE term IN (SELECT term FROM q) GROUP BY ALL)
"""
_SCORES = """, st AS (SELECT rt.day, term, sum(df) AS df, sum(cf) AS cf FROM rt JOIN dd ON dd.day < rt.day GROUP BY ALL),
mt AS (SELECT DISTINCT target_id, stream_id, tm.day, size, docs, tokens, round(tokens / docs) AS mean FROM tm JOIN q ON q.term = tm.term AND kind = 'label' JOIN rt ON rt.day = tm.day WHERE docs > 0),
j AS (SELECT mt.*, kind, qtf, qlen, has, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf FROM mt JOIN q USING (target_id) LEFT JOIN tm ON tm.stream_id = mt.stream_id AND tm.term = q.term LEFT JOIN st ON st.day = mt.day AND st.term = q.term),
v AS (SELECT *, CASE WHEN tf > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.75 * 0.25 + 1.75 * 0.75 * size / mean) ELSE 0 END AS bm,
  CASE WHEN tf + 2500.0 * cf / tokens > 1e-4 THEN ln(tf + 2500.0 * cf / tokens) ELSE 0 END - ln(size + 2500.0) AS lm FROM j),
sc AS (SELECT target_id, stream_id, day, coalesce(sum(bm) FILTER (kind = 'label'), 0) AS bm25, coalesce(sum(bm) FILTER (kind = 'abstract'), 0) AS bm25_ext, coalesce(sum(lm) FILTER (kind = 'label'), 0) AS lm, coalesce(sum(lm) FILTER (kind = 'abstract'), 0) AS lm_ext,
  coalesce(sum(lm * qtf / qlen) FILTER (kind = CASE WHEN has = 1 THEN 'abstract' ELSE 'label' END), 0) AS kl FROM v GROUP BY ALL)
"""


def _terms(spark, sf):
    return corpora.item_terms(spark, sf)


def _stream_scores(spark, sf, models=Z.MODELS):
    q, rows = corpora.item_rows(spark, sf)
    return Z.scored_rows(rows, q, Z.materialise(Z.running_totals(Z.row_totals(rows))), Z.materialise(Z.running_terms(Z.day_terms(Z.flat(rows), q))), models)


def model(name: str):
    return lambda s, d: _stream_scores(s, d, [name]).select("target_id", "stream_id", "day", (F.round("score", 6) + 0.0).alias("score"))


add("stream_term_stats", lambda s, d: Z.day_terms(_terms(s, d), Z.query_terms(table(s, d, "topics"))), _STREAM + "SELECT day, term, df, cf FROM dd")
add("stream_corpus_stats", lambda s, d: Z.running_totals(Z.day_totals(_terms(s, d))).select("day", "docs", "tokens"), _STREAM + "SELECT day, docs, tokens FROM rt")
for _m in ("bm25", "bm25_ext", "lm", "lm_ext", "kl"):
    add(f"stream_{_m}", model(_m), _STREAM + _SCORES + f"SELECT target_id, stream_id, day, round({_m}, 6) + 0.0 AS score FROM sc")
# Whole scores of the pool are cut off near whole thousandths in the same way on both sides.
_POOLED = (
    _STREAM
    + _SCORES
    + """, u AS (UNPIVOT (SELECT target_id, stream_id, day, bm25, bm25_ext, lm, lm_ext, kl FROM sc) ON bm25, bm25_ext, lm, lm_ext, kl INTO NAME model VALUE v),
pl AS (SELECT model, target_id, day, stream_id, floor(round(v, 9) * 1000)::BIGINT AS score FROM u),
pn AS (SELECT *, row_number() OVER (PARTITION BY model, target_id, day ORDER BY score DESC, stream_id) AS place FROM pl) SELECT model, target_id, day, stream_id, score, place FROM pn WHERE place <= 100
"""
)
add("stream_top100", lambda s, d: Z.filter_batch(corpora.items(s, d), table(s, d, "topics")).select("model", "target_id", "day", "stream_id", "score", F.col("place").cast("long").alias("place")), _POOLED)
add(
    "stream_warm_up",
    lambda s, d: Z.filter_batch(corpora.items(s, d), table(s, d, "topics"), warm_up=1, size=10).select("model", "target_id", "day", "stream_id", "score", F.col("place").cast("long").alias("place")),
    _POOLED.replace("place <= 100", "place <= 10 AND day NOT IN (SELECT day FROM dt ORDER BY day LIMIT 1)"),
)
_DAYS = """, lb AS (SELECT target_id, term, qtf, qlen FROM q WHERE kind = 'label'), hx AS (SELECT DISTINCT target_id, stream_id, day, size FROM tm JOIN lb USING (term)),
dc AS (SELECT day, term, sum(tf)::DOUBLE AS cf FROM tm GROUP BY ALL)
"""
add(
    "day_pass",
    lambda s, d: Z.day_pass(_terms(s, d), Z.query_terms(table(s, d, "topics"))).select("target_id", "stream_id", "day", F.round("first", 6).alias("first"), F.round("score", 6).alias("score")),
    _STREAM
    + _DAYS
    + """, pd AS (SELECT a.day, sum(b.tokens)::DOUBLE AS old FROM dt a JOIN dt b ON b.day::DATE < a.day::DATE AND b.day::DATE >= a.day::DATE - 5 GROUP BY a.day),
pc AS (SELECT a.day, term, sum(cf) AS old_cf FROM dt a JOIN dc ON dc.day::DATE < a.day::DATE AND dc.day::DATE >= a.day::DATE - 5 WHERE term IN (SELECT term FROM lb) GROUP BY ALL),
r AS (SELECT hx.target_id, hx.stream_id, hx.day, sum(qtf / qlen * ln((coalesce(tf, 0) + 2500 * CASE WHEN coalesce(dc.cf, 0) > 0 THEN dc.cf / dt.tokens ELSE 0.5 / dt.tokens END) / (hx.size + 2500))) AS f,
  sum(qtf * (ln(coalesce(tf, 0) + 2500 * CASE WHEN coalesce(tf, 0) = 0 AND coalesce(old_cf, 0) = 0 THEN 1 ELSE coalesce(old_cf, 0) END / old) - ln(hx.size + 2500))) AS s
  FROM hx JOIN lb USING (target_id) JOIN dt ON dt.day = hx.day JOIN pd ON pd.day = hx.day LEFT JOIN tm ON tm.stream_id = hx.stream_id AND tm.term = lb.term LEFT JOIN dc ON dc.day = hx.day AND dc.term = lb.term LEFT JOIN pc ON pc.day = hx.day AND pc.term = lb.term GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY target_id, day ORDER BY f DESC, stream_id) AS n FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY target_id, day ORDER BY s DESC, stream_id) AS m FROM g WHERE n <= 10000)
SELECT target_id, stream_id, day, round(f, 6) AS first, round(s, 6) AS score FROM k WHERE m <= 100""",
)


def bootstrap(spark, sf):
    terms = _terms(spark, sf)
    found = Z.materialise(Z.feedback_groups(terms, Z.query_terms(table(spark, sf, "topics"))))
    return Z.group_expansions(terms, found).select("group", "target_id", "term", F.round("weight", 6).alias("weight"))


add(
    "feedback_bootstrap",
    bootstrap,
    _STREAM
    + _DAYS
    + """, gd AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) // 5 AS g FROM (SELECT DISTINCT day FROM tm)), gt AS (SELECT tm.*, g FROM tm JOIN gd USING (day)),
gs AS (SELECT g, sum(size)::DOUBLE AS total FROM (SELECT DISTINCT stream_id, g, size FROM gt) GROUP BY g), gc AS (SELECT g, term, sum(tf)::DOUBLE AS cf FROM gt GROUP BY ALL),
r AS (SELECT gd.g, hx.target_id, hx.stream_id, sum(qtf / qlen * ln((coalesce(tf, 0) + 2500 * CASE WHEN coalesce(cf, 0) > 0 THEN cf / total ELSE 0.5 / total END) / (hx.size + 2500))) AS s
  FROM hx JOIN gd USING (day) JOIN lb USING (target_id) JOIN gs ON gs.g = gd.g LEFT JOIN tm ON tm.stream_id = hx.stream_id AND tm.term = lb.term LEFT JOIN gc ON gc.g = gd.g AND gc.term = lb.term GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY g, target_id ORDER BY s DESC, stream_id) AS k FROM r), p AS (SELECT *, exp(s - max(s) OVER w) AS e FROM b WHERE k <= 5 WINDOW w AS (PARTITION BY g, target_id)),
pp AS (SELECT *, e / sum(e) OVER (PARTITION BY g, target_id) AS p FROM p), m AS (SELECT g, target_id, term, sum(p * tf / size) AS weight FROM pp JOIN tm USING (stream_id) GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY g, target_id ORDER BY round(weight, 12) DESC, term) AS n FROM m) SELECT g AS "group", target_id, term, round(weight, 6) AS weight FROM x WHERE n <= 10""",
)


def relevance(spark, sf):
    r = table(spark, sf, "stream_results").filter("model_name = 'LM' and stream_id is not null and topic_name is not null and score is not null")
    judged = r.select(F.col("topic_name").alias("target_id"), "stream_id", F.floor(F.col("score") / 10000).cast("int").alias("rating"))
    return Z.term_relevance(_terms(spark, sf), judged, Z.query_terms(table(spark, sf, "topics")), least=-3)


add(
    "term_relevance",
    relevance,
    _STREAM
    + _DAYS
    + """, jd AS (SELECT topic_name AS target_id, stream_id, (min(floor(score / 10000)) >= -3)::BIGINT AS rel FROM stream_results WHERE model_name = 'LM' AND stream_id IS NOT NULL AND topic_name IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
sz AS (SELECT target_id, sum(rel)::BIGINT AS relevant_size FROM jd GROUP BY target_id),
ht AS (SELECT jd.target_id, tm.term, count(*) AS n, sum(rel)::BIGINT AS r FROM jd JOIN tm USING (stream_id) JOIN lb ON lb.target_id = jd.target_id AND lb.term = tm.term GROUP BY ALL)
SELECT lb.target_id, lb.term, coalesce(n, 0) AS judged_df, coalesce(r, 0) AS relevant_df, relevant_size FROM lb JOIN sz USING (target_id) LEFT JOIN ht ON ht.target_id = lb.target_id AND ht.term = lb.term""",
)


def kl_distributions(spark, sf):
    terms = _terms(spark, sf)
    q = Z.query_terms(table(spark, sf, "topics"))
    p = q.filter("kind = 'label'").select("target_id", "term", (F.col("qtf") / F.col("qlen")).alias("p"))
    total = terms.agg(F.sum("tf")).first()[0] or 1
    share = terms.groupBy("term").agg((F.sum("tf") / F.lit(total)).alias("share"))
    return Z.kl_scores(terms, p, share).select("target_id", "stream_id", F.round("score", 6).alias("score"))


add(
    "kl_distributions",
    kl_distributions,
    _STREAM
    + _DAYS
    + """, sh AS (SELECT term, sum(tf)::DOUBLE / (SELECT sum(tf) FROM tm) AS share FROM tm GROUP BY term), dd2 AS (SELECT target_id, term, qtf / qlen AS p, share FROM lb JOIN sh USING (term) WHERE share > 1e-9)
SELECT hx.target_id, hx.stream_id, round(sum(p * ln((coalesce(tf, 0) + 2500 * share) / (hx.size + 2500))), 6) AS score FROM hx JOIN dd2 USING (target_id) LEFT JOIN tm ON tm.stream_id = hx.stream_id AND tm.term = dd2.term GROUP BY ALL""",
)
add(
    "sliding_history",
    lambda s, d: Z.sliding_terms(Z.day_terms(_terms(s, d), Z.query_terms(table(s, d, "topics"))), 5),
    _STREAM + "SELECT a.day, a.term, coalesce(sum(b.df), 0)::BIGINT AS df, coalesce(sum(b.cf), 0)::BIGINT AS cf FROM dd a LEFT JOIN dd b ON a.term = b.term AND b.day::DATE >= a.day::DATE - 5 AND b.day::DATE < a.day::DATE GROUP BY ALL",
)


def _judged(spark, sf):
    r = table(spark, sf, "stream_results").filter("model_name = 'LM' and stream_id is not null and topic_name is not null and score is not null")
    return r.select(F.col("topic_name").alias("target_id"), "stream_id", (F.col("score") > -30000).alias("relevant"))


add(
    "rsj_weights",
    lambda s, d: Z.rsj_weights(_terms(s, d), _judged(s, d), Z.query_terms(table(s, d, "topics"))).select("target_id", "term", F.round("weight", 6).alias("weight")),
    _STREAM
    + """, jd AS (SELECT topic_name AS target_id, stream_id, min((score > -30000)::INT) AS rel FROM stream_results WHERE model_name = 'LM' AND stream_id IS NOT NULL AND topic_name IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
sz AS (SELECT target_id, count(*) AS n_all, sum(rel) AS r_all FROM jd GROUP BY target_id), lb AS (SELECT target_id, term FROM q WHERE kind = 'label'),
ht AS (SELECT lb.target_id, lb.term, count(*) AS n, sum(rel) AS r FROM jd JOIN tm USING (stream_id) JOIN lb ON lb.target_id = jd.target_id AND lb.term = tm.term GROUP BY ALL)
SELECT lb.target_id, lb.term, round(ln((coalesce(r, 0) + 0.5) * (n_all - coalesce(n, 0) + 0.5) / ((coalesce(n, 0) - coalesce(r, 0) + 0.5) * (r_all - coalesce(r, 0) + 0.5))), 6) AS weight FROM lb JOIN sz USING (target_id) LEFT JOIN ht USING (target_id, term)""",
)
add(
    "stream_title",
    lambda s, d: Z.title_scores(table(s, d, "stream_items").filter("stream_id is not null").select("stream_id", "other_content"), table(s, d, "topics")),
    r"""WITH w AS (SELECT DISTINCT stream_id, unnest(regexp_extract_all(lower(coalesce(nullif(trim(other_content['title'].raw), ''), other_content['anchor'].raw)), '[a-z0-9]+')) AS term FROM stream_items WHERE stream_id IS NOT NULL),
l AS (SELECT target_id, lower(unnest(label_tokens)) AS term, len(label_tokens) AS n FROM topics) SELECT target_id, stream_id, least(count(*) * (1000 // n), 1000)::BIGINT AS score FROM w JOIN l USING (term) GROUP BY target_id, stream_id, n""",
)
add(
    "stream_related",
    lambda s, d: Z.related_scores(_terms(s, d), table(s, d, "topics")).select("target_id", "stream_id", F.round("score", 6).alias("score")),
    _STREAM
    + """, l AS (SELECT DISTINCT target_id, lower(unnest(label_tokens)) AS term, len(label_tokens) AS n FROM topics), rel AS (SELECT target_id, unnest(related_entities) AS r, len(related_entities) AS m FROM topics),
pt AS (SELECT rel.target_id, term, 300.0 / m / n AS v FROM rel JOIN l ON l.target_id = rel.r UNION ALL SELECT target_id, term, 700.0 / n FROM l)
SELECT target_id, stream_id, round(least(sum(v), 1000.0), 6) AS score FROM tm JOIN pt USING (term) GROUP BY ALL""",
)


def porter(spark, sf):
    from lexigrove.functions.analysis import stem_udf

    words = corpora.documents(spark, sf).tokens.select("term").distinct()
    return words.select("term", stem_udf("porter")("term").alias("stem"))


def dictionary_stems(spark, sf):
    """All terms by a dictionary of the terms of twenty documents or more."""
    from lexigrove.functions.analysis import stem_udf
    from lexigrove.operators.inspect import term_stats

    stats = Z.materialise(term_stats(corpora.documents(spark, sf)))
    headwords = frozenset(r["term"] for r in stats.filter("df >= 20").select("term").collect())  # a dictionary
    return stats.select("term", stem_udf("krovetz", headwords=headwords)("term").alias("stem"))


def html_parse(spark, sf):
    from lexigrove.collection import Collection
    from lexigrove.operators.inspect import field_stats

    rows = table(spark, sf, "parsed_documents").filter("docno is not null").groupBy("docno").agg(F.max("text").alias("text"), F.max("url").alias("url"))
    return field_stats(Collection.tagged(rows, "docno", "text", url="url"))


def em_mixture(spark, sf):
    counts = corpora.documents(spark, sf).tokens.filter("term = 'court'").groupBy("doc_id").count().groupBy(F.col("count").alias("tf")).agg(F.count("*").alias("n"))
    absent = corpora.documents(spark, sf).lengths().agg(F.count("*")).first()[0]
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    zero = spark.range(1).select(F.lit(0).cast("long").alias("tf"), F.lit(absent - seen).alias("n"))
    a, b, c = Z.mixture(counts.unionAll(zero), delta=-1, rounds=20)
    return spark.range(1).select(F.round(F.lit(a), 6).alias("share"), F.round(F.lit(b), 6).alias("topic"), F.round(F.lit(c), 6).alias("background"))


for _f in (porter, dictionary_stems, html_parse, em_mixture):
    add(_f.__name__, _f)

# Twenty rounds of expectation-maximisation over how many documents hold `court` tf times.
_EM = f"""WITH {S.TOK}, tfs AS (SELECT doc_id, count(*) FILTER (term = 'court') AS tf FROM tok GROUP BY doc_id), h AS (SELECT tf::DOUBLE AS tf, count(*)::DOUBLE AS n FROM tfs GROUP BY tf),
t AS (SELECT sum(n) AS docs, sum(tf * n) AS hits FROM h), e0 AS MATERIALIZED (SELECT 0.5::DOUBLE AS s, greatest((SELECT max(tf) FROM h), 1e-6) AS hi, greatest(hits / docs / 2, 1e-6) AS lo FROM t)"""
for _i in range(1, 21):
    _EM += f""", x{_i} AS (SELECT tf, n, 1 / (1 + exp((ln(1 - s) + tf * ln(lo) - lo) - (ln(s) + tf * ln(hi) - hi))) AS r FROM h, e{_i - 1}), y{_i} AS (SELECT sum(n * r) AS w, sum(n * r * tf) AS g FROM x{_i}),
e{_i} AS MATERIALIZED (SELECT least(greatest(w / docs, 1e-9), 1 - 1e-9) AS s, greatest(g / greatest(w, 1e-12), 1e-9) AS hi, greatest((hits - g) / greatest(docs - w, 1e-12), 1e-9) AS lo FROM y{_i}, t)"""
SQL["em_mixture"] = _EM + " SELECT round(s, 6) AS share, round(hi, 6) AS topic, round(lo, 6) AS background FROM e20"
SQL["dictionary_stems"] = f"""WITH {S.TOK}, ts AS (SELECT term AS w, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), hw AS (SELECT list(w) AS h FROM ts WHERE df >= 20),
y AS (SELECT w, CASE WHEN w LIKE '%ies' THEN [w[:-2], w[:-4] || 'y'] WHEN w LIKE '%es' THEN [w[:-2], w[:-3]] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN [w[:-2]]
  WHEN w LIKE '%ied' THEN [w[:-4] || 'y'] WHEN w LIKE '%ed' THEN [w[:-2], w[:-3], CASE WHEN w[-3] = w[-4] THEN w[:-4] ELSE w[:-3] END]
  WHEN w LIKE '%ing' THEN [w[:-4] || 'e', w[:-4], CASE WHEN len(w) > 5 AND w[-4] = w[-5] THEN w[:-5] ELSE w[:-4] END] ELSE [] END AS tries FROM ts)
SELECT w AS term, CASE WHEN len(w) < 4 OR list_contains(h, w) OR NOT regexp_full_match(w, '[a-z]+') THEN w ELSE coalesce(list_filter(tries, lambda x: list_contains(h, x))[1], w) END AS stem FROM y, hw"""


def adhoc(spark, sf):
    from lexigrove.operators.adhoc import run_topics

    topics = [{"number": "7", "query": "court jury"}, {"number": "8", "query": "meeting"}]
    return run_topics(corpora.documents(spark, sf), topics, k=40, size=60, overlap=20).select("topic", "doc_id", F.round("score", 6).alias("score"))


add("adhoc_topics", adhoc)


def _adhoc_topic(number: str, terms: list[str]) -> str:
    lm = " + ".join(f"ln((len(list_filter(ts, lambda x: x = '{t}')) + 2500 * (SELECT count(*)::DOUBLE FROM tok WHERE term = '{t}') / total) / (len(ts) + 2500))" for t in terms)
    leaves = ", ".join(S.leaf(k, S.term(t)) for k, t in enumerate(terms))
    score = "(" + " + ".join(S.dirichlet(k) for k in range(len(terms))) + f") / {len(terms)}"
    joins = " ".join(f"LEFT JOIN l{k} USING (doc_id)" for k in range(len(terms)))
    gate = " UNION ".join(f"SELECT doc_id FROM l{k}" for k in range(len(terms)))
    return f"""(WITH sc AS (SELECT doc_id, max({lm}) AS p FROM ps, c GROUP BY doc_id), {leaves}, cand AS ({gate}), r AS (SELECT doc_id, {score} AS d FROM cand JOIN len USING (doc_id) {joins}),
hom AS ({_LH}) SELECT '{number}' AS topic, doc_id, round(h * d + (1 - h) * p, 6) AS score FROM r JOIN hom USING (doc_id) JOIN sc USING (doc_id) ORDER BY round(h * d + (1 - h) * p, 9) DESC, doc_id DESC LIMIT 40)"""


SQL["adhoc_topics"] = f"{_CUT} {_adhoc_topic('7', ['court', 'jury'])} UNION ALL {_adhoc_topic('8', ['meeting'])}"
