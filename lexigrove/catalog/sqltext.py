"""Pieces of SQL that the comparisons are put together from."""

from __future__ import annotations

TOK = """tok AS (SELECT doc_id, unnest(ws) AS term, (generate_subscripts(ws, 1) - 1)::BIGINT AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL)),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
c AS (SELECT sum(length)::DOUBLE AS total, count(*)::DOUBLE AS n FROM len)"""

PAGES = r"""pt AS (SELECT docno, max(text) AS text FROM parsed_documents WHERE docno IS NOT NULL GROUP BY docno HAVING max(text) IS NOT NULL),
pz AS (SELECT docno, regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9]*)[^<>]*>([^<]*)', 1) AS ns, regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9]*)[^<>]*>([^<]*)', 2) AS xs FROM pt),
pp AS (SELECT docno, unnest(ns) AS nm, unnest(xs) AS x, generate_subscripts(ns, 1) AS k FROM pz),
pk AS (SELECT docno, lower(nm) AS field, k, regexp_extract_all(lower(x), '[a-z0-9]+') AS ws FROM pp),
fields AS (SELECT docno, field, k, ws, coalesce(sum(len(ws)) OVER (PARTITION BY docno ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, len(ws) AS n FROM pk),
tok AS (SELECT docno AS doc_id, unnest(ws) AS term, b + generate_subscripts(ws, 1) - 1 AS pos FROM fields),
ext AS (SELECT docno AS doc_id, field, b AS "begin", b + n AS "end" FROM fields),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
c AS (SELECT sum(length)::DOUBLE AS total, count(*)::DOUBLE AS n FROM len)"""


def term(t: str) -> str:
    return f"SELECT doc_id, pos AS b, pos + 1 AS e, 1.0 AS w FROM tok WHERE term = '{t}'"


def syn(*ts: str) -> str:
    return f"SELECT doc_id, pos AS b, pos + 1 AS e, 1.0 AS w FROM tok WHERE term IN ({', '.join(repr(t) for t in ts)})"


def phrase(*ts: str) -> str:
    nexts = ", ".join(f"lead(term, {k}) OVER w AS t{k}" for k in range(1, len(ts)))
    found = " AND ".join(f"t{k} = '{t}'" for k, t in enumerate(ts) if k)
    return f"SELECT doc_id, pos AS b, pos + {len(ts)} AS e, 1.0 AS w FROM (SELECT doc_id, pos, term AS t0, {nexts} FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE t0 = '{ts[0]}' AND {found}"


def ordered(a: str, b: str, width: int | None) -> str:
    gap = f"AND nb - pos <= {width}" if width else ""
    return f"""SELECT doc_id, pos AS b, nb + 1 AS e, 1.0 AS w FROM (SELECT doc_id, pos, term, min(CASE WHEN term = '{b}' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb
  FROM tok WHERE term IN ('{a}', '{b}')) WHERE term = '{a}' AND nb IS NOT NULL {gap}"""


def unordered(width: int | None, *ts: str) -> str:
    nexts = ", ".join(f"min(CASE WHEN term = '{t}' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n{k}" for k, t in enumerate(ts))
    all_there = " AND ".join(f"n{k} IS NOT NULL" for k in range(len(ts)))
    end = f"greatest({', '.join(f'n{k}' for k in range(len(ts)))}) + 1"
    return f"SELECT doc_id, pos AS b, {end} AS e, 1.0 AS w FROM (SELECT doc_id, pos, {nexts} FROM tok WHERE term IN ({', '.join(repr(t) for t in ts)})) WHERE {all_there}" + (f" AND {end} - pos <= {width}" if width else "")


def leaf(k: int, extents: str) -> str:
    """CTEs l{k}(doc_id, tf), overlapping extents counted once, and s{k}(occ, df)."""
    return f"""x{k} AS ({extents}),
l{k} AS (SELECT doc_id, list_reduce(list_prepend({{'b': -1::BIGINT, 'to': -1::BIGINT, 's': 0.0::DOUBLE, 'w': 0.0::DOUBLE}}, list(struct_pack(b := b::BIGINT, "to" := e::BIGINT, s := 0.0::DOUBLE, w := w::DOUBLE) ORDER BY b, e)),
  lambda p, q: CASE WHEN q.b < p."to" THEN p ELSE struct_pack(b := q.b, "to" := q."to", s := p.s + q.w, w := q.w) END).s AS tf FROM x{k} GROUP BY doc_id),
s{k} AS (SELECT coalesce(sum(tf), 0)::DOUBLE AS occ, count(*)::DOUBLE AS df FROM l{k})"""


def share(k: int) -> str:
    return f"(SELECT CASE WHEN occ = 0 THEN 1 / (2 * total) ELSE occ / total END FROM s{k}, c)"


def dirichlet(k: int, mu: float = 2500) -> str:
    return f"ln((coalesce(l{k}.tf, 0) + {mu} * {share(k)}) / (length + {mu}))"


def query(extents: list[str], score: str, gate: list[int] | None = None, where: str = "", base: str = TOK, extra: str = "") -> str:
    """(doc_id, score) of the documents that any gating leaf occurs in."""
    ks = range(len(extents))
    union = " UNION ".join(f"SELECT doc_id FROM l{k}" for k in (gate if gate is not None else ks))
    joins = " ".join(f"LEFT JOIN l{k} USING (doc_id)" for k in ks)
    return f"WITH {base}, {', '.join(leaf(k, x) for k, x in enumerate(extents))}{extra}, cand AS ({union}) SELECT doc_id, round({score}, 6) AS score FROM cand JOIN len USING (doc_id) {joins} {where}"
