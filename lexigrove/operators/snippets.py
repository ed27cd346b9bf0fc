"""Which extents of a query a result holds, and snippets of text around them."""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.functions.analysis import tokenize
from lexigrove.plans import ast as A
from lexigrove.plans import rewrite
from lexigrove.plans.compile import Compiler
from lexigrove.plans.parser import parse


def node_names(node: A.Node) -> list[tuple[str, A.Node]]:
    """Unscored leaves of a query with a name each, in order."""
    out: list[tuple[str, A.Node]] = []

    def walk(n: A.Node) -> None:
        if isinstance(n, A.Leaf):
            if n.extents not in [e for _, e in out]:
                out.append((f"n{len(out)}", n.extents))
            return
        for c in A.children(n):
            walk(c)

    walk(node)
    return out


def annotate(c: Collection, query: str, results: DataFrame) -> DataFrame:
    """(doc_id, node, begin, end): distinct extents of every leaf inside the results."""
    node = rewrite.prepare(parse(query), c.term)
    compiler = Compiler(c)
    parts = [compiler.extents.of(e).select("doc_id", F.lit(name).alias("node"), "begin", "end") for name, e in node_names(node)]
    r = results.select("doc_id", F.col("begin").alias("rb"), F.col("end").alias("re")).distinct()
    return reduce(DataFrame.unionAll, parts).join(r, "doc_id").filter("begin >= rb and end <= re").select("doc_id", "node", "begin", "end").distinct()


def _regions(hits: list[tuple[str, int, int]], window: int) -> list[tuple[int, int]]:
    """Greedy: the stretch with the most names not yet shown, then the longest reach, until none adds a name or `window` words are used."""
    shown: set[str] = set()
    out: list[tuple[int, int]] = []
    used = 0
    while used < window:
        best = None
        for i, (_, begin, end) in enumerate(hits):
            reach, names = end, set()
            for name, b, e in hits[i:]:
                if e - begin > window - used:
                    break
                names.add(name)
                reach = max(reach, e)
            gain = len(names - shown)
            if gain and (best is None or gain > best[0]):
                best = (gain, begin, reach, names)
        if best is None:
            break
        out.append((best[1], best[2]))
        used += best[2] - best[1]
        shown |= best[3]
    return sorted(out)


def build(text: str, hits: list[tuple[str, int, int]], window: int = 50, context: int = 15, marked: bool = True) -> str:
    """A snippet of about `window` words: the chosen stretches with `context` words around, matches marked, gaps as dots."""
    words = tokenize(text)
    if not words:
        return ""
    hits = sorted({h for h in hits if h[2] <= len(words)}, key=lambda h: (h[1], h[2]))
    regions = _regions(hits, window)
    if not regions:
        regions = [(0, min(window, len(words)))]
        context = 0
    spread = max(0, min(context, (window - sum(e - b for b, e in regions)) // (2 * len(regions)) + 1))
    merged: list[list[int]] = []
    for b, e in ((max(0, b - spread), min(len(words), e + spread)) for b, e in regions):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    inside = {p for _, b, e in hits for p in range(b, e)}
    plain = (lambda s: html.escape(s, quote=False)) if marked else str
    parts = []
    for b, e in merged:
        bits, last = [], words[b][1]
        for p in range(b, e):
            _, s, t = words[p]
            bits.append(plain(text[last:s]))
            if marked and p in inside:
                bits.append(("" if p - 1 in inside and p > b else "<strong>") + plain(text[s:t]) + ("" if p + 1 in inside and p + 1 < e else "</strong>"))
            else:
                bits.append(text[s:t].upper() if p in inside else plain(text[s:t]))
            last = t
        parts.append("".join(bits))
    lead = "..." if merged[0][0] > 0 else ""
    end = "..." if merged[-1][1] < len(words) else ""
    return lead + "...".join(parts) + end


def snippets(c: Collection, query: str, results: DataFrame, window: int = 50, context: int = 15, marked: bool = True) -> DataFrame:
    """(doc_id, snippet) of each result document; matches are those of the query's leaves."""
    found = annotate(c, query, results).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", "begin", "end"))).alias("hits"))
    rows = c.docs.join(results.select("doc_id").distinct(), "doc_id", "left_semi").join(found, "doc_id", "left").select("doc_id", "text", "hits")
    kind = dict(c.docs.dtypes)["doc_id"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [build(t or "", [(h["node"], h["begin"], h["end"]) for h in (x if x is not None else [])], window, context, marked) for t, x in zip(b["text"], b["hits"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "snippet": made})

    return rows.mapInPandas(work, f"doc_id {kind}, snippet string")
