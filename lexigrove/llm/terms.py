"""Counts of every term and n-gram, and how distinctive a term is of its record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.bits import bit_filter, in_filter
from lexigrove.session import materialise, skew_safe_lookup

#: Tokens of one suffix array; a partition of any size is worked off in blocks of so many.
BLOCK_TOKENS = 1_000_000


def normal(term: Column) -> Column:
    """A term lower-cased, without full stops and apostrophes, trimmed."""
    return F.regexp_replace(F.lower(F.regexp_replace(term, "[.']", "")), r"^\s+|\s+$", "")


def query_records(queries: DataFrame) -> DataFrame:
    """(rec, ordered, terms array<struct<term, n>>): a record for each query_id with any term.

    Tokens count, in order, once each; where tokens is NULL, the entries of term_freq do (those with a NULL or
    no positive count don't). Of rows of one query_id, one with tokens goes before one without, then the
    greater list. NULL ids, NULL and empty terms are left out. Columns besides these three are ignored.
    """
    one = F.transform(F.filter(F.transform("tokens", normal), lambda t: t.isNotNull() & (t != "")), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n")))
    entries = F.transform(F.map_entries("term_freq"), lambda e: F.struct(normal(e["key"]).alias("term"), e["value"].cast("long").alias("n")))
    entries = F.array_sort(F.filter(entries, lambda e: (e["term"] != "") & (e["n"] > 0)))
    rows = queries.filter("query_id is not null").select(F.col("query_id").alias("rec"), F.struct(F.col("tokens").isNotNull().alias("ordered"), F.coalesce(F.when(F.col("tokens").isNotNull(), one), entries).alias("terms")).alias("x"))
    return rows.groupBy("rec").agg(F.max("x").alias("x")).select("rec", "x.ordered", "x.terms").filter(F.size("terms") > 0)


def suffix_counts(code: np.ndarray, rec: np.ndarray, weight: np.ndarray, left: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: (n, where an n-gram begins, its occurrences, its records), each distinct n-gram once.

    code holds the positions' tokens, left the tokens up to the end of the sequence. The suffixes are sorted by their first
    max_n tokens (prefix doubling); an n-gram is an interval of the array in which neighbours have a common
    prefix of n or more. Its records are its suffixes less those that follow one of the same record within the interval.
    """
    size = len(code)
    rank, h = code.astype(np.int64), 1
    while h < max_n:
        ahead = np.zeros(size, np.int64)
        ok = np.flatnonzero(left > h)
        ahead[ok] = rank[ok + h] + 1
        key = rank * (int(ahead.max(initial=0)) + 1) + ahead
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        h *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(size, np.int64)  # with the suffix before it, up to max_n
    alive = np.ones(size, bool)
    alive[:1] = False
    a, b = order, np.roll(order, 1)
    for n in range(1, max_n + 1):
        alive &= (left[a] >= n) & (left[b] >= n)
        at = np.flatnonzero(alive)
        alive[at] = code[a[at] + n - 1] == code[b[at] + n - 1]
        common += alive
        inside = np.flatnonzero(left[order] >= n)
        if not len(inside):
            return
        interval = np.cumsum(common < n)[inside]
        starts = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        pos = order[inside]
        again = np.lexsort((rec[pos], interval))
        same = (interval[again][1:] == interval[again][:-1]) & (rec[pos][again][1:] == rec[pos][again][:-1])
        dup = np.add.reduceat(np.r_[False, same].astype(np.int64), starts)
        lengths = np.diff(np.r_[starts, len(inside)])
        yield n, pos[starts], np.add.reduceat(weight[pos], starts), lengths - dup


def _living(rows: list[tuple], n: int, filter_: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The rows with a run of n tokens that is in the filter, and which positions of theirs such runs begin at."""
    sizes = [len(terms[0]) - n + 1 if ordered else 0 for _, ordered, terms in rows]
    h = np.array([xxhash.xxh64_intdigest(" ".join(terms[0][i : i + n]).encode("utf-8", "surrogatepass"), 42) for (_, _, terms), size in zip(rows, sizes) for i in range(size)], np.uint64)
    hit = in_filter(filter_, h)
    kept, alive, at = [], [], 0
    for row, size in zip(rows, sizes):
        if size > 0:
            mine = hit[at : at + size]
            at += size
            if mine.any():
                kept.append(row)
                alive.append(np.r_[mine, np.zeros(len(row[2][0]) - size, bool)])
    return kept, np.concatenate(alive) if alive else np.zeros(0, bool)


def _count_block(rows: list[tuple], max_n: int | None, above: int = 0, filter_: np.ndarray | None = None) -> pd.DataFrame:
    """Counts of a block's n-grams of more than `above` tokens; with a filter, of those whose first `above` tokens are in it."""
    alive = None
    if filter_ is not None:
        rows, alive = _living(rows, above, filter_)
        if not rows:
            return pd.DataFrame({"n": pd.Series(dtype="int32"), "term": pd.Series(dtype=object), "occurrences": pd.Series(dtype="int64"), "records": pd.Series(dtype="int64")})
    max_n = max_n or max((len(terms[0]) for _, ordered, terms in rows if ordered), default=1) or 1
    words = [t for _, _, terms in rows for t in terms[0]]
    code, names = pd.factorize(np.array(words, dtype=object))
    weight = np.array([n for _, _, terms in rows for n in terms[1]], np.int64)
    rec = np.repeat(np.arange(len(rows)), [len(terms[0]) for _, _, terms in rows])
    left = np.concatenate([np.arange(len(t[0]), 0, -1) if o else np.ones(len(t[0]), np.int64) for _, o, t in rows])
    parts = [pd.DataFrame({"n": [0], "term": [""], "occurrences": [len(rows)], "records": [len(rows)]})] if not above else []
    for n, start, occ, recs in suffix_counts(code, rec, weight, left, max_n):
        if n <= above:
            continue
        if alive is not None:
            start, occ, recs = start[alive[start]], occ[alive[start]], recs[alive[start]]
        text = names[code[start]] if n == 1 else [" ".join(names[code[s : s + n]]) for s in start]
        parts.append(pd.DataFrame({"n": n, "term": text, "occurrences": occ, "records": recs}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n": [], "term": [], "occurrences": [], "records": []})


def ngram_counts(records: DataFrame, max_n: int | None = 3, above: int = 0, filter_=None) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of 1..max_n tokens (None: of any length), and at n = 0 the number of records.

    records are as from query_records. A record lies wholly in one block; each block is counted by a suffix
    array, which emits every n-gram of the block once, and blocks add up in one aggregation by n-gram: a term
    of any frequency arrives as one row a block. Unordered records have no n-grams beyond n = 1. With `above`, only longer
    n-grams, and with filter_ (a broadcast bit filter) only those that begin with a run of `above` tokens in it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for rec, ordered, names, ns in pdf.itertuples(index=False, name=None):
                rows.append((rec, ordered, (names, ns)))
                size += len(names)
                if size >= BLOCK_TOKENS:
                    yield _count_block(rows, max_n, above, filter_.value if filter_ else None)
                    rows, size = [], 0
        if rows:
            yield _count_block(rows, max_n, above, filter_.value if filter_ else None)

    flat = records.select("rec", "ordered", F.col("terms.term").alias("names"), F.col("terms.n").alias("ns"))
    blocks = flat.mapInPandas(count, "n int, term string, occurrences long, records long")
    return blocks.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def repeated_ngrams(records: DataFrame, step: int = 4, bits: int = 1 << 28) -> DataFrame:
    """(n, term, occurrences, records), as from ngram_counts, of all n-grams of up to `step` tokens and of all longer ones that occur more than once, however long.

    An n-gram can only repeat if its beginning does. Each round counts lengths up to twice those of the last one, starting only where the last
    round's longest n-grams were repeated - a set of bits of one size tells the tasks where - and rounds end when none is. So a long record costs
    what it shares with others, not the square of its length.
    """
    spark = records.sparkSession
    counts = materialise(ngram_counts(records, step))
    out, n = counts, step
    while True:
        longest = counts.filter((F.col("n") == n) & (F.col("occurrences") > 1)).select(F.xxhash64("term").alias("h"))
        size = longest.count()
        if not size:
            return out.filter(F.col("n").between(1, step) | (F.col("occurrences") > 1)).filter("n > 0")
        filter_ = spark.sparkContext.broadcast(bit_filter(longest, min(bits, 1 << max(16, (32 * size).bit_length()))))
        counts = materialise(ngram_counts(records, 2 * n, n, filter_))
        out, n = out.unionByName(counts), 2 * n


def term_marks(records: DataFrame, max_n: int | None = 1, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(n, term, occurrences, records, mark): mark `rare` in at most `rare` records, `common` in more than that share of them, else NULL."""
    counts = materialise(ngram_counts(records, max_n))
    total = counts.filter("n = 0").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * total, "common")
    return counts.filter("n > 0").withColumn("mark", mark)


def field_counts(statistics: DataFrame, whole: str = "document", rare: float = 0.002, common: float = 0.95) -> DataFrame:
    """(term, occurrences, records, mark) of every field: sums over segments of the latest flush that has a document_count.

    Names are trimmed and lower-cased; NULL names don't count. A flush without a time goes before all others, of
    equal times the greater count holds. Marks are by the share of the field `whole`; without it none is marked.
    """
    name = F.lower(F.regexp_replace("field_name", r"^\s+|\s+$", ""))
    rows = statistics.filter("document_count is not null and field_name is not null").select("segment_id", name.alias("term"), F.struct("flushed_at", "document_count", "total_count").alias("x"))
    last = rows.groupBy("segment_id", "term").agg(F.max("x").alias("x"))
    sums = materialise(last.groupBy("term").agg(F.sum("x.total_count").alias("occurrences"), F.sum("x.document_count").alias("records")))
    top = sums.filter(F.col("term") == whole).agg(F.sum("records")).first()[0]
    share = F.col("records") / F.lit(top or None).cast("double")
    return sums.withColumn("mark", F.when(F.col("term") == whole, None).when(share < rare, "rare").when(share > common, "common"))


def term_weights(records: DataFrame) -> DataFrame:
    """(rec, term, n, records, total, log_entropy, tf_idf) for each term of each record; total is the number of records.

    log_entropy is ln(1 + n) x (1 - H / ln total), H the entropy of the term's spread over records; a term spread
    evenly over all records weighs 0, one of a single record the most. tf_idf is n x ln(total / records).
    With fewer than two records the entropy part is 1. Two aggregations, by record and term and by term.
    """
    rows = records.select("rec", F.explode("terms").alias("t")).groupBy("rec", F.col("t.term").alias("term")).agg(F.sum("t.n").alias("n"))
    rows = materialise(rows)
    stats = materialise(rows.groupBy("term").agg(F.count("*").alias("records"), F.sum("n").alias("f"), F.sum(F.col("n") * F.log("n")).alias("fl")))
    pairs = stats.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    total = rows.agg(F.countDistinct("rec")).first()[0]
    entropy = F.log("f") - F.col("fl") / F.col("f")
    spread = F.lit(1.0) - entropy / F.lit(float(np.log(total)) if total > 1 else 1.0) if total > 1 else F.lit(1.0)
    stats = stats.select("term", "records", spread.alias("g"), F.log(F.lit(float(total)) / F.col("records")).alias("idf"))
    out = skew_safe_lookup(rows, stats, "term", "records", pairs)
    return out.select("rec", "term", "n", "records", F.lit(total).cast("long").alias("total"), (F.log1p("n") * F.col("g")).alias("log_entropy"), (F.col("n") * F.col("idf")).alias("tf_idf"))


def most_distinctive(weights: DataFrame, least_terms: int = 3, least_records: int = 2, by: str = "log_entropy") -> DataFrame:
    """(rec, term): of each record with enough terms the one of greatest weight, among terms in enough records but not in all; of equals the first in byte order."""
    fits = (F.col("records") >= least_records) & (F.col("records") < F.col("total"))
    best = weights.groupBy("rec").agg(F.count("*").alias("k"), F.min(F.when(fits, F.struct((-F.col(by)).alias("w"), "term"))).alias("b"))
    return best.filter((F.col("k") >= least_terms) & F.col("b").isNotNull()).select("rec", F.col("b.term").alias("term"))


def distinctive_by_count(weights: DataFrame, least_terms: int = 3, least_records: int = 2) -> DataFrame:
    """(rec, term) as most_distinctive gives it, but by n x ln(total / records): chosen by log-entropy, then checked exactly.

    The term of greatest log-entropy leads its record. A term's entropy is ln(records) at most, so that n x g x ln(total), with g its
    global entropy weight, is never below its n x ln(total / records): terms that don't reach the leader's value
    by this bound are out, and the exact value decides among the few that are left.
    """
    fits = weights.filter((F.col("records") >= least_records) & (F.col("records") < F.col("total")))
    enough = weights.groupBy("rec").agg(F.count("*").alias("k"), F.min(F.when((F.col("records") >= least_records) & (F.col("records") < F.col("total")), F.struct((-F.col("log_entropy")).alias("w"), "term", "tf_idf"))).alias("lead"))
    enough = enough.filter((F.col("k") >= least_terms) & F.col("lead").isNotNull()).select("rec", F.col("lead.tf_idf").alias("least"))
    bound = F.col("log_entropy") * F.col("n") / F.log1p("n") * F.log("total")
    near = fits.join(enough, "rec").filter(bound * (1 + 1e-9) + 1e-12 >= F.col("least"))
    return near.groupBy("rec").agg(F.min(F.struct((-F.col("tf_idf")).alias("w"), "term")).alias("b")).select("rec", F.col("b.term").alias("term"))
