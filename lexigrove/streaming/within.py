"""Scores of stream items, an item at a time: its own terms and the profiles give every pair's score where the item is, so that no pair is shuffled."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import simple_tokens

#: Profiles and day statistics of more rows, or of more days x terms, don't go to the tasks.
MOST_ROWS, MOST_CELLS = 1 << 20, 1 << 22

#: Items that are taken at a time, and rows of profiles that they meet.
CHUNK_ITEMS, CHUNK_ROWS = 500, 1 << 19

#: Rows that a task holds back while it tells which can be among the best.
HELD_ROWS = 1 << 19


def item_rows(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(stream_id, day, size, terms, tfs), a row an item of a day: how many tokens of more than two characters it has, and which of these are the profiles', how often each."""
    tracked = queries.select("term").distinct()
    few = tracked.count() <= MOST_ROWS
    sent = items.sparkSession.sparkContext.broadcast(pa.array([r[0] for r in tracked.collect()], pa.string()) if few else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                words, item = b.column(2).flatten(), _rows_of(b.column(2))
                long = pc.greater(pc.binary_length(words), 2).to_numpy(zero_copy_only=False)
                known = sent.value if few else words.unique()
                code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
                fits = long & (code >= 0)
                keys, tf = np.unique(item[fits] * max(len(known), 1) + code[fits], return_counts=True)
                of, code = np.divmod(keys, max(len(known), 1))
                at_item = pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32())
                size = np.bincount(item[long], minlength=b.num_rows)
                columns = [pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(at_item, known.take(pa.array(code))), pa.ListArray.from_arrays(at_item, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], ["stream_id", "day", "size", "terms", "tfs"])

    kinds = dict(items.dtypes)
    rows = items.filter("text is not null and stream_id is not null").groupBy("stream_id", "day").agg(F.max("text").alias("text")).select("stream_id", "day", simple_tokens(F.col("text")).alias("ws"))
    return rows.mapInArrow(work, f"stream_id {kinds['stream_id']}, day {kinds['day']}, size int, terms array<string>, tfs array<int>")


def flat(rows: DataFrame) -> DataFrame:
    """item_rows as (stream_id, day, size, term, tf)."""
    return rows.select("stream_id", "day", "size", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("stream_id", "day", "size", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))


def row_totals(rows: DataFrame) -> DataFrame:
    """day_totals of item_rows."""
    return rows.filter("size > 0").groupBy("day").agg(F.count("*").alias("docs"), F.sum("size").alias("tokens"))


def by_day(rows: DataFrame) -> DataFrame:
    """item_rows with the items of a day in few tasks, which then tell the best of the day among themselves."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day", "stream_id")


def _rows_of(column: pa.Array) -> np.ndarray:
    """The row of every value of a column of lists."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place of the ranges that begin there and have these sizes."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size)


class Profiles(NamedTuple):
    """Profiles by number of entity and term, and what days know of terms."""

    targets: pa.Array
    terms: pa.Array
    days: dict
    label_begin: np.ndarray  # by term: entities that have it in their label
    label_of: np.ndarray
    begin: np.ndarray  # by entity: its rows
    term: np.ndarray
    label: np.ndarray
    for_kl: np.ndarray
    qtf: np.ndarray
    qlen: np.ndarray
    mean: np.ndarray  # by day
    idf: np.ndarray  # by day x terms + term
    share: np.ndarray


def profiles(queries: DataFrame, totals: DataFrame, statistics: DataFrame, models: Sequence[str], mu: float) -> Profiles | None:
    """None if they are too many for the tasks."""
    known = totals.filter("docs > 0 and day is not null")
    if any(x.count() > MOST_ROWS for x in (queries, known, statistics)):
        return None
    q = queries.filter("target_id is not null").toPandas()
    t, targets = pd.factorize(q["target_id"])
    w, terms = pd.factorize(q["term"])
    rows = sorted(known.collect(), key=lambda r: r["day"])
    days, n = [r["day"] for r in rows], len(terms)
    if len(days) * max(n, len(targets)) > MOST_CELLS:
        return None
    label = (q["kind"] == "label").to_numpy(bool)
    has = np.zeros(len(targets), bool)
    has[t[~label]] = True
    for_kl = np.where(has[t], ~label, label)
    used = (label & bool({"bm25", "lm"} & set(models))) | (~label & bool({"bm25_ext", "lm_ext"} & set(models))) | (for_kl & ("kl" in models))
    by_target, by_term = np.flatnonzero(used), np.flatnonzero(label)
    by_target, by_term = by_target[np.argsort(t[by_target], kind="stable")], by_term[np.argsort(w[by_term], kind="stable")]

    s = statistics.toPandas()
    at = pd.Index(terms).get_indexer(s["term"]) if n else np.full(len(s), -1)
    after, upto = s["after"].to_numpy(object), s["upto"].to_numpy(object)
    place = {d: bisect_right(days, d) for d in {*after, *upto} if not pd.isna(d)}  # of the first day after it
    first, end = np.array([place.get(d, len(days)) for d in after], int), np.array([place.get(d, len(days)) for d in upto], int)
    of, day = _spread(first, np.where(at >= 0, np.maximum(end - first, 0), 0))
    df, cf = np.zeros(len(days) * n, np.int64), np.zeros(len(days) * n, np.int64)
    df[day * n + at[of]], cf[day * n + at[of]] = s["df"].to_numpy(np.int64)[of], s["cf"].to_numpy(np.int64)[of]
    docs, tokens = (np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in ("docs", "tokens"))
    return Profiles(
        pa.array(targets, pa.string()), pa.array(terms, pa.string()), {d: k for k, d in enumerate(days)},
        np.searchsorted(w[by_term], np.arange(n + 1)), t[by_term],
        np.searchsorted(t[by_target], np.arange(len(targets) + 1)), w[by_target], label[by_target], for_kl[by_target],
        q["qtf"].to_numpy(np.int64)[by_target], q["qlen"].to_numpy(np.int64)[by_target],
        np.array([r["mean"] for r in rows], float), np.log((docs - df + 0.5) / (df + 0.5)), mu * cf / tokens,
    )


class _Best:
    """What of a task's rows can be among the `size` best of its group: a score that lies more than a whole step below the size-th best one can't."""

    STEP = 1.01e-3

    def __init__(self, size: int, groups: int) -> None:
        self.size, self.least, self.parts, self.held = size, np.full(groups, -np.inf), [], 0

    def add(self, group: np.ndarray, score: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fits = np.flatnonzero(score >= self.least[group])
        self.parts.append((group[fits], score[fits], rows.take(pa.array(fits))))
        self.held += len(fits)
        if self.held > HELD_ROWS:
            self._cut()
            if self.held > HELD_ROWS // 2:
                yield from self.rest()

    def _cut(self) -> None:
        group, score = (np.concatenate([x[k] for x in self.parts]) for k in (0, 1))
        order = np.lexsort((-score, group))
        g = group[order]
        last = np.flatnonzero(np.arange(len(g)) - np.searchsorted(g, g) == self.size - 1)
        self.least[g[last]] = np.maximum(self.least[g[last]], score[order[last]] - self.STEP)
        fits = np.flatnonzero(score >= self.least[group])
        rows = pa.Table.from_batches([x[2] for x in self.parts]).take(pa.array(fits)).combine_chunks()
        self.parts, self.held = [(group[fits], score[fits], x) for x in rows.to_batches()], len(fits)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
        for _, _, rows in self.parts:
            yield rows
        self.parts, self.held = [], 0


def row_scores(rows: DataFrame, held: Profiles, models: Sequence[str], mu: float, k1: float, b: float, size: int | None = None) -> DataFrame:
    """(model, target_id, stream_id, day, score) of item_rows; with size, each task leaves out what can't be among the `size` best of a model, entity and day."""
    sent, names = rows.sparkSession.sparkContext.broadcast(held), ["model", "target_id", "stream_id", "day", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        n, m, days = len(p.terms), len(p.targets), len(p.days)
        best = _Best(size, len(models) * m * days) if size else None
        step = max(1, min(CHUNK_ITEMS, MOST_CELLS // max(n, 1)))
        meets = np.diff(p.label_begin)
        for batch in batches:
            day_of = np.array([p.days.get(d, -1) for d in batch.column(1).to_pylist()], np.int64)
            sizes, item = batch.column(2).to_numpy(), _rows_of(batch.column(3))
            term, tf = pc.fill_null(pc.index_in(batch.column(3).flatten(), value_set=p.terms), -1).to_numpy(), batch.column(4).flatten().to_numpy()
            fits = (term >= 0) & (day_of[item] >= 0)
            item, term, tf = item[fits], term[fits].astype(np.int64), tf[fits]
            hits = np.cumsum(np.bincount(item, meets[term], batch.num_rows))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, min(start + step, int(np.searchsorted(hits, (hits[start - 1] if start else 0) + CHUNK_ROWS, "right"))))
                x, y = np.searchsorted(item, (start, end))
                here, what = item[x:y] - start, term[x:y]
                dense = np.zeros((end - start) * n, np.int32)
                dense[here * n + what] = tf[x:y]
                of, place = _spread(p.label_begin[what], meets[what])
                pairs = np.unique(here[of] * m + p.label_of[place])
                i, t = np.divmod(pairs, max(m, 1))
                upto = np.cumsum(p.begin[t + 1] - p.begin[t])
                at = 0
                while at < len(pairs):
                    to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_ROWS, "right")))
                    yield from _scores(p, i[at:to], t[at:to], start, day_of, sizes, dense, batch, best)
                    at = to
                start = end
        if best:
            yield from best.rest()

    def _scores(p: Profiles, i: np.ndarray, t: np.ndarray, start: int, day_of: np.ndarray, sizes: np.ndarray, dense: np.ndarray, batch: pa.RecordBatch, best: _Best | None) -> Iterator[pa.RecordBatch]:
        n, day, length = len(p.terms), day_of[start + i], sizes[start + i].astype(float)
        of, row = _spread(p.begin[t], p.begin[t + 1] - p.begin[t])
        tf, cell = dense[i[of] * n + p.term[row]], day[of] * n + p.term[row]
        label, sums = p.label[row], {}
        if {"bm25", "bm25_ext"} & set(models):
            some = np.flatnonzero(tf)
            f, pair = tf[some], of[some]
            bm = p.idf[cell[some]] * f / (f + k1 * (1 - b) + (k1 * b * length / p.mean[day])[pair])
            for model, when in (("bm25", label[some]), ("bm25_ext", ~label[some])):
                if model in models:
                    sums[model] = np.bincount(pair[when], bm[when], len(t))
        if {"lm", "lm_ext", "kl"} & set(models):
            value = tf + p.share[cell]
            lm = np.log(value, out=np.zeros(len(value)), where=value > 1e-4) - np.log(length + mu)[of]
            for model, when in (("lm", label), ("lm_ext", ~label), ("kl", p.for_kl[row])):
                if model in models:
                    v = lm[when] * p.qtf[row[when]] / p.qlen[row[when]] if model == "kl" else lm[when]
                    sums[model] = np.bincount(of[when], v, len(t))
        taken = [p.targets.take(pa.array(t)), *(c.take(pa.array(start + i)) for c in batch.columns[:2])]
        for k, model in enumerate(models):
            out = pa.RecordBatch.from_arrays([pa.repeat(model, len(t)), *taken, pa.array(sums[model], pa.float64())], names)
            if best:
                yield from best.add((k * len(p.targets) + t) * len(p.days) + day, sums[model], out)
            else:
                yield out

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, f"model string, target_id string, stream_id {kinds['stream_id']}, day {kinds['day']}, score double")
