import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove import session
from lexigrove.llm import terms as T

SCHEMA = "query_id long, tokens array<string>, term_freq map<string,int>, rec string, terms string"
ROWS = [
    (1, ["The", "red", "red.", "", None, " fox'"], {"zzz": 9}, "", ""),
    (1, ["The", "red", "red.", "", None, " fox'"], {"zzz": 9}, "", ""),
    (2, None, {"Red": 2, "red.": 1, "": 4, "hen": 0, "cow": None}, "", ""),
    (3, [], {"red": 1}, "", ""),
    (4, None, None, "", ""),
    (None, ["red"], None, "", ""),
    (5, ["the", "red", "hen"], None, "", ""),
    (6, None, {"x": 1}, "", ""),
    (6, ["the", "fox"], None, "", ""),
]


def test_records(spark):
    rows = {r.rec: [(t.term, t.n) for t in r.terms] for r in T.query_records(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert rows == {1: [("the", 1), ("red", 1), ("red", 1), ("fox", 1)], 2: [("red", 1), ("red", 2)], 5: [("the", 1), ("red", 1), ("hen", 1)], 6: [("the", 1), ("fox", 1)]}


def test_marks_and_counts(spark):
    rec = T.query_records(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r.n, r.term): (r.occurrences, r.records) for r in T.ngram_counts(rec, 3).collect()}
    assert got[(0, "")] == (4, 4)
    assert got[(1, "red")] == (6, 3) and got[(1, "the")] == (3, 3) and got[(2, "the red")] == (2, 2) and got[(3, "the red red")] == (1, 1)
    assert (2, "red red") in got and got[(2, "red red")] == (1, 1)
    marks = {r.term: r.mark for r in T.term_marks(rec, 1, rare=1, common=0.5).collect()}
    assert marks == {"red": "common", "the": "common", "fox": None, "hen": "rare"}
    empty = spark.createDataFrame([], SCHEMA)
    assert T.term_marks(T.query_records(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 6))
def test_suffix_array_against_brute_force(records, max_n):
    code = np.array([ord(t) for r in records for t in r])
    rec = np.repeat(np.arange(len(records)), [len(r) for r in records])
    left = np.concatenate([np.arange(len(r), 0, -1) for r in records])
    got = {}
    for n, start, occ, recs in T.suffix_counts(code, rec, np.ones(len(code), np.int64), left, max_n):
        for s, o, r in zip(start, occ, recs):
            key = "".join(map(chr, code[s : s + n]))
            assert key not in got
            got[key] = (o, r)
    occ, where = Counter(), defaultdict(set)
    for k, r in enumerate(records):
        for n in range(1, max_n + 1):
            for i in range(len(r) - n + 1):
                g = "".join(r[i : i + n])
                occ[g] += 1
                where[g].add(k)
    assert got == {g: (c, len(where[g])) for g, c in occ.items()}


def test_blocks_add_up(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(1, 9))], None, "", "") for i in range(200)]
    rec = T.query_records(spark.createDataFrame(rows, SCHEMA))
    whole = {tuple(r) for r in T.ngram_counts(rec, 3).collect()}
    assert {tuple(r) for r in T.ngram_counts(rec.repartition(7), 3).collect()} == whole


def test_very_long_terms(spark):
    rows = [(1, ["x" * 2_000_000, "a"], None, "", ""), (2, ["a"] * 100_000, None, "", "")]
    got = {r.term[:3]: (r.occurrences, r.records) for r in T.ngram_counts(T.query_records(spark.createDataFrame(rows, SCHEMA)), 1).collect()}
    assert got == {"": (2, 2), "xxx": (1, 1), "a": (100_001, 2)}


def test_fields(spark):
    import datetime

    t = lambda h: datetime.datetime(2011, 10, 1, h)
    rows = [(1, "Document ", 9, 90, t(1)), (1, "document", 9, 100, t(2)), (1, "document", 9, None, t(3)), (2, "document", 1, 900, None), (1, "a", 1, 1, t(1)), (1, "b", 1, 990, t(1)), (1, None, 1, 5, t(1)), (1, "c", 1, 50, t(1)), (1, "c", 1, 60, t(1))]
    df = spark.createDataFrame(rows, "segment_id long, field_name string, total_count long, document_count long, flushed_at timestamp")
    got = {r.term: (r.records, r.mark) for r in T.field_counts(df).collect()}
    assert got == {"document": (1000, None), "a": (1, "rare"), "b": (990, "common"), "c": (60, None)}
    assert T.field_counts(df.limit(0)).count() == 0
    assert {r.mark for r in T.field_counts(df.filter("field_name = 'a'")).collect()} == {None}


def test_weights_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, ["hot"] + [rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))], None, "", "") for i in range(60)]
    w = T.term_weights(T.query_records(spark.createDataFrame(rows, SCHEMA)))
    tf = {i: Counter(t) for i, t, *_ in rows}
    df = Counter(x for c in tf.values() for x in c)
    total = sum(tf.values(), Counter())
    for r in w.collect():
        h = -sum(c[r.term] / total[r.term] * math.log(c[r.term] / total[r.term]) for c in tf.values() if r.term in c)
        assert r.log_entropy == pytest.approx(math.log(1 + tf[r.rec][r.term]) * (1 - h / math.log(60)))
        assert r.tf_idf == pytest.approx(tf[r.rec][r.term] * math.log(60 / df[r.term])) and r.records == df[r.term]
    got = {r.rec: r.term for r in T.distinctive_by_count(w).collect()}
    by_entropy = {r.rec: r.term for r in T.most_distinctive(w).collect()}
    entropy = {(r.rec, r.term): r.log_entropy for r in w.collect()}
    assert all(entropy[i, t] == pytest.approx(max(entropy[i, x] for x in tf[i] if 2 <= df[x] < 60)) for i, t in by_entropy.items()) and set(by_entropy) == set(got)
    want = {}
    for i, c in tf.items():
        fit = [x for x in c if 2 <= df[x] < 60]
        if len(c) >= 3 and fit:
            want[i] = min(fit, key=lambda x: (-c[x] * math.log(60 / df[x]), x))
    assert got == want
    assert T.term_weights(T.query_records(spark.createDataFrame([], SCHEMA))).count() == 0


def test_lookup_of_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(20)], "k string, i int")
    table = rows.groupBy("k").count().withColumnRenamed("count", "w")
    assert T.skew_safe_lookup(rows, table, "k", "w", 70).count() == 70


def test_ngrams_of_any_length(spark):
    rows = [("a", True, [(t, 1) for t in "v w x y z v w".split()]), ("b", True, [(t, 1) for t in "w x y z".split()]), ("c", False, [(t, 2) for t in "v w x y z q r s".split()])]
    df = spark.createDataFrame(rows, "rec string, ordered boolean, terms array<struct<term: string, n: long>>")
    got = {(r.n, r.term): (r.occurrences, r.records) for r in T.ngram_counts(df, None).filter("n > 1").collect()}
    want = {}
    for rec, text in (("a", "v w x y z v w".split()), ("b", "w x y z".split())):
        for n in range(2, len(text) + 1):
            for i in range(len(text) - n + 1):
                want.setdefault((n, " ".join(text[i : i + n])), []).append(rec)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_repeated_ngrams_of_any_length(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(40):
        w = [f"w{rng.integers(0, 30)}" for _ in range(rng.integers(0, 30))]
        if k % 4 == 0:
            a = int(rng.integers(0, 30))
            w[len(w) // 2 : len(w) // 2] = shared[a : a + 25]
        rows.append((k, w, None, "", ""))
    rows += [(100, ["é", "a"] * 20, None, "", ""), (101, None, {"é a": 5}, "", ""), (102, [], None, "", "")]
    counts, records = Counter(), defaultdict(set)
    for k, w, tf, *_ in rows:
        for i in range(len(w or [])):
            for n in range(1, len(w) - i + 1):
                g = (n, " ".join(w[i : i + n]))
                counts[g] += 1
                records[g].add(k)
        for t, n in (tf or {}).items():
            counts[(1, t)] += n
            records[(1, t)].add(k)
    want = {g: (c, len(records[g])) for g, c in counts.items() if g[0] <= 4 or c > 1}
    df = spark.createDataFrame(rows, SCHEMA)
    for block, bits in ((1_000_000, 1 << 28), (100, 64)):  # a filter that lets all through, and blocks of a few records, change nothing
        monkeypatch.setattr(T, "BLOCK_TOKENS", block)
        got = {(r.n, r.term): (r.occurrences, r.records) for r in T.repeated_ngrams(T.query_records(df).repartition(3), bits=bits).collect()}
        assert got == want
    assert max(n for n, _ in want) > 20
    assert T.repeated_ngrams(T.query_records(df.limit(0))).count() == 0
