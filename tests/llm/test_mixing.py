import base64
import random

import tiktoken
from pyspark.sql import functions as F

from lexigrove.llm import mixing as M


def tables(spark, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta court jury 12 x-y".split()
    docs = []
    for k in range(400):
        s = rng.choice(["News", " news", "blog", "forum ", "tiny"] if rng.random() < 0.9 else ["other"])
        docs.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), s, "a", 1.0))
    docs += [(900, None, "news", "a", 1.0), (901, "", "news", "a", 1.0), (902, "text", None, "a", 1.0), (903, "text", "  ", "a", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, key double")
    targets = spark.createDataFrame([("news", 10.0, 2), ("blog", 5.0, 3), ("forum", 40.0, 2), ("tiny", 30.0, 1), ("none", 5.0, 4)], "source string, target_weight double, max_repeats int")
    return docs, df, targets


def test_counts_are_the_tokenizers(spark):
    with open(M.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", None, "a b\n\n c", "<|endoftext|>", "é" * 10, "\n".join("word " * rng.randint(0, 9) + rng.choice(["", "end"]) + "\n" * rng.randint(0, 2) for _ in range(60_000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(M.token_counts(spark)("t")).collect()]
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    assert "".join(M._pieces(texts[-1])) == texts[-1] and len(list(M._pieces(texts[-1]))) > 1


def test_blend_against_brute_force(spark, monkeypatch):
    docs, df, targets = tables(spark)
    for blocks in (65536, 3):
        monkeypatch.setattr(M, "KEY_BLOCKS", blocks)
        rows = M.sized(df)
        plan = M.budgets(rows, targets)
        out = {r.doc_id: (r.copies, r.tokens) for r in M.blend(rows, plan).collect()}
        at = {r.doc_id: r for r in rows.collect()}
        assert set(at) == {k for k, *_ in docs if k < 900}
        total = sum(r.tokens for r in at.values())
        by = {r.source: r for r in M.shares(plan, M.blend(rows, plan)).collect()}
        for source, weight, most in [("news", 10, 2), ("blog", 5, 3), ("forum", 40, 2), ("tiny", 30, 1), ("none", 5, 4)]:
            mine = sorted((r for r in at.values() if r.source == source), key=lambda r: (r.key, r.doc_id))
            have = sum(r.tokens for r in mine)
            want = weight / 90 * total
            use = min(want, most * have)
            full = int(use // have) if have else 0
            rest, run = use - full * have, 0
            for r in mine:
                run += r.tokens
                copies = full + (1 if run <= rest else 0)
                assert out.get(r.doc_id, (0, 0))[0] == copies, (source, r.doc_id)
            assert by[source].falls_short == (most * have < want)
            assert max((out.get(r.doc_id, (0,))[0] for r in mine), default=0) <= most
        assert not any(r.source == "other" and k in out for k, r in at.items())


def test_keys_do_not_depend_on_partitions(spark):
    _, df, _ = tables(spark)
    a = {(r.doc_id, r.key) for r in M.sized(df.repartition(7)).collect()}
    assert a == {(r.doc_id, r.key) for r in M.sized(df.coalesce(1)).collect()}
    assert a != {(r.doc_id, r.key) for r in M.sized(df, seed=1).collect()}


def test_better_texts_come_first_more_often(spark):
    docs = [(k, "letters only here" if k % 2 else "1 2 3 4 ; 5 % 6 $", "s") for k in range(2000)]
    rows = M.sized(spark.createDataFrame(docs, "doc_id long, text string, source string")).orderBy("key").limit(500).collect()
    assert sum(r.doc_id % 2 for r in rows) > 300


def test_sizes_and_weights_given(spark):
    docs = [(k, "x" * (1 + k % 5), "s", float(k % 2), 1.0) for k in range(2000)] + [(2000, "xx", "s", None, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, weight double, tokens double")
    rows = M.sized(df, size=F.length("text") * 2, weight=F.col("weight") * 3)
    assert {r.doc_id: r.tokens for r in rows.collect()} == {k: 2 * len(t) for k, t, *_ in docs}
    assert sum(r.doc_id % 2 for r in rows.orderBy("key").limit(500).collect()) > 400
    wrong = spark.createDataFrame([("nothing wrong with this text",), ("s\u00c3\u00a9rie br\u00c3\u00bbl\u00c3\u00a9e",), ("2 3 4 % $",)], "t string")
    good, broken, odd = [r[0] for r in wrong.select(M.text_quality(F.col("t"), F.length("t") / 4)).collect()]
    assert good > 0.9 and broken < 0.5 and odd < 0.6


def test_empty(spark):
    _, df, targets = tables(spark)
    rows = M.sized(df.limit(0))
    plan = M.budgets(rows, targets)
    assert {r.falls_short for r in M.shares(plan, M.blend(rows, plan)).collect()} == {False}
    assert M.blend(rows, plan).count() == 0
    assert {r.reached for r in M.shares(plan, M.blend(rows, plan)).collect()} == {None}
    assert M.budgets(rows, targets.limit(0)).count() == 0
    odd = spark.createDataFrame([("News", None, 1), (None, 1.0, 1), (" news ", 2.0, None)], "source string, target_weight double, max_repeats int")
    assert [(r.source, r.share) for r in M.budgets(M.sized(df), odd).collect()] == [("news", 1.0)]
