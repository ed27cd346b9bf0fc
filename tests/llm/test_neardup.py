import itertools
import random

import numpy as np
import pytest

from lexigrove.llm import neardup as N


def sets(texts, n):
    from lexigrove.llm.words import TAG, words

    out = {}
    for k, t in texts:
        if k is not None and t is not None:
            w = words(TAG.sub(" ", t))
            out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {k: v for k, v in out.items() if v}


def brute(texts, n, least):
    s = sets(texts, n)
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def corpus(seed=1, families=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 60)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [w[i], rng.choice(vocab)]])
            rows.append((f"d{k:04d}", "<p>" + " ".join(w) + "</p>"))
            k += 1
    return rows


@pytest.mark.parametrize("n,least", [(3, 0.6), (5, 0.8)])
def test_pairs_against_brute_force(spark, n, least):
    rows = corpus()
    rows += [("x1", None), (None, "a b c d e f"), ("x2", ""), ("x3", "one two"), ("x4", rows[0][1]), ("x4", rows[0][1]), ("x5", rows[0][1].upper().replace(" ", "\n ")), ("x6", "<b>")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "docno string, text string, fp string, id int")
    members, links = N.near_duplicates(df, "docno", "text", n, least)
    got = {(r.a, r.b) for r in N.found_pairs(members, links).collect()}
    want = brute(rows, n, least)
    assert not got - want and len(want - got) <= 0.01 * len(want) + 0
    groups = {r.id: r["class"] for r in N.groups(members, links).collect()}
    top = {k: k for k in sets(rows, n)}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in sorted(got):
        x, y = sorted((root(a), root(b)))
        top[y] = x
    assert groups == {k: root(k) for k in top}


def test_one_group_of_copies_and_empty(spark):
    same = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(f"c{i}", same) for i in range(200)] + [("o", same.replace("w7", "zz"))], "docno string, text string")
    members, links = N.near_duplicates(df, "docno", "text", 3, 0.6)
    assert links.count() == 1 and members.select("fp").distinct().count() == 2
    assert {(r["class"], r.n_links) for r in N.groups(members, links).collect()} == {("c0", 1)}
    members, links = N.near_duplicates(df.limit(0), "docno", "text")
    assert links.count() == 0 and N.groups(members, links).count() == 0


def test_classes_that_do_not_come_together_are_told(spark):
    chain = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)], "a binary, b binary")
    assert {bytes(r["class"]) for r in N.classes(chain).collect()} == {b"000"}
    with pytest.raises(RuntimeError):
        N.classes(chain, rounds=1)


def test_long_text(spark):
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(300_000)]
    df = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(long[:-500])), ("c", "x y z")], "docno string, text string")
    members, links = N.near_duplicates(df, "docno", "text")
    assert links.count() == 1


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    wa, wb = rng.uniform(1, 2, 300), None
    a, b = h[:300], h[100:]
    wb = np.r_[wa[100:], rng.uniform(1, 2, 100)]
    want = wa[100:].sum() / (wa.sum() + wb[200:].sum())
    s = N.weighted_samples(np.r_[a, b], np.r_[wa, wb], np.array([0, 300]), 3000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_frequent_shingles_are_exact(spark, monkeypatch):
    rows = corpus(4, 30)
    texts = N.materialise(N.normal_texts(spark.createDataFrame(rows, "docno string, text string"), "docno", "text", 3))
    share = 0.05
    got = N.frequent_shingles(texts, 3, len(rows), share)
    counts = {}
    for s in sets(rows, 3).values():
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    assert sorted(got.values()) == sorted(c for c in counts.values() if c >= share * len(rows))
    hot = " ".join(f"h{i}" for i in range(100))
    rows += [(f"h{i}", f"{hot} " + " ".join(f"h{i}x{j}" for j in range(100))) for i in range(2 * len(rows))]
    texts = N.materialise(N.normal_texts(spark.createDataFrame(rows, "docno string, text string"), "docno", "text", 3))
    want = N.frequent_shingles(texts, 3, len(rows), 0.5)
    assert len(want) == 98 and set(want.values()) == {len(rows) * 2 // 3}
    for counters, chunk in ((2000, 4000), (2000, 7), (1700, 1)):  # fewer counters let more candidates through, no other result
        monkeypatch.setattr(N, "COUNTERS", counters)
        monkeypatch.setattr(N, "CHUNK_TEXTS", chunk)
        assert N.frequent_shingles(texts.repartition(5), 3, len(rows), 0.5) == want
    monkeypatch.setattr(N, "COUNTERS", 20)
    with pytest.raises(ValueError):
        N.frequent_shingles(texts, 3, len(rows), 0.5)


@pytest.mark.parametrize("n,least,times", [(3, 0.6, 4), (5, 0.8, 2), (5, 0.8, 30)])
def test_repeated_bodies(spark, n, least, times):
    rng = random.Random(5)
    rows = []
    for k in range(10):
        body = [f"t{k}w{i}" for i in range(200)]
        edited = list(body)
        for i in rng.sample(range(200), 2):
            edited[i] = "changed"
        rows += [(f"a{k}", " ".join(body)), (f"b{k}", " ".join(body * times)), (f"c{k}", " ".join(edited * times))]
    members, links = N.near_duplicates(spark.createDataFrame(rows, "docno string, text string"), "docno", "text", n, least)
    want = brute(rows, n, least)
    assert len(want) == 30 and {(r.a, r.b) for r in N.found_pairs(members, links).collect()} == want


def test_hot_family_at_the_limit(spark):
    """A third of the texts are of one family, whose shingles are frequent, and alike by little more than the limit."""
    rng = random.Random(6)
    rows = [(f"o{k:03d}", " ".join(f"o{k}w{i}" for i in range(150))) for k in range(120)]
    base = [f"b{i}" for i in range(150)]
    for k in range(60):
        w = list(base)
        for i in rng.sample(range(len(w)), 6):
            w[i] = f"e{k}x{i}"
        rows.append((f"h{k:03d}", " ".join(w)))
    members, links = N.near_duplicates(spark.createDataFrame(rows, "docno string, text string"), "docno", "text", 3, 0.6)
    got, want = {(r.a, r.b) for r in N.found_pairs(members, links).collect()}, brute(rows, 3, 0.6)
    assert len(want) > 500 and got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("least", [0.5, 0.6, 0.7, 0.8, 0.9])
def test_bands_follow_the_limit(least):
    bands, s = N.banding(least), N.weighted_bound(least)
    equal = np.random.default_rng(7).random((20_000, N.SAMPLES)) < s
    assert equal[:, bands].all(axis=2).any(axis=1).mean() > 0.99


def test_texts_alike_by_furniture_are_not_fetched(spark, monkeypatch):
    """Unlike texts that share two fifths of their shingles with all others meet in bands, but the join by band sets their pairs aside; no true pair goes with them."""
    rng = random.Random(8)
    menu, rows = [f"m{i}" for i in range(80)], []
    for k in range(150):
        body = [f"t{k}w{i}" for i in range(120)]
        rows.append((f"a{k:03d}", " ".join(menu + body)))
        if k % 10 == 0:
            for i in rng.sample(range(120), 8):
                body[i] = f"e{k}x{i}"
            rows.append((f"b{k:03d}", " ".join(menu + body)))
    fetched, check = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *rest: (fetched.append(pairs.count()), check(pairs, *rest))[1])
    members, links = N.near_duplicates(spark.createDataFrame(rows, "docno string, text string"), "docno", "text", 3, 0.6)
    want = brute(rows, 3, 0.6)
    assert len(want) == 15 and {(r.a, r.b) for r in N.found_pairs(members, links).collect()} == want
    assert fetched[0] <= 2 * len(want)


def test_sketches_tell_plain_similarity():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**63, 900, dtype=np.uint64)
    s = N.sketches(np.r_[h[:600], h[300:]], np.repeat([0, 2], 600), 3).view(np.uint8)
    nibbles = np.stack([s & 15, s >> 4], axis=2).reshape(3, -1)
    assert nibbles.shape[1] == N.SKETCH and not nibbles[1].any()
    assert abs((nibbles[0] == nibbles[2]).mean() - (1 / 3 + 2 / 3 / 16)) < 4 * (0.375 * 0.625 / N.SKETCH) ** 0.5
