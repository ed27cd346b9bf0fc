import random

import pytest
from pyspark.sql import functions as F

from lexigrove.llm import ranking as R

SCHEMA = "model_name string, topic_name string, stream_id string, score int, dir_name string, good string, n_items string"


@pytest.fixture(scope="module")
def pools(spark):
    return spark.createDataFrame([("up", True), ("down", False), ("third", True)], "model_name string, bigger_is_better boolean")


def made(seed, items=30):
    rng = random.Random(seed)
    rows = []
    for t in ("t1", "t2", "hot"):
        for i in range(items if t != "hot" else 4 * items):
            q = rng.random()
            for m in ("up", "down", "third"):
                if rng.random() < 0.85:
                    s = int(q * {"up": 90000, "down": 50, "third": 700}[m] + rng.random() * 3)
                    rows.append((m, t, f"s{i:03d}", -s if m == "down" else s, "2011-10-01-00", "x", "y"))
    rows += rows[:10] + [("up", "t1", None, 3, "2011-10-01-00", "", ""), ("up", None, "s1", 3, "2011-10-01-00", "", ""), ("up", "t1", "s001", -99999, "2011-10-01-00", "", ""), ("up", "t1", "s002", None, "2011-10-01-00", "", "")]
    rng.shuffle(rows)
    return rows


def best_of(rows):
    best = {}
    for m, t, s, v, d, *_ in rows:
        if None in (m, t, s, v, d) or v <= -99999:
            continue
        g = -v if m == "down" else v
        k = (m, t, d[:10], s)
        best[k] = max(best.get(k, g), g)
    return best


def test_places_winners_and_positions(spark, pools):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA)
    best = best_of(rows)
    groups = {}
    for (m, t, d, s), g in best.items():
        groups.setdefault((t, d), {}).setdefault(m, {})[s] = g
    want, totals = {}, {}
    for k, by in groups.items():
        items = {s for x in by.values() for s in x}
        total = {s: sum(1 + sum(v > by[m][s] for v in by[m].values()) if s in by.get(m, {}) else len(items) for m in ("up", "down", "third")) for s in items}
        totals.update({(*k, s): v for s, v in total.items()})
        if len(items) >= 12:
            want[k] = min(items, key=lambda s: (total[s], s))
    got = {(r.topic_name, r.dir_day): r.stream_id for r in R.winners(df, pools).collect()}
    assert got == want
    fused, weights = R.fuse(df, pools)
    assert {(r.topic_name, r.dir_day, r.stream_id): r.total for r in fused.collect()} == totals
    assert len(weights) == 3 and min(weights) > 0
    ranked = R.positions(fused, ["topic_name", "dir_day"], ["projection", "stream_id"], 3).collect()
    for k in groups:
        mine = sorted((r for r in ranked if (r.topic_name, r.dir_day) == k), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.projection, r.stream_id) for r in mine] == sorted((r.projection, r.stream_id) for r in mine)


def test_places_across_blocks(spark):
    rng = random.Random(3)
    rows = [("g", rng.choice([rng.randint(-100000, 100000), 5])) for _ in range(500)]
    df = spark.createDataFrame([(g, s, i) for i, (g, s) in enumerate(rows)], "g string, good long, i int")
    got = {r.i: r.place for r in R.places(df, ["g"]).collect()}
    assert got == {i: 1 + sum(x > s for _, x in rows) for i, (_, s) in enumerate(rows)}


def test_component_is_oriented_as_a_whole(spark):
    """A model that runs against the others keeps a negative weight."""
    rng = random.Random(4)
    rows = [(float(i), i + rng.randint(-5, 5) + 0.0, 200.0 - i + rng.randint(-5, 5), 200) for i in range(200)]
    w = R.first_component(spark.createDataFrame(rows, "p0 double, p1 double, p2 double, n_items int"), 3)
    assert w[0] > 0 and w[1] > 0 and w[2] < 0 and sum(map(abs, w)) == pytest.approx(1)
    assert R.first_component(spark.createDataFrame(rows[:1], "p0 double, p1 double, p2 double, n_items int"), 3) == [1 / 3] * 3


def test_fractional_scores(spark):
    rows = [("g", i, s) for i, s in enumerate([0.5, 0.25, 0.5, -1.5, 3.75, 0.26])]
    got = {r.i: r.place for r in R.places(spark.createDataFrame(rows, "g string, i int, good double"), ["g"]).collect()}
    assert got == {0: 2, 1: 5, 2: 2, 3: 6, 4: 1, 5: 4}


def test_top_n(spark, pools):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    top = R.top_n(R.best_scores(df, pools), ["model_name", "topic_name", "dir_day"], "good", "stream_id", 10)
    got = {(r.model_name, r.topic_name, r.dir_day, r.stream_id, r.rn) for r in top.collect()}
    want = set()
    by = {}
    for (m, t, d, s), g in best_of(rows).items():
        by.setdefault((m, t, d), []).append((-g, s))
    for k, v in by.items():
        want |= {(*k, s, i) for i, (_, s) in enumerate(sorted(v)[:10], 1)}
    assert got == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert R.top_n(df.withColumn("score", F.lit(None).cast("int")), ["topic_name"], "score", "stream_id", 0).count() == 0


def test_empty_and_degenerate(spark, pools):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.winners(empty, pools).count() == 0 and R.best_scores(empty, pools).count() == 0
    assert R.winners(empty, pools.limit(0)).count() == 0
    tied = spark.createDataFrame([("up", "t", f"s{i:02d}", 5, "2011-10-01-00", "", "") for i in range(12)], SCHEMA)
    assert R.winners(tied, pools).first().stream_id == "s00"
    unknown = spark.createDataFrame([("new", "t", "a", 5, "2011-10-01", "", ""), ("new", "t", "b", 7, "2011-10-01", "", "")], SCHEMA)
    assert {(r.stream_id, r.good) for r in R.best_scores(unknown, pools).collect()} == {("a", 5), ("b", 7)}
