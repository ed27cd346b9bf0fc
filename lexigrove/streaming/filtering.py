"""Day-by-day filtering of a stream of items against entity profiles.

The batch form is the definition: running statistics of a day hold the days before it, cumulated by windows over
(day, term) rows. DayFilter does the same with Structured Streaming, one day a step, its state in small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.functions.analysis import simple_tokens
from lexigrove.session import BROADCAST_ROWS, children, materialise, remove, scope
from lexigrove.streaming import within
from lexigrove.streaming.within import flat, item_rows, row_totals

MU, K1, B = 2500.0, 1.75, 0.75

#: Scores are whole numbers: logs and weights times this.
SCALE = 1000

#: Items of a model, entity and day that are kept.
POOL = 100


def item_terms(items: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(stream_id, day, term, tf, size) of items(stream_id, day, text): lower-case tokens of more than two characters; size counts them all."""
    words = F.filter(simple_tokens(F.col("text")), lambda w: (F.length(w) > 2) & (~w.isin(stop) if stop else F.lit(True)))
    rows = items.filter("text is not null and stream_id is not null").select("stream_id", "day", words.alias("ws"))
    return rows.select("stream_id", "day", F.size("ws").alias("size"), F.explode("ws").alias("term")).groupBy("stream_id", "day", "size", "term").agg(F.count("*").alias("tf"))


def query_terms(topics: DataFrame) -> DataFrame:
    """(target_id, kind, term, qtf, qlen): label tokens, and abstract tokens of more than two characters."""
    label = topics.select("target_id", F.lit("label").alias("kind"), F.explode(F.filter(F.transform("label_tokens", F.lower), lambda t: t != "")).alias("term"))
    abstract = topics.select("target_id", F.lit("abstract").alias("kind"), F.explode(F.filter(simple_tokens(F.col("abstract")), lambda t: F.length(t) > 2)).alias("term"))
    rows = label.unionAll(abstract).groupBy("target_id", "kind", "term").agg(F.count("*").alias("qtf"))
    return rows.withColumn("qlen", F.sum("qtf").over(W.partitionBy("target_id", "kind")))


def day_totals(terms: DataFrame) -> DataFrame:
    """(day, docs, tokens) of one day; items without a token of three characters don't count."""
    return terms.select("stream_id", "day", "size").distinct().groupBy("day").agg(F.count("*").alias("docs"), F.sum("size").alias("tokens"))


def day_terms(terms: DataFrame, tracked: DataFrame) -> DataFrame:
    """(day, term, df, cf) of tracked terms."""
    return terms.join(_small(tracked.select("term").distinct()), "term", "left_semi").groupBy("day", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _small(df: DataFrame) -> DataFrame:
    """Profiles and what derives from them: broadcast while they are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def running_totals(totals: DataFrame) -> DataFrame:
    """(day, docs, tokens, mean): sums over the days before; a row a day, so one window is small."""
    before = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    rows = totals.select("day", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens"))
    return rows.withColumn("mean", F.round(F.col("tokens") / F.when(F.col("docs") > 0, F.col("docs"))))


def running_terms(days: DataFrame) -> DataFrame:
    """(term, after, upto, df, cf): sums that hold for days after `after` up to `upto` (NULL: all later ones)."""
    order = W.partitionBy("term").orderBy("day")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return days.select("term", F.col("day").alias("after"), F.lead("day").over(order).alias("upto"), F.sum("df").over(upto).alias("df"), F.sum("cf").over(upto).alias("cf"))


def sliding_terms(days: DataFrame, width: int = 5) -> DataFrame:
    """(day, term, df, cf) over the `width` days before each day on which the term occurs; days are dates."""
    number = F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    frame = W.partitionBy("term").orderBy("n").rangeBetween(-width, -1)
    rows = days.withColumn("n", number)
    return rows.select("day", "term", F.coalesce(F.sum("df").over(frame), F.lit(0)).alias("df"), F.coalesce(F.sum("cf").over(frame), F.lit(0)).alias("cf"))


def matches(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(target_id, stream_id, day, size): pairs in which a label token occurs in the item."""
    labels = queries.filter("kind = 'label'").select("target_id", "term")
    return terms.join(_small(labels), "term").select("target_id", "stream_id", "day", "size").distinct()


#: The live scorers.
MODELS = ("bm25", "bm25_ext", "lm", "lm_ext", "kl")


def scored(terms: DataFrame, queries: DataFrame, totals: DataFrame, statistics: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """(model, target_id, stream_id, day, score double) for every matched pair under the models; terms of profiles that none of them reads aren't joined.

    totals are running_totals, statistics running_terms: of the days before. Terms not seen before have df = cf = 0; on a day without a past nothing scores.
    Ext models take the abstract's terms, and give 0 for profiles without; kl too, or the label's where there is none.
    """
    pairs = matches(terms, queries).join(_small(totals.filter("docs > 0")), "day")
    kinds = queries.groupBy("target_id").agg(F.max(F.when(F.col("kind") == "abstract", 1).otherwise(0)).alias("has"))
    q = queries.join(kinds, "target_id")
    if not {"bm25_ext", "lm_ext", "kl"} & set(models):
        q = q.filter("kind = 'label'")
    elif not {"bm25", "lm"} & set(models):
        q = q.filter("kind = 'abstract' or has = 0")
    q = _small(q)
    rows = pairs.join(q, "target_id").join(terms.select("stream_id", "term", "tf"), ["stream_id", "term"], "left")
    s = _small(statistics.withColumnRenamed("term", "t"))
    on = (rows["term"] == s["t"]) & (rows["day"] > s["after"]) & (s["upto"].isNull() | (rows["day"] <= s["upto"]))
    rows = rows.join(s, on, "left").withColumn("tf", F.coalesce("tf", F.lit(0))).withColumn("df", F.coalesce("df", F.lit(0))).withColumn("cf", F.coalesce("cf", F.lit(0)))
    tf, size = F.col("tf"), F.col("size")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bm = F.when(tf > 0, idf * tf / (tf + K1 * (1 - B) + K1 * B * size / F.col("mean"))).otherwise(0.0)
    value = tf + MU * F.col("cf") / F.col("tokens")
    lm = F.when(value > 1e-4, F.log(value)).otherwise(0.0) - F.log(size + MU)
    rows = rows.select("target_id", "stream_id", "day", "kind", "has", bm.alias("bm"), lm.alias("lm"), (lm * F.col("qtf") / F.col("qlen")).alias("kl"))
    label, ext = F.col("kind") == "label", F.col("kind") == "abstract"
    for_kl = F.when(F.col("has") == 1, ext).otherwise(label)
    zero = F.lit(0.0)

    def total(when: Column, v: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(v))), zero)

    sums = {"bm25": total(label, "bm"), "bm25_ext": total(ext, "bm"), "lm": total(label, "lm"), "lm_ext": total(ext, "lm"), "kl": total(for_kl, "kl")}
    wide = rows.groupBy("target_id", "stream_id", "day").agg(*[sums[m].alias(m) for m in models])
    return wide.select("target_id", "stream_id", "day", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("x")).select("x.model", "target_id", "stream_id", "day", "x.score")


def scored_rows(rows: DataFrame, queries: DataFrame, totals: DataFrame, statistics: DataFrame, models: Sequence[str] = MODELS, size: int | None = None) -> DataFrame:
    """scored() of item_rows, where the items are; profiles too many for a task are joined. With size, only what can be among the `size` best of a model, entity and day need come."""
    held = within.profiles(queries, totals, statistics, models, MU)
    if held is None:
        return scored(flat(rows), queries, totals, statistics, models)
    return within.row_scores(within.by_day(rows) if size else rows, held, models, MU, K1, B, size)


def pool(scores: DataFrame, size: int = POOL) -> DataFrame:
    """The best `size` items of each model, entity and day, whole scores, of equals the smaller stream_id first."""
    rows = scores.withColumn("score", F.floor(F.round("score", 9) * SCALE).cast("long"))
    order = W.partitionBy("model", "target_id", "day").orderBy(F.desc("score"), "stream_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def filter_batch(items: DataFrame, topics: DataFrame, warm_up: int = 0, size: int = POOL) -> DataFrame:
    """The whole filter over items(stream_id, day, text): pools of every day after the first warm_up days."""
    queries = materialise(query_terms(topics))
    rows = materialise(item_rows(items, queries))
    totals = materialise(running_totals(row_totals(rows)))
    statistics = materialise(running_terms(day_terms(flat(rows), queries)))
    if warm_up:
        days = [r[0] for r in totals.select("day").orderBy("day").limit(warm_up).collect()]
        rows = rows.filter(~F.col("day").isin(days))
    out = scored_rows(rows, queries, totals, statistics, size=size)
    return pool(out, size)


def rsj_weights(terms: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """(target_id, term, weight): log((r + .5)(N - n + .5) / ((n - r + .5)(R - r + .5))), with N judged items of the entity, R relevant ones, n and r of these with the term.

    judged(target_id, stream_id, relevant) is made distinct; the least judgment of an item holds.
    """
    j = judged.groupBy("target_id", "stream_id").agg(F.min(F.col("relevant").cast("int")).alias("rel"))
    sizes = j.groupBy("target_id").agg(F.count("*").alias("all"), F.sum("rel").alias("all_rel"))
    labels = queries.filter("kind = 'label'").select("target_id", "term")
    hits = j.join(terms.select("stream_id", "term"), "stream_id").join(labels, ["target_id", "term"]).groupBy("target_id", "term").agg(F.count("*").alias("n"), F.sum("rel").alias("r"))
    rows = labels.join(sizes, "target_id").join(hits, ["target_id", "term"], "left").fillna(0, ["n", "r"])
    weight = F.log((F.col("r") + 0.5) * (F.col("all") - F.col("n") + 0.5) / ((F.col("n") - F.col("r") + 0.5) * (F.col("all_rel") - F.col("r") + 0.5)))
    return rows.select("target_id", "term", weight.alias("weight"))


def rsj_scores(terms: DataFrame, queries: DataFrame, weights: DataFrame, mean: float, most: float = 1000.0) -> DataFrame:
    """(target_id, stream_id, score): BM25 with relevance weights, by that of an ideal item that is the label itself, times `most`."""
    labels = queries.filter("kind = 'label'")
    k = lambda size: K1 * (1 - B) + K1 * B * size / mean
    w = labels.join(weights, ["target_id", "term"])
    ideal = w.groupBy("target_id").agg(F.sum(F.col("weight") / (1 + k(F.col("qlen")))).alias("ideal"))
    rows = terms.join(w.select("target_id", "term", "weight"), "term").groupBy("target_id", "stream_id").agg(F.sum(F.col("weight") * F.col("tf") / (F.col("tf") + k(F.col("size")))).alias("s"))
    return rows.join(ideal, "target_id").select("target_id", "stream_id", F.when(F.col("ideal") > 0, most * F.col("s") / F.col("ideal")).otherwise(0.0).alias("score"))


def related_scores(terms: DataFrame, topics: DataFrame, most: float = 1000.0) -> DataFrame:
    """(target_id, stream_id, score): 70 % for the share of label tokens in the item, 30 % for the mean share over related entities' labels."""
    labels = topics.select("target_id", F.explode(F.array_distinct(F.transform("label_tokens", F.lower))).alias("term"), F.size("label_tokens").alias("n"))
    own = terms.join(_small(labels), "term").groupBy("target_id", "stream_id").agg(F.sum(0.7 * most / F.col("n")).alias("s"))
    rel = topics.select("target_id", F.explode("related_entities").alias("r"), F.size("related_entities").alias("m"))
    parts = rel.join(labels.withColumnRenamed("target_id", "r"), "r").select("target_id", "term", (0.3 * most / F.col("m") / F.col("n")).alias("v"))
    more = terms.join(_small(parts), "term").groupBy("target_id", "stream_id").agg(F.sum("v").alias("s"))
    return own.unionAll(more).groupBy("target_id", "stream_id").agg(F.least(F.sum("s"), F.lit(most)).alias("score"))


def title_scores(items: DataFrame, topics: DataFrame, most: int = 1000) -> DataFrame:
    """(target_id, stream_id, score): label tokens that occur in the item's title, or its anchor where it has none, a whole step each."""
    text = F.lower(F.coalesce(F.nullif(F.trim(F.col("other_content")["title"]["raw"]), F.lit("")), F.col("other_content")["anchor"]["raw"]))
    words = items.select("stream_id", F.explode(F.array_distinct(simple_tokens(text))).alias("term")).distinct()
    labels = topics.select("target_id", F.explode(F.transform("label_tokens", F.lower)).alias("term"), F.size("label_tokens").alias("n"))
    hits = words.join(_small(labels), "term").groupBy("target_id", "stream_id", "n").agg(F.count("*").alias("k"))
    return hits.select("target_id", "stream_id", F.least(F.col("k") * F.floor(F.lit(most) / F.col("n")), F.lit(most)).cast("long").alias("score"))


def day_pass(terms: DataFrame, queries: DataFrame, history: int = 5, gate: int = 10_000, keep: int = POOL, mu: float = MU) -> DataFrame:
    """(target_id, stream_id, day, first, score, place): the filter run a day at a time.

    Each day's items are a collection of their own: the label's terms rank them by their mean Dirichlet log score (`first`), and the best `gate`
    of each entity pass. These are scored again as one passage each, by the summed log probability of the label's words
    against the collection of the `history` days before (a word that neither has counts once there), and the best
    `keep` stay, of equals the smaller stream_id first. Days without a past give none. days are dates.
    """
    labels = queries.filter("kind = 'label'")
    label = _small(labels.select("target_id", "term", "qtf", "qlen"))
    totals = day_totals(terms)
    days = day_terms(terms, labels)
    hits = terms.join(_small(labels.select("target_id", "term")), "term").select("target_id", "stream_id", "day", "size").distinct()
    rows = hits.join(label, "target_id").join(terms.select("stream_id", "term", "tf"), ["stream_id", "term"], "left").fillna(0, ["tf"])
    rows = rows.join(_small(totals.select("day", F.col("tokens").alias("day_tokens"))), "day").join(_small(days.select("day", "term", F.col("cf").alias("day_cf"))), ["day", "term"], "left").fillna(0, ["day_cf"])
    share = F.when(F.col("day_cf") > 0, F.col("day_cf") / F.col("day_tokens")).otherwise(0.5 / F.col("day_tokens"))
    first = F.sum(F.col("qtf") / F.col("qlen") * F.log((F.col("tf") + mu * share) / (F.col("size") + mu))).alias("first")
    # The past of a day holds for days on which nothing of the term came, too: sums by day number over the days that there are.
    number = F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date"))
    ahead = F.explode(F.sequence(number + 1, number + history)).alias("n")
    past = totals.select("tokens", ahead).groupBy("n").agg(F.sum("tokens").alias("old_tokens"))
    old = days.select("term", "cf", ahead).groupBy("term", "n").agg(F.sum("cf").alias("old_cf"))
    rows = rows.withColumn("n", number).join(_small(past), "n").join(_small(old), ["term", "n"], "left").fillna(0, ["old_cf"])
    count = F.when((F.col("old_cf") == 0) & (F.col("tf") == 0), 1).otherwise(F.col("old_cf"))
    second = F.sum(F.col("qtf") * (F.log(F.col("tf") + mu * count / F.col("old_tokens")) - F.log(F.col("size") + mu))).alias("score")
    pairs = rows.groupBy("target_id", "day", "stream_id").agg(first, second)
    by_first = W.partitionBy("target_id", "day").orderBy(F.desc("first"), "stream_id")
    by_second = W.partitionBy("target_id", "day").orderBy(F.desc("score"), "stream_id")
    passed = pairs.withColumn("g", F.row_number().over(by_first)).filter(F.col("g") <= gate).drop("g")
    return passed.withColumn("place", F.row_number().over(by_second)).filter(F.col("place") <= keep).select("target_id", "stream_id", "day", "first", "score", "place")


def feedback_groups(terms: DataFrame, queries: DataFrame, group: int = 5, docs: int = 5, mu: float = MU) -> DataFrame:
    """(group, target_id, stream_id, score, p): the bootstrap. Days fall into groups of `group` in their order, each a collection; of each
    the `docs` best items of every entity by the label's mean Dirichlet log score, with their posteriors p, feed its expansion."""
    labels = queries.filter("kind = 'label'")
    number = terms.select("day").distinct().withColumn("group", F.floor((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("day")) - 1) / group))  # a row a day
    t = terms.join(F.broadcast(number), "day")
    sizes = t.select("stream_id", "group", "size").distinct().groupBy("group").agg(F.sum("size").alias("total"))
    counts = t.join(_small(labels.select("term").distinct()), "term", "left_semi").groupBy("group", "term").agg(F.sum("tf").alias("cf"))
    hits = t.join(_small(labels.select("target_id", "term")), "term").select("target_id", "stream_id", "group", "size").distinct()
    rows = hits.join(_small(labels.select("target_id", "term", "qtf", "qlen")), "target_id").join(t.select("stream_id", "term", "tf"), ["stream_id", "term"], "left").fillna(0, ["tf"])
    rows = rows.join(_small(sizes), "group").join(_small(counts), ["group", "term"], "left").fillna(0, ["cf"])
    share = F.when(F.col("cf") > 0, F.col("cf") / F.col("total")).otherwise(0.5 / F.col("total"))
    scores = rows.groupBy("group", "target_id", "stream_id").agg(F.sum(F.col("qtf") / F.col("qlen") * F.log((F.col("tf") + mu * share) / (F.col("size") + mu))).alias("score"))
    best = W.partitionBy("group", "target_id").orderBy(F.desc("score"), "stream_id")
    top = scores.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= docs)
    whole = W.partitionBy("group", "target_id")
    e = F.exp(F.col("score") - F.max("score").over(whole))
    return top.withColumn("e", e).select("group", "target_id", "stream_id", "score", (F.col("e") / F.sum("e").over(whole)).alias("p"))


def group_expansions(terms: DataFrame, feedback: DataFrame, count: int = 10) -> DataFrame:
    """(group, target_id, term, weight): the `count` strongest terms of the relevance model over the feedback items of each group and entity."""
    rows = terms.select("stream_id", "term", "tf", "size").join(_small(feedback.select("group", "target_id", "stream_id", "p")), "stream_id")
    model = rows.groupBy("group", "target_id", "term").agg(F.sum(F.col("p") * F.col("tf") / F.col("size")).alias("weight"))
    best = W.partitionBy("group", "target_id").orderBy(F.round("weight", 12).desc(), "term")
    return model.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= count).drop("k")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, doc_id, collected, target_id, rating, directory, size) of judgment lines: columns 3, 4, 6, 8 and 12 of blank-separated ones.
    Lines that begin with # or have fewer columns, and those without a whole-number rating, are left out."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("v")).filter(F.size("v") >= 12)
    rows = rows.select(F.col("v")[2].alias("stream_id"), F.col("v")[3].alias("target_id"), F.col("v")[5].try_cast("int").alias("rating"), F.col("v")[7].alias("directory"), F.col("v")[11].try_cast("long").alias("size"))
    time = F.substring_index("stream_id", "-", 1).try_cast("long").alias("collected")
    return rows.dropna(subset=["rating"]).select("stream_id", F.expr("substr(stream_id, instr(stream_id, '-') + 1)").alias("doc_id"), time, "target_id", "rating", "directory", "size")


def term_relevance(terms: DataFrame, judged: DataFrame, queries: DataFrame, least: int = 1) -> DataFrame:
    """(target_id, term, judged_df, relevant_df, relevant_size) of label terms: judged items with the term, those of them rated `least` or better, and
    all that are. judged(target_id, stream_id, rating); the least rating of an item holds."""
    j = judged.groupBy("target_id", "stream_id").agg((F.min("rating") >= least).cast("long").alias("rel"))
    sizes = j.groupBy("target_id").agg(F.sum("rel").alias("relevant_size"))
    labels = queries.filter("kind = 'label'").select("target_id", "term")
    hits = j.join(terms.select("stream_id", "term"), "stream_id").join(_small(labels), ["target_id", "term"]).groupBy("target_id", "term").agg(F.count("*").alias("judged_df"), F.sum("rel").alias("relevant_df"))
    return labels.join(sizes, "target_id").join(hits, ["target_id", "term"], "left").fillna(0, ["judged_df", "relevant_df"]).select("target_id", "term", "judged_df", "relevant_df", "relevant_size")


def kl_scores(terms: DataFrame, distributions: DataFrame, shares: DataFrame, mu: float = MU) -> DataFrame:
    """(target_id, stream_id, score): the sum over an entity's distribution(target_id, term, p) of p x ln P(term | item), for items with any of its
    terms; P is Dirichlet-smoothed by shares(term, share). Terms without a share or with none above 1e-9 don't count."""
    d = distributions.join(shares.filter("share > 1e-9"), "term")
    hits = terms.join(_small(d.select("target_id", "term")), "term").select("target_id", "stream_id", "size").distinct()
    rows = hits.join(_small(d), "target_id").join(terms.select("stream_id", "term", "tf"), ["stream_id", "term"], "left").fillna(0, ["tf"])
    return rows.groupBy("target_id", "stream_id").agg(F.sum(F.col("p") * F.log((F.col("tf") + mu * F.col("share")) / (F.col("size") + mu))).alias("score"))


def poisson(tf: Column, rate: Column) -> Column:
    """ln P(tf | rate) = tf ln rate - rate - ln tf!"""
    from lexigrove.functions.analysis import log_factorial

    return tf * F.log(rate) - rate - log_factorial(tf)


def mixture(counts: DataFrame, delta: float = 1e-6, rounds: int = 200) -> tuple[float, float, float]:
    """(share, rate of the topic, rate of the background) of two Poisson distributions in counts(tf, n), by expectation-maximisation until the log likelihood moves by delta at most.

    counts says how many documents have a term tf times. It is summed by tf in Spark; what comes to the driver is a row
    for each distinct tf, of which there are no more than a document has tokens.
    """
    import math

    rows = [(r[0], r[1]) for r in counts.groupBy("tf").agg(F.sum("n")).collect() if r[0] is not None and r[1]]
    docs = sum(n for _, n in rows)
    if not docs:
        return 0.0, 0.0, 0.0
    mean = sum(tf * n for tf, n in rows) / docs
    share, hi, lo, last = 0.5, max(max(tf for tf, _ in rows), 1e-6), max(mean / 2, 1e-6), -math.inf
    for _ in range(rounds):
        total = weight = hits = 0.0
        for tf, n in rows:
            a, b = math.log(share) + tf * math.log(hi) - hi, math.log(1 - share) + tf * math.log(lo) - lo
            both = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            r = math.exp(a - both)
            total, weight, hits = total + n * both, weight + n * r, hits + n * r * tf
        share = min(max(weight / docs, 1e-9), 1 - 1e-9)
        hi, lo = max(hits / max(weight, 1e-12), 1e-9), max((mean * docs - hits) / max(docs - weight, 1e-12), 1e-9)
        if abs(total - last) <= delta:
            break
        last = total
    return share, hi, lo


class DayFilter:
    """The filter as a stream: every micro-batch brings items, is worked off day by day, and leaves all day totals and term counts so far in
    its folder, one row a day and tracked term; states older than the one before the last are deleted.

    A day is scored against the state as of the days before; late items of a day already counted are scored with that day's state, and
    count for days to come. Batches carry their number, so that one that is run again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, topics: DataFrame, folder: str, warm_up: int = 0, size: int = POOL) -> None:
        self.spark, self.folder, self.warm_up, self.size = spark, folder.rstrip("/"), warm_up, size
        self.queries = materialise(query_terms(topics))

    def _state(self, name: str, schema: str, before: int) -> DataFrame:
        """What the last batch before this one left; a state that is there but can't be read raises."""
        done = [int(x.removeprefix("batch=")) for x in children(self.spark, f"{self.folder}/{name}") if x.startswith("batch=")]
        last = max((k for k in done if k < before), default=None)
        for k in done:
            if last is not None and k < last - 1:
                remove(self.spark, f"{self.folder}/{name}/batch={k}")
        return self.spark.createDataFrame([], schema) if last is None else self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={last}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        with scope():
            self._batch(batch, number)

    def _batch(self, batch: DataFrame, number: int) -> None:
        rows = materialise(item_rows(batch, self.queries))
        totals, days = row_totals(rows), day_terms(flat(rows), self.queries)
        old_totals = self._state("totals", "day string, docs long, tokens long", number)
        old_days = self._state("terms", "day string, term string, df long, cf long", number)
        all_totals = old_totals.unionByName(totals.select("day", "docs", "tokens")).groupBy("day").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        all_days = old_days.unionByName(days.select("day", "term", "df", "cf")).groupBy("day", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        all_totals, all_days = materialise(all_totals), materialise(all_days)
        running = materialise(running_totals(all_totals))
        if self.warm_up:
            first = [r[0] for r in running.select("day").orderBy("day").limit(self.warm_up).collect()]
            rows = rows.filter(~F.col("day").isin(first))
        out = scored_rows(rows, self.queries, running, materialise(running_terms(all_days)), size=self.size)
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        write(pool(out, self.size), "pools")
        write(all_totals, "totals")
        write(all_days, "terms")

    def start(self, stream: DataFrame, checkpoint: str):
        """Runs over all that is there (availableNow); stream has stream_id, day, text."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def results(self) -> DataFrame:
        """Pools of all batches, merged to the best of each model, entity and day."""
        rows = self.spark.read.parquet(f"{self.folder}/pools").drop("batch", "place")
        order = W.partitionBy("model", "target_id", "day").orderBy(F.desc("score"), "stream_id")
        return rows.dropDuplicates(["model", "target_id", "day", "stream_id"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.size)


def daily_windows(items: DataFrame, late: str = "3 days") -> DataFrame:
    """Streamed (window, source, n) of items(stream_time, source): tumbling days with a watermark, for streams that come by event time."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    return items.withWatermark("stream_time", late).groupBy(F.window("stream_time", "1 day"), source.alias("source")).agg(F.count("*").alias("n"))
