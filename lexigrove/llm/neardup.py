"""Near-duplicates: consistent weighted sampling over IDF-weighted sets of shingles, banded, verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.words import TAG, WordHashes, mix, runs, words
from lexigrove.session import discard, materialise

#: Counters of a task that looks for frequent shingles (16 bytes each).
COUNTERS = 1 << 20

#: Shingles in this share of the texts or more have a document frequency of their own; all others share the top weight. For texts of
#: more than COUNTERS * COMMON_SHARE / 4 shingles on average the share is as much greater, so that the counters suffice.
COMMON_SHARE = 0.001

#: How much more the rarest shingles weigh than those in all texts. Single weights lie between 1 and 1 + SPREAD.
SPREAD = 0.5

#: Samples of a text; bands share them. At most so many bands are drawn, as long as RECALL of the pairs at the weighted bound have an equal one.
SAMPLES, MOST_BANDS, RECALL = 72, 64, 0.995

#: Texts whose shingles are counted, and shingles that are sampled, at a time.
CHUNK_TEXTS, CHUNK_SHINGLES = 4000, 100_000

#: Shingles in more than this share of the texts, and this many of them, are not sketched. A sketch has so many 4-bit samples of a text's other shingles, 16 in each long.
HOT_SHARE, HOT_LEAST, SKETCH = 0.01, 20, 64
_SKETCH = [f"s{k}" for k in range(SKETCH // 16)]

_SEED = 0x5EED5EED5EED5EED


def normal_texts(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, fp, n, norm): words of the text without tags, their number, joined by blanks, and their 128-bit fingerprint.

    Rows with a NULL id or text, and texts of fewer than n words (which have no shingle), are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, sizes, norms = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(TAG.sub(" ", t))
                if len(w) >= n:
                    norm = " ".join(w)
                    ids.append(i)
                    sizes.append(len(w))
                    norms.append(norm)
                    fps.append(xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.string())], ["id", "fp", "n", "norm"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna("any")
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fp binary, n int, norm string")


def _shingles(texts: list[str], hashes: WordHashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of n words of the normal texts, repeats included."""
    lists = [t.split(" ") for t in texts]
    lengths = np.array([len(ws) for ws in lists], np.int64)
    codes = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, int(lengths.sum()))
    h, text, _ = runs(codes, lengths, n)
    return h, text


def _distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) in the order of texts, with their counts."""
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) + 1 if len(h) else []
    begin = 0
    for end in ends:  # short sorts of one text each are much faster than one by (text, shingle)
        h[begin:end].sort()
        begin = end
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], text[first], np.diff(np.r_[first, len(h)])


def frequent_shingles(reps: DataFrame, n: int, total: int, share: float = COMMON_SHARE) -> dict[int, int]:
    """Exact document frequency of every shingle in at least share x total of the texts.

    A first pass counts shingles in each task with a bounded number of counters: when there are more, the count that comes next is
    taken off all, and added to the task's error. What a task may have missed is thus known, and a shingle can only be frequent
    if its counts and all errors add up to share x total. With COUNTERS at least 4 x (shingles a text) / share, errors stay under a half of
    that; so the candidates are at most COUNTERS / 2, whatever the collection's size. They are sent to all tasks and counted exactly by a second pass.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        hashes, texts = WordHashes(), []

        def out() -> tuple[int, np.ndarray, np.ndarray]:
            return len(texts), *np.unique(_distinct(*_shingles(texts, hashes, n))[0], return_counts=True)

        for b in batches:
            texts += b.column(0).to_pylist()
            if len(texts) >= CHUNK_TEXTS:
                yield out()
                texts = []
        if texts:
            yield out()

    def rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.float64))], ["h", "c"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen, error, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0.0, 0
        for k, h, c in counts(batches):
            texts += k
            keys, at = np.unique(np.concatenate([keys, h]), return_inverse=True)
            seen = np.bincount(at, np.concatenate([seen, c]), len(keys)).astype(np.int64)
            if len(keys) > COUNTERS:
                off = int(np.partition(seen, len(seen) - COUNTERS - 1)[len(seen) - COUNTERS - 1])
                seen, error = seen - off, error + off
                keys, seen = keys[seen > 0], seen[seen > 0]
        least = share * texts / 4  # what is rarer here is left out, and counts as error
        yield rows(keys[seen >= least], seen[seen >= least])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([error + least])], ["h", "c"])

    norms = reps.select("norm")
    found = materialise(norms.mapInArrow(likely, "h long, c double"))
    error = found.filter("h is null").agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    if error >= share * total > 0:
        raise ValueError(f"{COUNTERS} counters are too few for a share of {share}")
    candidates = found.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= share * total - error).select("h").toPandas()
    wanted = norms.sparkSession.sparkContext.broadcast(np.sort(np.array(candidates["h"], np.int64).view(np.uint64)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wanted.value
        if not len(w):
            return
        sums = np.zeros(len(w), np.int64)
        for _, h, c in counts(batches):
            at = np.minimum(np.searchsorted(w, h), len(w) - 1)
            hit = w[at] == h
            sums[at[hit]] += c[hit]
        yield rows(w[sums > 0], sums[sums > 0])

    out = norms.mapInArrow(exact, "h long, c double").groupBy("h").agg(F.sum("c").cast("long").alias("df")).filter(F.col("df") >= share * total).toPandas()
    return dict(zip(out["h"], out["df"]))


def weight_table(frequent: dict[int, int], total: int, share: float = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their idf = ln(total / df), scaled to reach 1 at share; last the 1 of all others."""
    keys = np.sort(np.array(list(frequent), np.int64).view(np.uint64))
    df = np.array([frequent[int(k)] for k in keys.view(np.int64)], np.float64)
    return keys, np.append(np.clip(np.log(total / np.maximum(df, 1)) / np.log(1 / min(share, 0.99)), 0, 1), 1.0)


def weigh(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Weights of shingles: 1 + SPREAD x idf. How often a text repeats one doesn't count, as pairs are defined on sets
    and no weighted limit would hold for all of them otherwise."""
    keys, idf = table
    at = np.searchsorted(keys, h)
    if len(keys):
        at[keys[np.minimum(at, len(keys) - 1)] != h] = len(keys)
    return 1 + SPREAD * idf[at]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) by its quantiles, its logarithm, and the uniform numbers, each at 65536 points."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.linspace(0, 40, 400_001)
    g = np.interp(u, 1 - (1 + x) * np.exp(-x), x)
    return g.astype(np.float32), np.log(g).astype(np.float32), u.astype(np.float32)


def weighted_samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each text `samples` numbers, of which two texts share a share
    equal, on average, to their weighted Jaccard similarity.

    Of every shingle, r and c are Gamma(2, 1) and b uniform, all drawn by its hash; with t = floor(ln w / r + b) the text's
    sample is the (shingle, t) with the least ln c - r (t - b + 1).
    """
    gamma, log_gamma, uniform = _tables()
    lw = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), samples), np.uint32)
    low = np.uint64(0xFFFF)
    for k in range(samples):
        x = mix(h ^ np.uint64((_SEED * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = gamma.take((x & low).view(np.int64), mode="clip")
        b = uniform.take(((x >> np.uint64(32)) & low).view(np.int64), mode="clip")
        t = np.floor(lw / r + b)
        a = log_gamma.take(((x >> np.uint64(16)) & low).view(np.int64), mode="clip") - r * (t - b + np.float32(1))
        bits = a.view(np.int32)
        bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)
        x += t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # the name of (shingle, t)
        x >>= np.uint64(32)
        bits <<= 32
        bits |= x.view(np.int64)
        out[:, k] = np.minimum.reduceat(bits, starts) & 0xFFFFFFFF
    return out


def missed(s: float, bands: int, per_band: int) -> float:
    """The chance that two texts of weighted similarity s have no band equal, of `bands` random sets of per_band of the SAMPLES."""
    sets = comb(SAMPLES, per_band)
    return sum(comb(SAMPLES, x) * s**x * (1 - s) ** (SAMPLES - x) * (1 - comb(x, per_band) / sets) ** bands for x in range(SAMPLES + 1))


def banding(least: float) -> np.ndarray:
    """Samples of each band (a row each): the largest bands, and the fewest of them, that find RECALL of the pairs at the weighted bound of `least`."""
    s = weighted_bound(least)
    for per_band in range(8, 0, -1):
        if missed(s, MOST_BANDS, per_band) <= 1 - RECALL:
            break
    bands = next((k for k in range(1, MOST_BANDS) if missed(s, k, per_band) <= 1 - RECALL), MOST_BANDS)
    rng, a_round = np.random.default_rng(0), SAMPLES // per_band
    rounds = [rng.permutation(SAMPLES)[: a_round * per_band].reshape(a_round, per_band) for _ in range(-(-bands // a_round))]
    return np.concatenate(rounds)[:bands]


def sketches(h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text SKETCH numbers of 4 bits (as longs, a row each), of which two texts share a share equal, on average, to the plain Jaccard similarity
    of the given shingles, and besides a 16th of the rest by chance. 0 for a text without any."""
    some = np.flatnonzero(np.bincount(text, minlength=texts))
    least = np.zeros((texts, SKETCH), np.uint8)
    if len(some):
        starts = np.searchsorted(text, some)
        for k in range(0, SKETCH, 4):
            x = mix(h ^ np.uint64((_SEED * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF)).view(np.uint16).reshape(-1, 4)
            least[some, k : k + 4] = np.minimum.reduceat(x, starts, axis=0) & 15
    return (least[:, ::2] | (least[:, 1::2] << 4)).view("<i8")


def signatures(reps: DataFrame, n: int, weights, hot) -> DataFrame:
    """(t, size, hot, s0, s1, ..., sig): distinct shingles of each text, how many of them are among the sorted `hot`, the sketch of the others, and the samples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ts, norms = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(norms):
                end, size = at, 0
                while end < len(norms) and (end == at or size < CHUNK_SHINGLES):
                    size += norms[end].count(" ")
                    end += 1
                h, text, _ = _distinct(*_shingles(norms[at:end], hashes, n))
                starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                s = weighted_samples(h, weigh(weights.value, h), starts, SAMPLES)
                rare = ~_among(hot.value, h)
                sketch = sketches(h[rare], text[rare], end - at)
                columns = [np.diff(np.r_[starts, len(h)]).astype(np.int32), np.bincount(text[~rare], minlength=end - at).astype(np.int32), *sketch.T]
                yield pa.RecordBatch.from_arrays([ts.slice(at, end - at), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array([row.tobytes() for row in s.astype("<u4")], pa.binary())], ["t", "size", "hot", *_SKETCH, "sig"])
                at = end

    return reps.select("t", "norm").mapInArrow(work, "t long, size int, hot int, " + "".join(f"{c} long, " for c in _SKETCH) + "sig binary")


def _among(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the numbers are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)


def band_rows(sigs: DataFrame, bands: np.ndarray) -> DataFrame:
    """(t, size, hot, s0, s1, ..., key): a row for each text and band; keys of two bands are unlike."""
    kept = ["t", "size", "hot", *_SKETCH]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer(b"".join(b.column(len(kept)).to_pylist()), "<u4").reshape(-1, SAMPLES).astype(np.uint64)
            keys = np.tile(np.arange(1, len(bands) + 1, dtype=np.uint64), (len(s), 1))
            for column in bands.T:
                keys = mix(keys * np.uint64(31) + s[:, column])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(bands), dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists], [*kept, "keys"])

    out = sigs.select(*kept, "sig").mapInArrow(work, ", ".join(f"{c} {kind}" for c, kind in sigs.select(*kept).dtypes) + ", keys array<long>")
    return out.select(*kept, F.explode("keys").alias("key"))


def alike(x: str, y: str, least: float):
    """Whether two texts (prefixes of their columns size, hot and sketch) may be as similar as `least`, told within the join by key, so that of the
    pairs of a bucket, which grow with its square, only those are written that go on to be verified.

    Of texts of that similarity least / (1 + least) of both sizes are common at least, at most the lesser hot of these are hot, and the rest is
    a part of the other shingles that their sketches show: these agree as often as that part makes them but for four standard deviations.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "size") + c(y, "size")
    common = F.greatest(F.lit(0.0), least / (1 + least) * both - F.least(c(x, "hot"), c(y, "hot")))
    share = common / F.greatest(F.lit(1.0), both - c(x, "hot") - c(y, "hot") - common)
    agree = F.least(F.lit(1.0), share + (1 - share) / 16)
    unlike = F.lit(0)
    for name in _SKETCH:
        bits = c(x, name).bitwiseXOR(c(y, name))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        unlike += F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    sizes = F.least(c(x, "size"), c(y, "size")) >= least * F.greatest(c(x, "size"), c(y, "size"))
    return sizes & (SKETCH - unlike >= SKETCH * agree - 4 * F.sqrt(SKETCH * agree * (1 - agree)))


def verified(pairs: DataFrame, n: int, weights, least: float) -> DataFrame:
    """(a, b, weighted, jaccard) of the pairs (a, b, ta, tb) with a plain Jaccard similarity of at least `least`; the weighted one is only told."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, ws, js = [], [], []
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            begin = 0
            while begin < len(a):
                end, size, place = begin, 0, {}
                while end < len(a) and (end == begin or size < CHUNK_SHINGLES):  # a text of many pairs is cut into shingles once
                    for t in (a[end], b[end]):
                        if place.setdefault(t, len(place)) == len(place) - 1:
                            size += t.count(" ")
                    end += 1
                h, text, _ = _distinct(*_shingles(list(place), hashes, n))
                w = weigh(weights.value, h)
                starts = np.searchsorted(text, np.arange(len(place) + 1))
                sums = np.add.reduceat(w, starts[:-1])
                for k in range(begin, end):
                    x, y = place[a[k]], place[b[k]]
                    x0, x1, y0, y1 = starts[x], starts[x + 1], starts[y], starts[y + 1]
                    at = np.searchsorted(h[y0:y1], h[x0:x1])
                    at[at == y1 - y0] = 0
                    both = h[y0:y1][at] == h[x0:x1]
                    common = np.count_nonzero(both)
                    jaccard = common / (x1 - x0 + y1 - y0 - common)
                    if jaccard >= least:
                        shared = w[x0:x1][both].sum()
                        keep.append(k)
                        ws.append(float(shared / (sums[x] + sums[y] - shared)))
                        js.append(float(jaccard))
                begin = end
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ws, pa.float64()), pa.array(js, pa.float64())], ["a", "b", "weighted", "jaccard"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(work, "a binary, b binary, weighted double, jaccard double")


def weighted_bound(least: float) -> float:
    """The weighted similarity that a pair of plain similarity `least` has at worst as single weights lie between 1 and 1 + SPREAD:
    all that is shared weighs 1 and all else 1 + SPREAD."""
    return least / (least + (1 + SPREAD) * (1 - least))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (id, fp) and links (a, b, weighted, jaccard), a < b, between the different normal texts.

    Two texts are linked if the sets of their runs of n words (tags taken as blanks) have a Jaccard similarity
    of at least `least`. Texts with equal words share one fp and are linked to others once; of an id with unlike
    texts the greatest fp holds. Candidates are texts with an equal band of weighted samples; of these, pairs whose sketches
    agree too rarely for that limit are set aside within the join, and the rest is verified on the whole texts by plain
    Jaccard. NULL ids and texts and texts under n words are in no row; an empty table gives none.
    """
    spark = docs.sparkSession
    texts = materialise(normal_texts(docs, id_col, text_col, n))
    members = materialise(texts.groupBy("id").agg(F.max("fp").alias("fp")))
    reps = materialise(texts.groupBy("fp").agg(F.first("n").alias("n"), F.first("norm").alias("norm")).withColumn("t", F.monotonically_increasing_id()))  # numbers take half the space of fps
    discard(texts)
    total, mean = reps.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    share = max(COMMON_SHARE, 4 * mean / COUNTERS)
    frequent = frequent_shingles(reps, n, total, share) if share < 1 else {}
    weights = spark.sparkContext.broadcast(weight_table(frequent, total, share))
    hot = spark.sparkContext.broadcast(np.sort(np.array([h for h, df in frequent.items() if df > max(HOT_SHARE * total, HOT_LEAST)], np.int64).view(np.uint64)))
    rows = band_rows(materialise(signatures(reps, n, weights, hot)), banding(least))
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key")).filter((F.col("x.t") < F.col("y.t")) & alike("x", "y", least)).select(F.col("x.t").alias("a"), F.col("y.t").alias("b")).distinct()
    near = pairs.join(reps.select(F.col("t").alias("a"), F.col("fp").alias("fa"), F.col("norm").alias("ta")), "a").join(reps.select(F.col("t").alias("b"), F.col("fp").alias("fb"), F.col("norm").alias("tb")), "b")
    near = near.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "ta", "tb")
    return members, verified(near, n, weights, least)


def classes(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(fp, class): the least fp that each linked text reaches; by alternating large and small stars, each round written."""
    edges = materialise(links.select("a", "b"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = materialise(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    else:
        raise RuntimeError(f"the links have not come together to classes after {rounds} rounds")
    tops = edges.groupBy("a").agg(F.min("b").alias("class"))
    return tops.select(F.col("a").alias("fp"), "class").unionByName(edges.select(F.col("b").alias("fp"), F.col("b").alias("class")).distinct().join(tops.select(F.col("a").alias("fp")), "fp", "left_anti"))


def found_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): all pairs of ids, the lesser first, that share a text or whose texts are linked."""
    x, y = members.select(F.col("id").alias("x"), F.col("fp").alias("a")), members.select(F.col("id").alias("y"), F.col("fp").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, n_links): a row for each id; class is the least id of its group, n_links its text's links to different texts."""
    links = materialise(links)
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    rows = members.join(ends, "fp", "left").join(classes(links), "fp", "left").select("id", "fp", F.coalesce("class", "fp").alias("top"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = rows.groupBy("top").agg(F.min("id").alias("class"))
    return rows.join(names, "top").select("id", "class", "n_links")
