"""Sources blended to target shares of tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.session import broadcast_if_small, materialise

#: Where the driver finds the ranks of a byte-level BPE (some 50,000 rows, sent to the tasks), and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Blocks of sampling keys of a source; only the one in which its budget ends is sorted.
KEY_BLOCKS = 65536


def token_counts(spark: SparkSession, path: str = TOKENIZER):
    """A pandas UDF: text -> number of tokens, NULL and empty texts 0. Whole texts, of any length."""
    with open(path, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            # A long text is cut at line ends, where this pattern never joins pieces but for blank runs.
            yield pd.Series([0 if t is None else sum(len(encode(p)) for p in _pieces(t)) for t in texts], dtype="int64")

    return count


def _pieces(text: str, size: int = 200_000) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        end = text.find("\n", at + size)
        while 0 <= end < len(text) - 1 and (text[end + 1].isspace() or text[end - 1].isspace()):
            end = text.find("\n", end + 1)
        if end < 0 or end == len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def letter_share(text: Column) -> Column:
    """Letters and blanks of a text as a share of its characters."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.length(text)


def text_quality(text: Column, tokens: Column) -> Column:
    """Between 0 and 1: the share of letters and blanks, less what is wrongly decoded (replacement marks, UTF-8 read as single bytes),
    times how well the tokenizer knows the text (characters a token, 4 or more being 1)."""
    broken = F.length(text) - F.length(F.regexp_replace(text, "\ufffd|[\u00c2\u00c3][\u0080-\u00bf]|\u00e2\u20ac.", ""))
    return F.greatest(letter_share(text) - 4 * broken / F.length(text), F.lit(0.0)) * F.least(F.length(text) / (4 * F.greatest(tokens, F.lit(1))), F.lit(1.0))


def sized(docs: DataFrame, seed: int = 42, tokenizer: str = TOKENIZER, size: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, key), written: documents with a text and a source, and their sampling keys.

    tokens is `size`, a column of docs, or what the tokenizer counts. key is exponential with the document's quality weight as its rate,
    -ln(u) / weight with u from a hash of id, text and seed, so that it is the same whenever a task is run again. `weight` is a column
    of docs, such as a fitted scorer's (by default text_quality); it counts as 0.1 at least, NULL too.
    """
    source = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    rows = docs.withColumns({"_source": source, "_size": F.lit(None).cast("long") if size is None else size, "_weight": F.lit(None).cast("double") if weight is None else weight})
    rows = rows.select("doc_id", F.col("_source").alias("source"), "text", F.col("_size").alias("tokens"), F.col("_weight").alias("weight")).filter((F.col("text") != "") & (F.col("source") != ""))
    if size is None:
        rows = rows.withColumn("tokens", token_counts(docs.sparkSession, tokenizer)("text"))
    if weight is None:
        rows = rows.withColumn("weight", text_quality(F.col("text"), F.col("tokens")))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), "text")), 1, 13), 16, 10).cast("double")
    u = (drawn + 0.5) / F.lit(float(2**52))
    return materialise(rows.select("doc_id", "source", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), (-F.log(u) / F.greatest("weight", F.lit(0.1))).alias("key")))


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source of targets: share, available, most (uses), budget, epochs (complete uses) and rest (tokens of the last, partial use).

    docs as from `sized`. The blend has as many tokens as all documents; a source whose share needs more than max_repeats uses
    gives all it may. Rows of targets with equal source add their weights and take the greatest max_repeats; NULL weights and
    repeats are 0.
    """
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    want = targets.filter("source is not null").groupBy(name.alias("source")).agg(F.coalesce(F.sum("target_weight"), F.lit(0.0)).alias("w"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("most"))
    sizes = materialise(docs.groupBy("source").agg(F.sum("tokens").alias("available")))
    total = sizes.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    weight = want.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    rows = want.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    rows = rows.withColumn("share", F.col("w") / F.lit(weight or 1.0)).withColumn("budget", F.col("share") * F.lit(total))
    may = F.col("most") * F.col("available")
    use = F.least(F.col("budget"), may.cast("double"))
    epochs = F.when(F.col("available") > 0, F.floor(use / F.col("available"))).otherwise(F.lit(0)).cast("long")
    return materialise(rows.select("source", "share", "available", "most", "budget", epochs.alias("epochs"), (use - epochs * F.col("available")).alias("rest")))


def blend(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used, for those used at all.

    Complete epochs take every document of the source; of the rest documents are taken by ascending key, of equals by id, as long as
    their tokens, summed up, fit. Sums go by blocks of keys, so that of a source of any size only one block is sorted.
    """
    order = F.col("key") / (F.col("key") + 1)
    sources = plan.count()
    rows = docs.join(broadcast_if_small(plan.select("source", "epochs", "rest"), sources), "source").withColumn("block", F.floor(order * KEY_BLOCKS))
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(W.partitionBy("source").orderBy("block"))
    sums = materialise(sums.select("source", "block", (upto - F.col("t")).alias("before"), upto.alias("upto"), "rest"))
    last = sums.filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).groupBy("source").agg(F.min("block").alias("last"), F.min_by("before", "block").alias("before"))
    rows = rows.join(broadcast_if_small(last, sources), "source", "left")
    edge = rows.filter(F.col("block") == F.col("last"))
    run = F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("extra", F.when(F.col("before") + run <= F.col("rest"), 1).otherwise(0))
    whole = rows.filter(F.col("last").isNull() | (F.col("block") != F.col("last"))).withColumn("extra", F.when(F.col("last").isNull() | (F.col("block") < F.col("last")), F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0))
    out = whole.unionByName(edge).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("copies"))
    return out.filter("copies > 0")


def shares(plan: DataFrame, blended: DataFrame) -> DataFrame:
    """plan with what the blend came to: used (tokens in it), reached (its share of the blend; NULL for an empty blend) and falls_short
    (all documents are in it as often as they may, and still the budget isn't reached; a source without documents does if its share is above 0)."""
    used = materialise(blended.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used")))
    total = used.agg(F.sum("used")).first()[0]
    out = plan.join(broadcast_if_small(used, plan.count()), "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    short = (F.col("used") == F.col("most") * F.col("available")) & (F.col("used") < F.col("budget"))
    return out.withColumn("reached", F.col("used") / F.lit(total).cast("double")).withColumn("falls_short", short)
