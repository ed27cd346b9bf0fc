"""Session helpers: tables, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides are held under this many rows unless a caller proves another bound.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def settle(spark: SparkSession) -> None:
    """Unions aren't joined partition by partition: their sides may be cut differently while a query runs (adaptive execution), and then fail to match."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one already set on the context.

    Only a session without either (tests, notebooks on one machine) gets a folder of its own.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexigrove-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there; a storage fault raises."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _forget(since: int = 0) -> None:
    for spark, path in _written[since:]:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass
    del _written[since:]


atexit.register(_forget)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what materialise wrote inside it, so that long sessions don't fill the shared folder. Results must be written before;
    what is built to stay (an index) belongs outside."""
    since = len(_written)
    try:
        yield
    finally:
        _forget(since)


def own_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of the scope around it, or of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/lexigrove-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back. It is deleted at the end of the scope around it, or of the session.

    Cuts lineage like checkpoint(), survives the loss of executors, and is
    columnar and compressed, so that later passes prune columns.
    """
    spark = df.sparkSession
    settle(spark)
    path = own_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes now a table that materialise gave and nothing will read again, for the space it takes."""
    folder = next(iter(df.inputFiles()), "").rpartition("/")[0].rpartition("/")[2]
    for spark, path in [x for x in _written if folder and x[1].endswith(f"/{folder}")]:
        remove(spark, path)
        _written.remove((spark, path))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when the counted rows stay under the limit; else the plain side of a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def skew_safe_lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], weight: str, total: int) -> DataFrame:
    """rows joined with table (written, unique by keys), however often a key occurs in rows.

    A table of at most BROADCAST_ROWS is broadcast. Of a larger one, keys whose weight (about their number of rows) exceeds
    total / BROADCAST_ROWS, where total is the sum of weights, are fewer than BROADCAST_ROWS: those are broadcast; the rest, none of which is hot,
    is joined by a shuffle, in which rows of hot keys are dealt out by the task that they come from.
    """
    keys = [keys] if isinstance(keys, str) else keys
    columns = [c for c in table.columns if c not in keys]
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys).select(*rows.columns, *columns)
    floor = max(1, total // BROADCAST_ROWS)
    hot = F.broadcast(table.filter(F.col(weight) > floor).select(*keys, F.struct(*columns).alias("_hot")))
    rest = table.filter(F.col(weight) <= floor).select(*keys, F.lit(0).alias("_deal"), F.struct(*columns).alias("_rest"))
    dealt = rows.join(hot, keys, "left").withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.spark_partition_id() + 1).otherwise(0))
    out = dealt.join(rest, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_rest")).filter("_found is not null")
    return out.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of `row`, a DataFrame of exactly one row (an aggregate without groups)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")
