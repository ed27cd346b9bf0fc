"""Result lines, as columns and as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trec_run(results: DataFrame, query: str, run: str) -> DataFrame:
    """(rank, line): `query Q0 docno rank score run` for ranked results with ext_id; a top-k result, so one window is small."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("ext_id"))
    rows = results.withColumn("rank", F.row_number().over(order))
    return rows.select("rank", F.concat_ws(" ", F.lit(query), F.lit("Q0"), "ext_id", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(run)).alias("line"))


def stream_lines(pool: DataFrame) -> DataFrame:
    """`stream id, entity, score, day, model` by tabs."""
    return pool.select(F.concat_ws("\t", "stream_id", "target_id", F.col("score").cast("string"), "dir_day", "model").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def inex_run(results: DataFrame, paths: DataFrame, query: str, run: str) -> DataFrame:
    """Element results as XML lines, with the path of each."""
    rows = results.join(paths, ["doc_id", "begin", "end", "score"])
    return rows.select(F.format_string("<result topic=\"%s\" run=\"%s\"><file>%s</file><path>%s</path><rsv>%.6f</rsv></result>", F.lit(query), F.lit(run), F.col("doc_id").cast("string"), "path", "score").alias("line"))
