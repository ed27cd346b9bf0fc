"""Queries on web pages (7)."""

from pyspark.sql import functions as F

from lexigrove.llm import boilerplate as B
from lexigrove.session import table


def p7_found(spark, sf):
    return B.article_lines(table(spark, sf, "parsed_documents")).select("docno", "line_no")


def p7_kept(spark, sf):
    return p7_found(spark, sf).groupBy("docno").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


QUERIES = {f.__name__: f for f in (p7_found, p7_kept)}
SQL = {}
