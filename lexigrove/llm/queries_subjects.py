"""Queries on the subjects of documents (10)."""

from pyspark.sql import functions as F

from lexigrove.llm import subjects as S
from lexigrove.session import table


def p10_found(spark, sf):
    return S.document_subjects(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects")).select("doc_id", "subject")


def p10_makeup(spark, sf):
    return p10_found(spark, sf).groupBy("subject").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p10_found, p10_makeup)}
SQL = {}
