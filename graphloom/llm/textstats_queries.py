"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textstats import FEATURES, document_statistics, not_prose
from graphloom.queries import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not natural prose."""
    return not_prose(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id").distinct()


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of each document."""
    stats = document_statistics(table(spark, folder, "documents"))
    return stats.select("doc_id", *[F.round(F.col("x")[k], 6).alias(name) for k, name in enumerate(FEATURES)])


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {}
