"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.leaks import leaked_items
from graphloom.queries import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an evaluation item, with the item."""
    return leaked_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
