"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.packing import fill_report, pack_texts
from graphloom.queries import table


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every document (or piece of one longer than 2,048 tokens)."""
    return pack_texts(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and the share of their capacity that is filled."""
    return fill_report(p8_pack(spark, folder))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
