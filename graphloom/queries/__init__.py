"""Registry of the core queries: name -> function of (spark, folder), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def core_queries() -> dict[str, Query]:
    from graphloom.queries import documents, graph, hierarchy, outranking

    return {**hierarchy.QUERIES, **outranking.QUERIES, **graph.QUERIES, **documents.QUERIES}


def core_sql() -> dict[str, str]:
    from graphloom.queries import documents, graph, hierarchy, outranking

    return {**hierarchy.SQL, **outranking.SQL, **graph.SQL, **documents.SQL}
