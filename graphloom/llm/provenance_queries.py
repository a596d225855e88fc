"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.provenance import not_handwritten, vendored_edits
from graphloom.queries import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not hand-written source of their repository."""
    return p3_kinds(spark, folder).select("path")


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Why each of them is not."""
    return not_handwritten(table(spark, folder, "source_files"), table(spark, folder, "scanner_extensions"))


def p3_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold most lines of a third-party file, with that file."""
    return vendored_edits(table(spark, folder, "source_files"), table(spark, folder, "scanner_extensions"))


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p3_edits": p3_edits}
SQL: dict[str, str] = {}
