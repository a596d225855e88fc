"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.components import connected_groups, links
from graphloom.queries import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every linked record."""
    return connected_groups(links(table(spark, folder, "candidates")))


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": """
WITH RECURSIVE l AS (SELECT DISTINCT i, j FROM candidates WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j
  AND cosine_sim IS NOT NULL AND CAST(cosine_sim AS VARCHAR) NOT ILIKE '%nan%' AND cosine_sim >= 0.8),
e AS (SELECT i AS a, j AS b FROM l UNION SELECT j, i FROM l),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y)
SELECT min(y) AS group_id, x AS record_id FROM reach GROUP BY x"""
}
