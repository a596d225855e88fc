"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import connected_groups
from graphloom.llm.neardup import similar_classes, similar_pairs, symbol_strings
from graphloom.queries import table


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbol_strings(table(spark, folder, "symbols").select("id", "category", "signature", "body_tokens"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols whose bodies (or, without a body, signatures) agree except for small edits."""
    return similar_pairs(*similar_classes(_symbols(spark, folder)))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every symbol that takes part: the class number that stands for all it is linked to, and its class's links."""
    members, similar = similar_classes(_symbols(spark, folder))
    groups = connected_groups(similar.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("record_id").alias("cls"), "group_id")
    ends = similar.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(groups, "cls", "left").join(ends, "cls", "left").select("id", F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
#: Brute force: shared windows of all pairs of a category.
SQL: dict[str, str] = {
    "p6_found": r"""
WITH t AS (SELECT DISTINCT id, 'c' || coalesce(category, chr(1)) AS part, coalesce(octet_length(body_tokens), 0) AS n, hex(body_tokens) AS body, regexp_replace(lower(signature), '\s+', '', 'g') AS sign FROM symbols WHERE id IS NOT NULL),
x AS (SELECT id, 'b' || part AS part, unnest(range(0, n - 4)) AS k, body, 1 AS of FROM t WHERE n >= 24
  UNION ALL SELECT id, 's' || part, unnest(range(0, length(sign) - 4)), sign, 0 FROM t WHERE n = 0 AND length(sign) >= 40),
w AS (SELECT DISTINCT id, part, CASE WHEN of = 1 THEN substr(body, CAST(2 * k + 1 AS BIGINT), 10) ELSE substr(body, CAST(k + 1 AS BIGINT), 5) END AS w FROM x),
z AS (SELECT id, part, count(*) AS n FROM w GROUP BY id, part),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.part, count(*) AS n FROM w a JOIN w b ON a.part = b.part AND a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3)
SELECT DISTINCT id_a, id_b FROM p JOIN z x ON x.id = id_a AND x.part = p.part JOIN z y ON y.id = id_b AND y.part = p.part WHERE p.n >= 0.70 * (x.n + y.n - p.n) - 1e-9""",
}
