"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.outranking import MID, TOP, best_of, latest, ranking, score_flows
from graphloom.queries import table

SCORES = {"history_score": 1.0, "structure_score": 1.0, "pagerank": 1.0, "betweenness": 1.0}


def _ranked(spark: SparkSession, folder: str, percentile: str) -> DataFrame:
    entries = table(spark, folder, "hotspot_entries").select("file", "generated_at", *SCORES)
    items = latest(entries).withColumn("repo", F.substring_index("file", "/", 1))
    return ranking(score_flows(items, "repo", "file", SCORES, percentile), "repo", "file")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three files of each repository with the greatest net flow.

    A file's percentile in a score is the share of the files not above it, so preferences are differences of positions and
    the flow over all others falls by the same amount with every position: net flow orders as the sum of positions does.
    """
    return best_of(_ranked(spark, folder, TOP), "repo", "file", "units", 3).select("repo", "file")


def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Net outranking flow (linear preference on percentiles) of every file."""
    return _ranked(spark, folder, MID).select("repo", "file", F.round("net", 6).alias("net"), F.col("position_sum").cast("bigint").alias("position_sum"))


_ITEMS = """
WITH last AS (SELECT file, history_score, structure_score, pagerank, betweenness, row_number() OVER (PARTITION BY file ORDER BY generated_at DESC NULLS LAST) AS r
  FROM hotspot_entries WHERE file IS NOT NULL),
clean AS (SELECT split_part(file, '/', 1) AS repo, file,
  CASE WHEN history_score IS NULL OR CAST(history_score AS VARCHAR) ILIKE '%nan%' THEN -1e300 ELSE history_score END AS s1,
  CASE WHEN structure_score IS NULL OR CAST(structure_score AS VARCHAR) ILIKE '%nan%' THEN -1e300 ELSE structure_score END AS s2,
  CASE WHEN pagerank IS NULL OR CAST(pagerank AS VARCHAR) ILIKE '%nan%' THEN -1e300 ELSE pagerank END AS s3,
  CASE WHEN betweenness IS NULL OR CAST(betweenness AS VARCHAR) ILIKE '%nan%' THEN -1e300 ELSE betweenness END AS s4
  FROM last WHERE r = 1),
"""
_POSITION = "rank() OVER (PARTITION BY repo ORDER BY s1 DESC) + rank() OVER (PARTITION BY repo ORDER BY s2 DESC) + rank() OVER (PARTITION BY repo ORDER BY s3 DESC) + rank() OVER (PARTITION BY repo ORDER BY s4 DESC)"
QUERIES = {"p7_found": p7_found, "p7_ranking": p7_ranking}
SQL = {
    "p7_found": _ITEMS
    + f"""
pos AS (SELECT repo, file, {_POSITION} AS total FROM clean),
top AS (SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY total, file) AS r FROM pos)
SELECT repo, file FROM top WHERE r <= 3""",
    "p7_ranking": _ITEMS
    + f"""
pos AS (SELECT repo, file, {_POSITION} AS position_sum FROM clean),
long AS (SELECT repo, file, 1 AS k, s1 AS v FROM clean UNION ALL SELECT repo, file, 2, s2 FROM clean UNION ALL SELECT repo, file, 3, s3 FROM clean UNION ALL SELECT repo, file, 4, s4 FROM clean),
pct AS (SELECT *, count(*) OVER (PARTITION BY repo, k) AS n,
  (rank() OVER (PARTITION BY repo, k ORDER BY v) - 1 + (count(*) OVER (PARTITION BY repo, k, v) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY repo, k) - 1, 1) AS p FROM long),
flow AS (SELECT a.repo, a.file, sum((a.p - b.p) / greatest(a.n - 1, 1)) AS net
  FROM pct a JOIN pct b ON a.repo = b.repo AND a.k = b.k GROUP BY a.repo, a.file)
SELECT p.repo, p.file, round(f.net, 6) + 0.0 AS net, CAST(p.position_sum AS BIGINT) AS position_sum FROM pos p JOIN flow f ON p.repo = f.repo AND p.file = f.file""",
}
