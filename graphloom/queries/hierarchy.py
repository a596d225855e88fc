"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.common import durable
from graphloom.operators.hierarchy import descendants, hierarchy, paths
from graphloom.queries import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of each end of a containment edge."""
    return hierarchy(table(spark, folder, "edges")).select("node", "root", "depth")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path from the root to each node, and the size of its subtree."""
    tree = durable(hierarchy(table(spark, folder, "edges"))).df
    return tree.select("node", "size").join(paths(tree), "node")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All (ancestor, descendant, distance) on loop-free branches."""
    return descendants(durable(hierarchy(table(spark, folder, "edges"))).df)


_PARENTS = r"""
WITH RECURSIVE c AS (
  SELECT src, dst, ord FROM edges
  WHERE lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) = 'contains' AND src <> '' AND dst <> ''),
par AS (SELECT dst AS child, src AS parent FROM (
  SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ord DESC NULLS LAST, src DESC) AS r FROM c) WHERE r = 1),
nodes AS (SELECT src AS node FROM c UNION SELECT dst FROM c),
reach AS (SELECT child AS node, parent AS anc FROM par
  UNION SELECT r.node, p.parent FROM reach r JOIN par p ON p.child = r.anc),
loops AS (SELECT node FROM reach WHERE node = anc),
loop_of AS (SELECT l.node, min(r.anc) AS loop_root FROM loops l JOIN reach r ON r.node = l.node GROUP BY l.node),
"""

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}
SQL = {
    "p2_found": _PARENTS
    + """
below AS (SELECT r.node, min(lo.loop_root) AS loop_root FROM reach r JOIN loop_of lo ON lo.node = r.anc GROUP BY r.node),
tree AS (SELECT n.node, count(r.anc) AS depth, min(CASE WHEN p.child IS NULL THEN r.anc END) AS top
  FROM nodes n LEFT JOIN reach r ON r.node = n.node LEFT JOIN par p ON p.child = r.anc GROUP BY n.node)
SELECT t.node, coalesce(lo.loop_root, b.loop_root, t.top, t.node) AS root,
  CAST(CASE WHEN lo.node IS NOT NULL THEN -1 WHEN b.node IS NOT NULL THEN -2 ELSE t.depth END AS INTEGER) AS depth
FROM tree t LEFT JOIN loop_of lo ON lo.node = t.node LEFT JOIN below b ON b.node = t.node""",
    "p2_descendants": _PARENTS
    + """
bad AS (SELECT DISTINCT r.node FROM reach r JOIN loops l ON l.node = r.anc),
ok AS (SELECT * FROM reach WHERE node NOT IN (SELECT node FROM bad)),
deep AS (SELECT node, count(*) AS d FROM ok GROUP BY node)
SELECT o.anc AS ancestor, o.node AS descendant, CAST(d.d - coalesce(a.d, 0) AS INTEGER) AS distance
FROM ok o JOIN deep d ON d.node = o.node LEFT JOIN deep a ON a.node = o.anc""",
}
SQL["p2_paths"] = (
    _PARENTS
    + """
bad AS (SELECT DISTINCT r.node FROM reach r JOIN loops l ON l.node = r.anc),
deep AS (SELECT node, count(*) AS d FROM reach GROUP BY node),
sizes AS (SELECT anc AS node, count(*) + 1 AS size FROM reach GROUP BY anc),
walk AS (SELECT r.node, string_agg(r.anc, ' > ' ORDER BY coalesce(d.d, 0)) || ' > ' || r.node AS path
  FROM reach r LEFT JOIN deep d ON d.node = r.anc WHERE r.node NOT IN (SELECT node FROM bad) GROUP BY r.node)
SELECT n.node, CASE WHEN b.node IS NULL THEN coalesce(s.size, 1) END AS size,
  CASE WHEN b.node IS NULL THEN coalesce(w.path, n.node) END AS path
FROM nodes n LEFT JOIN bad b ON b.node = n.node LEFT JOIN sizes s ON s.node = n.node LEFT JOIN walk w ON w.node = n.node"""
)
