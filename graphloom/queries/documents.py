"""Queries of the documents, type names and small pipeline steps, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.operators import similarity
from graphloom.operators.outranking import latest
from graphloom.plans import resolve, types
from graphloom.queries import table
from graphloom.queries.graph import _NAMED, _named, coupling
from graphloom.queries.graph import SQL as _GRAPH_SQL
from graphloom.sinks import documents

MOST = 40


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all files; an edge belongs to the file of its source's first symbol row, its ends are ids."""
    named = durable(_named(spark, folder)).df
    symbols = durable(named.join(resolve.short_ids(named), ["file_path", "ord"])).df
    home = table(spark, folder, "symbols").where("id <> '' AND file_path <> ''").groupBy(F.col("id").alias("src")).agg(F.min("file_path").alias("file_path"))
    edges = table(spark, folder, "edges").where("src <> '' AND dst <> '' AND kind IS NOT NULL").select("src", F.lower(F.trim("kind")).alias("kind"), "dst", "ord")
    return durable(documents.block_lines(symbols, edges.join(home, "src"))).df


def inline_document(spark: SparkSession, folder: str) -> DataFrame:
    """The whole graph as one document."""
    return documents.inline_document(_blocks(spark, folder), table(spark, folder, "parse_errors"))


def tree_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document per source file, in parts of 40 lines."""
    return documents.tree_documents(_blocks(spark, folder), most=MOST)


def document_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Content lines of the documents read back, counted per section."""
    rows = tree_documents(spark, folder).select(F.concat_ws("#", "document", "part").alias("document"), "place", "line")
    return documents.read_document(rows).groupBy("section").agg(F.count("*").alias("lines"))


def error_section(spark: SparkSession, folder: str) -> DataFrame:
    return documents.error_lines(table(spark, folder, "parse_errors")).select("line")


def hotspot_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the latest entry of every file."""
    columns = ("file", "score", "history_score", "structure_score", "commits", "churn", "transitive_in", "pagerank", "betweenness", "last_changed", "generated_at")
    return documents.hotspot_lines(latest(table(spark, folder, "hotspot_entries").select(*columns)))


def coupling_report(spark: SparkSession, folder: str) -> DataFrame:
    return documents.coupling_lines(coupling(spark, folder)).select("line")


def typed_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures with short ids in the places of type names."""
    named = durable(_named(spark, folder)).df
    return types.typed_signatures(named.join(resolve.short_ids(named), ["file_path", "ord"]))


def name_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return types.name_ordinals(_named(spark, folder))


def current_history(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the history that still exist."""
    return types.only_current(table(spark, folder, "hotspot_entries").where("file IS NOT NULL").select("file").distinct(), table(spark, folder, "source_files"))


def pipeline_counts(spark: SparkSession, folder: str) -> DataFrame:
    return types.pipeline_counts(*[table(spark, folder, t) for t in ("source_files", "symbols", "edges", "parse_errors")])


def no_edges(spark: SparkSession, folder: str) -> DataFrame:
    return types.without_edges(table(spark, folder, "edges"))


def semantic_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected pairs of vectors of which one is among the five nearest of the other within a category, from a cosine of 0.80."""
    v = F.col("vec")
    good = v.isNotNull() & (F.size(v) == 128) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = table(spark, folder, "ann_vectors").where(F.col("id").isNotNull() & F.col("category").isNotNull() & good).groupBy("id", "category").agg(F.first("vec").alias("vec"))
    near = similarity.nearest_of_all(rows, 5, 0.8 - 1e-6)
    pair = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return pair.distinct()


QUERIES = {
    f.__name__: f
    for f in (inline_document, tree_documents, document_reader, error_section, hotspot_report, coupling_report, typed_signatures, name_ordinals, current_history, pipeline_counts, no_edges, semantic_candidates)
}
_LINES = _GRAPH_SQL["symbol_lines"].replace("SELECT file_path, ord, concat_ws", ", sl AS (SELECT file_path, ord, concat_ws") + """),
home AS (SELECT id AS src, min(file_path) AS file_path FROM symbols WHERE id <> '' AND file_path <> '' GROUP BY id),
el AS (SELECT h.file_path, min(e.ord) AS ord, e.src || ' --' || lower(trim(e.kind)) || '--> ' || string_agg(e.dst, ', ' ORDER BY e.ord, e.dst) AS line
  FROM edges e JOIN home h ON h.src = e.src WHERE e.src <> '' AND e.dst <> '' AND e.kind IS NOT NULL GROUP BY h.file_path, e.src, lower(trim(e.kind))),
bl AS (SELECT file_path, 1 AS s, -1 AS ord, '## ' || file_path AS line FROM (SELECT DISTINCT file_path FROM sl) UNION ALL SELECT file_path, 1, ord, line FROM sl UNION ALL SELECT file_path, 2, ord, line FROM el)
"""
SQL: dict[str, str] = {
    "inline_document": _LINES + """
, er AS (SELECT file_path, 3 AS s, 0 AS ord, '- ' || file_path || ': ' || coalesce(reason, '') AS line FROM parse_errors WHERE file_path IS NOT NULL),
al AS (SELECT * FROM bl UNION ALL SELECT * FROM er),
hd AS (SELECT s, unnest(CASE WHEN s = 1 THEN [0] ELSE [-1, 0] END) AS p FROM (SELECT DISTINCT s FROM al UNION SELECT 1)),
ev AS (SELECT s, 1 AS p, file_path, ord, line FROM al UNION ALL SELECT s, p, '', -2, CASE WHEN p = -1 THEN '' ELSE '[' || ['symbols', 'edges', 'errors'][s] || ']' END FROM hd)
SELECT CAST(row_number() OVER (ORDER BY s, p, file_path, ord, line) - 1 AS BIGINT) AS place, line FROM ev""",
    "document_reader": _LINES + " SELECT CASE WHEN s = 1 THEN 'symbols' ELSE 'edges' END AS section, count(*) AS lines FROM bl WHERE line NOT LIKE '## %' GROUP BY s",
    "error_section": "SELECT '- ' || file_path || ': ' || coalesce(reason, '') AS line FROM parse_errors WHERE file_path IS NOT NULL",
    "coupling_report": _GRAPH_SQL["coupling"].replace('SELECT "left", "right", n, round(n * 1.0 / least(a.commits, b.commits), 6) AS strength', """SELECT printf('strength=%.3f cochanges=%d %s <-> %s', round(n * 1.0 / least(a.commits, b.commits), 6), n, "left", "right") AS line"""),
    "name_ordinals": _NAMED + """, f AS (SELECT file_path, name, min(ord) AS o FROM s GROUP BY 1, 2)
SELECT file_path, name, CAST(row_number() OVER (PARTITION BY file_path ORDER BY o, name) % 256 AS INTEGER) AS ordinal FROM f""",
    "current_history": "SELECT DISTINCT file FROM hotspot_entries WHERE file IN (SELECT path FROM source_files WHERE path IS NOT NULL)",
    "pipeline_counts": "SELECT (SELECT count(*) FROM source_files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM parse_errors) AS errors",
    "no_edges": "SELECT * FROM edges WHERE false",
    "semantic_candidates": """
WITH v AS (SELECT id, category, any_value(vec)::DOUBLE[] AS vec FROM ann_vectors WHERE id IS NOT NULL AND category IS NOT NULL AND len(vec) = 128
  AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY id, category),
c AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.category = b.category AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, other) AS k FROM c WHERE s >= 0.8 - 1e-6)
SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM r WHERE k <= 5""",
}
