"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.forest import forest_neighbours, usable_vectors
from graphloom.queries import table

LENGTHS = {"ann": 128, "mellow": 128, "tarn": 192}
NEIGHBOURS = 5


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(space, id, vec) of all usable vectors and embeddings; repeated rows are left in.

    The space of a vector is ann/<category>, that of an embedding its model, in lower case. Of a
    response whose lists are null or of unequal length nothing is used.
    """
    ann = table(spark, folder, "ann_vectors").where(F.col("id").isNotNull() & usable_vectors("vec", LENGTHS["ann"]))
    ann = ann.select(F.concat(F.lit("ann/"), F.coalesce("category", F.lit(""))).alias("space"), "id", "vec")
    raw = table(spark, folder, "embed_responses").where("entry_ids IS NOT NULL AND embeddings IS NOT NULL AND size(entry_ids) = size(embeddings)")
    pairs = raw.select(F.lower(F.trim("model")).alias("space"), F.explode(F.arrays_zip("entry_ids", "embeddings")).alias("x"))
    pairs = pairs.select("space", F.col("x.entry_ids").alias("id"), F.col("x.embeddings").alias("vec"))
    lengths = F.when(F.col("space") == "mellow", LENGTHS["mellow"]).when(F.col("space") == "tarn", LENGTHS["tarn"])
    pairs = pairs.where(F.col("id").isNotNull() & usable_vectors("vec") & (F.size("vec") == lengths))
    return ann.unionByName(pairs)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the five most similar of the other, from a similarity of 0.70."""
    near = forest_neighbours(vectors(spark, folder), NEIGHBOURS, at_least=0.70)
    pair = near.select(F.substring_index("space", "/", 1).alias("space"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return pair.distinct()


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every vector, whatever their similarity."""
    near = forest_neighbours(vectors(spark, folder), NEIGHBOURS)
    return near.select("space", "id", "other", "similarity", "place")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
#: Brute force over all pairs of a space.
_ALL = """
WITH raw AS (
  SELECT 'ann/' || coalesce(category, '') AS space, id, vec, 128 AS n FROM ann_vectors
  UNION ALL SELECT lower(trim(model)), unnest(entry_ids), unnest(embeddings), CASE lower(trim(model)) WHEN 'mellow' THEN 128 WHEN 'tarn' THEN 192 END
  FROM embed_responses WHERE entry_ids IS NOT NULL AND embeddings IS NOT NULL AND len(entry_ids) = len(embeddings)),
v AS (SELECT space, id, any_value(vec)::DOUBLE[] AS vec FROM raw WHERE id IS NOT NULL AND vec IS NOT NULL AND len(vec) = n
  AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY space, id),
s AS (SELECT a.space, a.id, b.id AS other, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM v a JOIN v b ON a.space = b.space AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY space, id ORDER BY similarity DESC, other) AS place FROM s)
"""
SQL: dict[str, str] = {
    "p1_found": _ALL + "SELECT DISTINCT split_part(space, '/', 1) AS space, least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE place <= 5 AND similarity >= 0.70",
    "p1_neighbours": _ALL + "SELECT space, id, other, similarity, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5",
}
