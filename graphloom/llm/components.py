"""Groups of records from pairwise links (problem 4).

Reduction: every round takes an independent set of vertices of degree one and two out of the
graph. A vertex of degree one is stripped; one of degree two is bypassed by an edge between its
neighbours, which is the contraction step of parallel list ranking (an independent set of the
chain is spliced out, about a third of it a round). What is left (every vertex has three
neighbours or more, or nothing is left) is the core; it is solved by alternating large-star and
small-star steps. Labels are then handed back in reverse order of removal.

No step gathers the neighbours of a vertex: degrees, the two neighbours of a low vertex and the
independence test are all aggregates with map-side combining, so a hub that takes part in a
third of all links costs no more than any other vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import Durable, durable, lookup, usable


def links(pairs: DataFrame, left: str = "i", right: str = "j", score: str = "cosine_sim", at_least: float = 0.8) -> DataFrame:
    """Distinct undirected links (u < v) of scored pairs.

    Null ends, self pairs, null or NaN scores and scores below ``at_least`` link nothing; one
    sufficient row is enough, whatever other rows say of the same pair.
    """
    a, b, s = F.col(f"`{left}`"), F.col(f"`{right}`"), F.col(f"`{score}`").cast("double")
    good = a.isNotNull() & b.isNotNull() & (a != b) & usable(s) & (s >= F.lit(at_least))
    return pairs.where(good).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _low(edges: DataFrame) -> DataFrame:
    """Vertices of degree one or two with their neighbours a <= b."""
    half = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    return (
        half.groupBy("x")
        .agg(F.count("*").alias("degree"), F.min("y").alias("a"), F.max("y").alias("b"))
        .where("degree <= 2")
    )


def _independent(low: DataFrame, turn: int) -> DataFrame:
    """The low vertices whose priority is below that of every low neighbour."""
    ranked = low.withColumn("rank", F.struct(F.xxhash64("x", F.lit(turn)), F.col("x")))
    told = ranked.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x"), F.col("rank").alias("other"))
    nothing = F.lit(None)
    both = ranked.select("x", "rank", "a", "b", nothing.cast(ranked.schema["rank"].dataType).alias("other")).unionByName(
        told.select("x", nothing.cast(ranked.schema["rank"].dataType).alias("rank"), nothing.cast("bigint").alias("a"), nothing.cast("bigint").alias("b"), "other")
    )
    best = both.groupBy("x").agg(F.max("rank").alias("rank"), F.max("a").alias("a"), F.max("b").alias("b"), F.min("other").alias("other"))
    return best.where("rank IS NOT NULL AND (other IS NULL OR rank < other)").select("x", "a", "b")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of the removed vertices, plus the bypasses; keyed by whole edges."""
    dead = gone.select("x", F.explode(F.array("a", "b")).alias("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    bypass = gone.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    marked = (
        edges.select("u", "v", F.lit(0).alias("dead"))
        .unionAll(dead.select("u", "v", F.lit(1)))
        .unionAll(bypass.select("u", "v", F.lit(0)))
    )
    return marked.groupBy("u", "v").agg(F.max("dead").alias("dead")).where("dead = 0").select("u", "v")


def _solve_core(core: Durable) -> DataFrame:
    """(x, label) for each vertex of the core by large-star and small-star steps until stable."""
    edges, sums = core, None
    while True:
        now = edges.df
        near = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = durable(near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        # large-star: every larger neighbour y of x is linked to the smallest vertex around x
        far = durable(near.where("y > x"))
        large = durable(lookup(far.df, "x", low.df).select(F.least("m", "y").alias("u"), F.greatest("m", "y").alias("v")).where("u < v").distinct(), drop=())
        far.drop(), low.drop()
        # small-star: x and its smaller neighbours are linked to the smallest of them
        base = durable(large.df.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")))
        joined = lookup(large.df.withColumnRenamed("v", "x"), "x", base.df)
        pairs = joined.select(F.least("m", "u").alias("u"), F.greatest("m", "u").alias("v")).where("u < v").unionAll(base.df.select(F.col("m").alias("u"), F.col("x").alias("v")))
        new = durable(pairs.distinct())
        large.drop(), base.drop()
        # unsigned sums over row hashes tell a fixed point without comparing tables
        seen = new.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if edges is not core:
            edges.drop()
        edges = new
        if sums == tuple(seen):
            break
        sums = tuple(seen)
    stars = edges.df
    return stars.select(F.col("v").alias("x"), F.col("u").alias("label")).unionAll(stars.select(F.col("u").alias("x"), F.col("u").alias("label")).distinct())


def connected_groups(edges: DataFrame, worthwhile: float = 0.05) -> DataFrame:
    """(group_id, record_id) for every end of ``edges`` (u, v: bigint, u < v, distinct).

    group_id is the smallest record of the group. Rounds of reduction go on while they remove at
    least ``worthwhile`` of the edges; the rest is the core. An empty input gives no rows.
    """
    now = durable(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))
    first, size, turns = now, now.df.count(), []
    while size:
        gone = durable(_independent(_low(now.df), len(turns)))
        left = durable(_without(now.df, gone.df))
        turns.append(gone)
        if now is not first:
            now.drop()
        now, before = left, size
        size = now.df.count()
        if before - size < worthwhile * before:
            break
    labels = durable(_solve_core(now)) if size else None
    # What was removed hangs on a vertex that was still there: label it from the last turn back.
    for gone in reversed(turns):
        own = gone.df.select("x", F.col("a").alias("key"))
        if labels is None:
            found = own.select("x", F.col("key").alias("label")).unionAll(own.select(F.col("key").alias("x"), F.col("key").alias("label")).distinct())
            labels = durable(found)
            continue
        joined = lookup(own, "key", labels.df.select(F.col("x").alias("key"), "label"))
        # a vertex that only this turn touched and nothing later labelled is the root of its own group
        roots = joined.where("label IS NULL").select(F.col("key").alias("x"), F.col("key").alias("label")).distinct()
        fresh = joined.select("x", F.coalesce("label", "key").alias("label"))
        labels = durable(labels.df.unionByName(fresh).unionByName(roots), drop=(labels,))
    if labels is None:
        return edges.select(F.col("u").cast("bigint").alias("group_id"), F.col("v").cast("bigint").alias("record_id")).limit(0)
    for old in (*turns, now, first):
        old.drop()
    # labels are one vertex per group, not always its smallest: a group-wide minimum settles it
    least = labels.df.groupBy("label").agg(F.min("x").alias("group_id"))
    return lookup(labels.df, "label", least).select("group_id", F.col("x").alias("record_id"))
