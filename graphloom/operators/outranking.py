"""One ranking from several differently scaled scores (problem 7).

Outranking net flow: per score, item a is preferred to item b of the same group by an amount that
depends only on their percentiles, so no score wins by unit or spread. The flows are sums over
all other items, got exactly from sorted prefix sums over the distinct values of a group (with
their multiplicities), never from pairs:

    P(a, b) = max(0, pct(a) - pct(b))    flow+ = n_below * pct - sum of pct below,
                                         flow- = sum of pct above - n_above * pct

The percentile of an item counts the items below it and half of its ties (``MID``), or all items that
are not above it (``TOP``: competition ranks). Both are kept in whole units, so flows are exact.

The histogram of (group, score, value) is sorted by ranges over the cluster: partition totals
give every partition its offset, so a group with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import durable


def latest(entries: DataFrame, key: str = "file", at: str = "generated_at") -> DataFrame:
    """One row per non-null key: the latest by ``at`` (null is earliest), ties by all other columns' hash."""
    columns = entries.columns
    whole = F.struct(F.col(f"`{at}`").alias("_at"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_h"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    best = entries.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(whole).alias("r"))
    return best.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


MID, TOP = "mid", "top"
HOT_SHARE = 512


def score_flows(items: DataFrame, group: str, item: str, scores: dict[str, float], percentile: str = MID) -> DataFrame:
    """(group, item, score, above, below, positive, negative, net, units) per item and score.

    ``items``: one row per (group, item); ``scores``: column -> weight. Null and NaN are below all
    numbers and equal to each other; 0.0 and -0.0 are equal. above and below count the other items
    strictly greater and smaller. positive, negative and net are the weighted linear-preference
    flows divided by the number of other items (0 for a group of one). units is the unweighted net flow as a whole
    number: percentiles counted in half items and summed over all other items (exact for groups of up to 10^9 items).
    Empty input gives no rows.
    """
    names = list(scores)
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(float("-inf"))) + F.lit(0.0)
    bottom = lambda c: F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
    long = items.select(
        F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("it"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.when(bottom(n), 0).otherwise(1).alias("num"), value(n).alias("v")) for n in names])).alias("s"),
    ).select("g", "it", "s.score", "s.num", "s.v")
    long = durable(long)
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    histogram = long.df.groupBy("g", "score", "num", "v").count()
    ranged = durable(histogram.repartitionByRange(parts, "g", "score", "num", "v").withColumn("part", F.spark_partition_id()))
    ahead = lambda *k: Window.partitionBy("g", "score", *k).orderBy("num", "v").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.df.withColumn("before", F.coalesce(F.sum("count").over(ahead("part")), F.lit(0)))
    offsets = ranged.df.groupBy("g", "score", "part").agg(F.sum("count").alias("rows"))
    earlier = Window.partitionBy("g", "score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy("g", "score")))
    ranks = inside.join(offsets.select("g", "score", "part", "offset", "n"), ["g", "score", "part"]).select(
        "g", "score", "num", "v", "count", "n", "part", (F.col("offset") + F.col("before")).alias("below"), (F.col("n") - F.col("offset") - F.col("before") - F.col("count")).alias("above"))
    level = 2 * F.col("below") + F.col("count") - 1 if percentile == MID else 2 * (F.col("n") - 1 - F.col("above"))
    ranks = durable(ranks.withColumn("level", level))
    # second prefix pass: sums of levels below
    weighted = F.col("level") * F.col("count")
    inside = ranks.df.withColumn("w_before", F.coalesce(F.sum(weighted).over(ahead("part")), F.lit(0)))
    sums = ranks.df.groupBy("g", "score", "part").agg(F.sum(weighted).alias("w"))
    sums = sums.withColumn("w_offset", F.coalesce(F.sum("w").over(earlier), F.lit(0))).withColumn("w_all", F.sum("w").over(Window.partitionBy("g", "score"))).select("g", "score", "part", "w_offset", "w_all")
    low = F.col("w_offset") + F.col("w_before")
    weight = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(scores[n])))])[F.col("score")]
    others = F.greatest(F.col("n") - 1, F.lit(1))
    up = F.col("below") * F.col("level") - low
    down = F.col("w_all") - low - weighted - F.col("above") * F.col("level")
    flows = durable(inside.join(sums, ["g", "score", "part"]).select(
        "g", "score", "num", "v", "count", "below", "above", (weight * up / 2 / others / others).alias("positive"), (weight * down / 2 / others / others).alias("negative"), (up - down).alias("units")), drop=(ranks, ranged))
    # a hot value (a third of all files may score 0) is a hot join key: at most HOT_SHARE values hold that share of the rows
    keys = ["g", "score", "num", "v"]
    hot = flows.df.where(F.col("count") > F.lit(max(10_000, long.df.count() // HOT_SHARE)))
    if hot.limit(1).count():
        marked = long.df.join(F.broadcast(hot), keys, "left")
        rest = marked.where("below IS NULL").select(*keys, "it").join(flows.df, keys)
        out = marked.where("below IS NOT NULL").unionByName(rest)
    else:
        out = long.df.join(flows.df, keys)
    return out.select(F.col("g").alias(group), F.col("it").alias(item), "score", "above", "below", "positive", "negative", (F.col("positive") - F.col("negative")).alias("net"), "units")


def ranking(flows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, net, units, position_sum): net flow over all scores, the same unweighted in whole units, and the sum of 1 + items above."""
    return flows.groupBy(group, item).agg(F.sum("net").alias("net"), F.sum("units").alias("units"), F.sum(F.col("above") + 1).alias("position_sum"))


def best_of(ranked: DataFrame, group: str, item: str, by: str, k: int) -> DataFrame:
    """The k rows of each group with the greatest ``by`` (ties: smaller item), pre-cut per bucket.

    Every bucket of a group keeps its own k best before the group is looked at as a whole, so no
    task holds an unbounded group.
    """
    bucketed = ranked.withColumn("_b", F.pmod(F.xxhash64(item), F.lit(64)))
    cut = bucketed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(F.col(by).desc(), item))).where(F.col("_r") <= k)
    final = cut.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(by).desc(), item))).where(F.col("_r") <= k)
    return final.drop("_b", "_r")
