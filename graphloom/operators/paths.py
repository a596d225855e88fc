"""Per-source path queries: betweenness, change propagation, cut points.

Betweenness of a graph that a task can hold comes from ``sums``. Otherwise queries are level-by-level DataFrames with
state keyed by (source, node), so sources spread over the cluster and no adjacency is broadcast; the
number of rounds is then the longest shortest path. The state of all sources together is what the
definition asks for (every source counts), so ``sources`` can restrict it where that is wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Durable, durable
from graphloom.operators.iterate import components, reachers
from graphloom.operators.sums import path_sums
from graphloom.plans.views import Graph

#: Undirected links that one task searches for cut points.
ONE_TASK = 1 << 21
#: How far a change travels along an edge kind (fixed values).
PROPAGATION = {"inherits": 0.9, "implements": 0.85, "overrides": 0.8, "contains": 0.7, "calls": 0.5, "references": 0.3, "decorates": 0.2}


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, value): shortest-path betweenness, directed, parallel edges multiply path counts, divided by (n-1)(n-2).

    All sources in blocks (see ``sums``), or level by level if the graph is too large for that.
    """
    links = durable(edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")))
    starts = links.df.select(F.col("src").alias("s")).distinct()
    if sources is not None:
        starts = starts.join(sources.select(F.col("id").alias("s")), "s", "left_semi")
    started = links.df.withColumn("start", F.lit(True)) if sources is None else links.df.join(starts.select(F.col("s").alias("src"), F.lit(True).alias("start")), "src", "left").withColumn("start", F.coalesce("start", F.lit(False)))
    sums = path_sums(durable(started).df)
    if sums is None:
        sums = _sums_by_level(links, starts)
    return _scaled(nodes, sums).select("id", "value")


def _scaled(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").join(sums, "id", "left").withColumn("value", F.coalesce("d", F.lit(0.0)) * scale)


def centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, value, transitive): betweenness, and how many other nodes reach a node, from the same paths. ``links``: distinct src, dst."""
    simple = durable(links.where("src <> dst").select("src", "dst", F.lit(1.0).alias("m"), F.lit(True).alias("start")))
    sums = path_sums(simple.df)
    if sums is None:
        return betweenness(nodes, links).join(reachers(links), "id", "left").select("id", "value", F.coalesce("transitive", F.lit(0)).alias("transitive"))
    return _scaled(nodes, sums).select("id", "value", F.coalesce("reachers", F.lit(0)).alias("transitive"))


def _sums_by_level(links: Durable, starts: DataFrame) -> DataFrame:
    """(id, d): dependencies of the sources (s) on each node. Forward: levels of (source, node, paths). Backward: from the deepest level up."""
    front = durable(starts.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))
    seen = durable(front.df.select("s", "v"))
    levels = [front]
    while True:
        step = front.df.withColumnRenamed("v", "src").join(links.df, "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        front = durable(step.join(seen.df, ["s", "v"], "left_anti"))
        if not front.df.limit(1).count():
            break
        seen = durable(seen.df.unionByName(front.df.select("s", "v")), drop=(seen,))
        levels.append(front)
    below, total = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].df
        if below is not None:
            up = below.df.select("s", F.col("v").alias("dst"), ((1 + F.col("dep")) / F.col("paths")).alias("per")).join(links.df, "dst")
            got = up.groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("per") * F.col("m")).alias("per"))
            here = here.join(got, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("per", F.lit(0.0))).alias("dep"))
        else:
            here = here.withColumn("dep", F.lit(0.0))
        below = durable(here)
        part = below.df.groupBy("v").agg(F.sum("dep").alias("dep"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return starts.select(F.col("s").alias("id"), F.lit(0.0).alias("d"))
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("dep").alias("d"))


def change_propagation(g: Graph, cutoff: float = 0.05) -> DataFrame:
    """(id, reached, probability): symbols that a change reaches, breadth first over reversed edges, and their mean probability.

    The first visit of a node counts: nodes of a level are visited in the order of the visits of the level before and, from
    one node, in the order of its edges (ord, then source id). Branches below ``cutoff`` end.
    """
    weight = F.coalesce(F.create_map(*[x for k, w in PROPAGATION.items() for x in (F.lit(k), F.lit(w))])[F.col("kind")], F.lit(0.3))
    links = durable(g.edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), weight.alias("w"), "ord", "kind"))
    front = durable(links.df.select(F.col("at").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(1.0).alias("p"), F.lit(0).cast("bigint").alias("pos")))
    seen = durable(front.df.select("s", "v", "p"))
    while front.df.limit(1).count():
        step = front.df.withColumnRenamed("v", "at").join(links.df, "at").withColumn("np", F.col("p") * F.col("w")).where(F.col("np") >= cutoff)
        first = step.groupBy("s", F.col("to").alias("v")).agg(F.min(F.struct("pos", "ord", "kind", F.col("np").alias("p"))).alias("x"))
        fresh = first.join(seen.df.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.col("x.p").alias("p"), F.col("x.pos").alias("a"), F.col("x.ord").alias("b"))
        place = F.row_number().over(Window.partitionBy("s").orderBy("a", "b", "v"))
        front = durable(fresh.select("s", "v", "p", place.cast("bigint").alias("pos")), drop=(front,))
        seen = durable(seen.df.unionByName(front.df.select("s", "v", "p")), drop=(seen,))
    rows = seen.df.where("s <> v").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("reached"), F.round(F.avg("p"), 6).alias("probability"))
    return rows.orderBy(F.col("reached").desc(), "id")


def _searched(local: bool):
    """Kernel: (id, second) of the cut points of undirected links, each given once."""

    def run(table: pa.Table) -> pa.Table:
        names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
        ends, n = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names.dictionary)
        one, two = ends[: len(table)], ends[len(table) :]
        out, into = np.concatenate([one, two]), np.concatenate([two, one])
        to = into[np.argsort(out, kind="stable")].tolist()
        upto = np.cumsum(np.bincount(out, minlength=n)).tolist()
        at = [0, *upto[:-1]]
        seen, low, up, size = [-1] * n, [0] * n, [-1] * n, [1] * n
        cut, most, next_most = [0] * n, [0] * n, [0] * n  # of the parts below a node that hang on it alone: all nodes, the two largest
        sizes, found, clock = [], [], 0
        for root in range(n):
            if seen[root] >= 0:
                continue
            seen[root] = low[root] = clock
            clock += 1
            members, stack = [root], [root]
            while stack:
                v = stack[-1]
                if at[v] < upto[v]:
                    w = to[at[v]]
                    at[v] += 1
                    if seen[w] < 0:
                        seen[w] = low[w] = clock
                        clock += 1
                        up[w] = v
                        members.append(w), stack.append(w)
                    elif w != up[v]:
                        low[v] = min(low[v], seen[w])
                    continue
                stack.pop()
                p = up[v]
                if p < 0:
                    continue
                size[p] += size[v]
                low[p] = min(low[p], low[v])
                if low[v] >= seen[p]:
                    cut[p] += size[v]
                    most[p], next_most[p] = sorted((most[p], next_most[p], size[v]))[:0:-1]
            for v in members:
                a, b = sorted((most[v], next_most[v], len(members) - 1 - cut[v]))[:0:-1]
                if b:
                    found.append((v, a, b, len(sizes)))
            sizes.append(len(members))
        top = sorted(range(len(sizes)), key=lambda c: -sizes[c])[:3]
        second = [b if local else sorted([a, b, *(sizes[c] for c in top if c != own)])[-2] for _, a, b, own in found]
        return pa.table({"id": names.dictionary.take(pa.array([f[0] for f in found], pa.int64())), "second": pa.array(second, pa.int64())})

    return run


def articulation_points(g: Graph, smallest: int = 5, local: bool = False) -> DataFrame:
    """(id, second): cut points of the undirected use graph whose removal leaves a second part of at least ``smallest`` nodes.

    ``second`` is the second largest component of the whole remaining graph (``local``: of the component that was cut). Up to
    ONE_TASK links one depth-first search finds all parts; beyond, for each candidate (a node of two neighbours or more) one run of
    component labelling over the graph without it; candidates run in blocks keyed by (removed node, node).
    """
    both = g.uses.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = durable(both)
    if edges.df.count() <= ONE_TASK:
        rows = edges.df.groupBy(F.lit(0).alias("all")).applyInArrow(_searched(local), "id string, second bigint")
        return rows.where(F.col("second") >= smallest).orderBy(F.col("second").desc(), "id")
    ends = edges.df.select("src").unionAll(edges.df.select("dst")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    labels = durable(components(ends.select("id"), edges.df))
    sizes = durable(labels.df.groupBy("component").agg(F.count("*").alias("n")))
    # only a component that is large enough to leave two parts is looked into, removed node by removed node
    wide = sizes.df.where(F.col("n") > (smallest if local else 1))
    cand = durable(ends.where("degree >= 2").join(labels.df, "id").join(wide, "component").select(F.col("id").alias("gone"), "component"))
    placed = edges.df.join(labels.df.withColumnRenamed("id", "src"), "src")
    work = placed.join(cand.df, "component").where("src <> gone AND dst <> gone")
    key = lambda a, b: F.concat(a, F.lit("\x01"), b)
    pairs = durable(work.select(key(F.col("gone"), F.col("src")).alias("src"), key(F.col("gone"), F.col("dst")).alias("dst")))
    nodes = labels.df.join(cand.df, "component").where("id <> gone").select(key(F.col("gone"), F.col("id")).alias("id"))
    parts = components(nodes, pairs.df).groupBy(F.substring_index("component", "\x01", 1).alias("gone"), "component").agg(F.count("*").alias("n"))
    ranked = durable(parts.withColumn("r", F.row_number().over(Window.partitionBy("gone").orderBy(F.col("n").desc(), "component"))))
    split = ranked.df.groupBy("gone").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("b")).where("b IS NOT NULL")
    if local:
        rows = split.select(F.col("gone").alias("id"), F.col("b").alias("second"))
    else:
        top = sizes.df.where("n > 1").orderBy(F.col("n").desc(), "component").limit(3)
        home = split.join(cand.df, "gone").join(F.broadcast(top.groupBy().agg(F.collect_list(F.struct("n", "component")).alias("top"))))
        others = F.filter("top", lambda x: x["component"] != F.col("component"))
        all_sizes = F.reverse(F.array_sort(F.concat(F.array(F.col("a"), F.col("b")), F.transform(others, lambda x: x["n"]))))
        rows = home.select(F.col("gone").alias("id"), F.element_at(all_sizes, 2).alias("second"))
    return rows.where(F.col("second") >= smallest).orderBy(F.col("second").desc(), "id")
