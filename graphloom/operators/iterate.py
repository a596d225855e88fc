"""Iterative graph queries as DataFrame loops; every round is a written table, never a growing lineage.

Nothing is collected but counts. Rounds follow the longest shortest path (reachability, depth) or its
logarithm (pointer doubling), and each round shuffles only the frontier where the algorithm allows it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import durable, lookup
from graphloom.operators.sums import path_sums
from graphloom.plans.views import Graph

#: Nodes and links that one task ranks; larger graphs take a written table a round.
RANKED = 1 << 19


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named by their smallest id.

    Minimum labels travel along edges and along label pointers (hooking and shortcutting), so the
    number of rounds is about the logarithm of the diameter. ``nodes``: id; ``edges``: src, dst.
    """
    half = durable(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    now = durable(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = half.df.join(now.df.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hooked = durable(now.df.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low")))
        # the label's own label: a root that was hooked takes its whole tree along
        roots = hooked.df.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("via"))
        pulled = durable(hooked.df.join(roots, "id", "left").select("id", "label", F.least("low", F.coalesce("via", "low")).alias("low")))
        jump = pulled.df.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = durable(lookup(pulled.df, "low", jump).select("id", F.col("label").alias("old"), F.least("low", "next").alias("label")), drop=(hooked,))
        moved = new.df.where("old <> label").limit(1).count()
        pulled.drop(), now.drop()
        now = durable(new.df.select("id", "label"), drop=(new,))
        if not moved:
            return now.df.withColumnRenamed("label", "component")


def weak_components(g: Graph) -> DataFrame:
    """(component, members): sizes of the weak components; no rows if there is one at most."""
    labels = components(g.symbols.select("id"), g.edges)
    sizes = durable(labels.groupBy("component").agg(F.count("*").alias("members")))
    many = sizes.df.limit(2).count() > 1
    return sizes.df.where(F.lit(many)).orderBy(F.col("members").desc(), "component")


def reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(id): everything reached from ``starts`` (id) along ``links`` (src, dst), starts included; breadth first."""
    links = durable(links.select("src", "dst").distinct())
    seen = durable(starts.select("id").distinct())
    front = seen
    while front.df.limit(1).count():
        step = links.df.join(front.df.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = durable(step.join(seen.df, "id", "left_anti"))
        seen = durable(seen.df.unionByName(front.df))
    return seen.df


def closure(links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst): all pairs with a path of one edge or more, by semi-naive evaluation.

    The result itself can be quadratic in the nodes of a dense component; callers bound it by condensing first.
    """
    links = durable(links.select("src", "dst").distinct())
    first = links.df if starts is None else links.df.join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    seen = durable(first)
    front = seen
    while front.df.limit(1).count():
        step = front.df.withColumnRenamed("dst", "mid").join(links.df.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        front = durable(step.join(seen.df, ["src", "dst"], "left_anti"))
        seen = durable(seen.df.unionByName(front.df))
    return seen.df


def strong_components(links: DataFrame) -> DataFrame:
    """(id, component) of nodes on cycles through other nodes; component is the smallest id.

    Trimming first removes, round by round, what has no edge in or no edge out; the rest is coloured
    by the smallest id that reaches a node and, backwards within a colour, that it reaches. A
    colour's backward part is a component; the others go on.
    """
    left = durable(links.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        while True:  # trim
            before = left.df.count()
            ok = left.df.select(F.col("src").alias("id")).intersect(left.df.select(F.col("dst").alias("id")))
            ok = durable(ok)
            left = durable(left.df.join(ok.df.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.df.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            if left.df.count() == before or not before:
                break
        if not left.df.limit(1).count():
            break
        colour = _spread_minimum(left.df)
        same = durable(left.df.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", "a"))
        roots = colour.where("id = label").select("id")
        back = reach(roots, same.df.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        part = durable(colour.join(back, "id", "left_semi").select("id", F.col("label").alias("component")))
        found = part.df if found is None else found.unionByName(part.df)
        left = durable(left.df.join(part.df.select(F.col("id").alias("src")), "src", "left_anti").join(part.df.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return links.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "component").select("id", "component")


def _spread_minimum(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id from which each node is reached, itself included."""
    now = durable(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("label", F.col("id")))
    while True:
        low = edges.join(now.df.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("low"))
        new = durable(now.df.join(low, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label")))
        moved = new.df.where("old <> label").limit(1).count()
        now = durable(new.df.select("id", "label"), drop=(now, new))
        if not moved:
            return now.df


def _ranked(rounds: int, damping: float):
    """Kernel: (id, rank) of nodes (w null: src is a node) and weighted links."""

    def run(table: pa.Table) -> pa.Table:
        is_node = pc.is_null(table["w"])
        names, links = table.filter(is_node)["src"].combine_chunks(), table.filter(pc.invert(is_node))
        src, dst = (pc.index_in(links[c], names).to_numpy() for c in ("src", "dst"))
        w, n = links["w"].to_numpy(), len(names)
        dangling = np.bincount(src, minlength=n) == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            rank = (1 - damping) / n + damping * rank[dangling].sum() / n + damping * np.bincount(dst, rank[src] * w, n)
        return pa.table({"id": names, "rank": rank})

    return run


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """(id, rank) after exactly ``rounds`` rounds; parallel edges count; dangling mass is spread over all nodes."""
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = durable(edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("w")))
    dangling = durable(nodes.select("id").join(out.select(F.col("src").alias("id"), "degree"), "id", "left").select("id", F.col("degree").isNull().alias("dangling")))
    n = dangling.df.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    if n + weighted.df.count() <= RANKED:
        every = dangling.df.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("w")).unionByName(weighted.df)
        return every.groupBy(F.lit(0).alias("all")).applyInArrow(_ranked(rounds, damping), "id string, rank double")
    now = durable(dangling.df.select("id", "dangling", F.lit(1.0 / n).alias("rank")))
    for k in range(rounds):
        lost = now.df.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = weighted.df.join(now.df.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        now = durable(now.df.join(got, "id", "left").select("id", "dangling", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), drop=(now,))
    return now.df.select("id", "rank")


def chain_depths(parents: DataFrame) -> DataFrame:
    """(id, depth, top): steps from each child of (child, parent) to the last node it can reach, cut at the first revisit.

    A chain that runs into a loop ends with the step back to a node it has been at: its depth is the number of distinct nodes it
    visits, and top is that node. Loops are cut at their nodes, so that chains above them are trees as well.
    """
    from graphloom.operators.hierarchy import hierarchy

    links = durable(parents.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("contains").alias("kind"), F.lit(0).cast("bigint").alias("ord")))
    tree = durable(hierarchy(links.df).select("node", "depth", "root"))
    plain = tree.df.where("depth >= 0").select(F.col("node").alias("id"), "depth", F.col("root").alias("top"))
    if not tree.df.where("depth < 0").limit(1).count():
        return plain
    on_loop = durable(tree.df.where("depth = -1").select("node", "root"))
    sizes = on_loop.df.groupBy("root").agg(F.count("*").cast("int").alias("around"))
    around = durable(on_loop.df.join(sizes, "root").select(F.col("node").alias("top"), "around"))
    looped = around.df.select(F.col("top").alias("id"), F.col("around").alias("depth"), "top")
    above = hierarchy(links.df.join(on_loop.df.select(F.col("node").alias("dst")), "dst", "left_anti")).where("depth > 0").select(F.col("node").alias("id"), "depth", F.col("root").alias("top"))
    return plain.unionByName(looped).unionByName(above.join(around.df, "top").select("id", (F.col("depth") + F.col("around")).alias("depth"), "top"))


def deep_inheritance(g: Graph, threshold: int = 5) -> DataFrame:
    """Types at the end of an inheritance chain of at least ``threshold`` steps; one that runs into a loop ends at the first revisit."""
    chain = chain_depths(g.last_parent(["inherits", "implements"]).where("child <> parent"))
    return chain.where(F.col("depth") >= threshold).orderBy(F.col("depth").desc(), "id")


def containment_depth(g: Graph, threshold: int = 3) -> DataFrame:
    """Types and callables nested at least ``threshold`` deep under a container without parent, by breadth-first levels."""
    kinds = durable(g.symbols.select("id", "category"))
    kids = g.contains.join(kinds.df.where("category IN ('type', 'callable')").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    kids = durable(kids)
    roots = g.contains.select(F.col("src").alias("id")).distinct().join(g.contains.select(F.col("dst").alias("id")), "id", "left_anti")
    seen = durable(roots.select("id", F.lit(0).alias("depth")))
    front, depth = seen, 0
    while front.df.limit(1).count():
        depth += 1
        step = kids.df.join(front.df.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = durable(step.join(seen.df.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        seen = durable(seen.df.unionByName(front.df))
    return seen.df.where(F.col("depth") >= threshold).orderBy(F.col("depth").desc(), "id")


def entry_points(g: Graph) -> DataFrame:
    """(id): symbols named main, app or init, and callables and types of main., app., index. and server. files."""
    base = F.regexp_extract("file_path", r"([^/]*)$", 1)
    named = F.lower("name").isin("main", "app", "init")
    placed = base.rlike(r"^(main|app|index|server)\.") & F.col("category").isin("callable", "type")
    return g.symbols.where(named | placed).select("id")


def unreachable(g: Graph, starts: DataFrame | None = None) -> DataFrame:
    """Symbols but modules that no entry point reaches over uses, children and parents; none without entry points."""
    first = durable(entry_points(g) if starts is None else starts)
    parent = g.last_parent(["contains"]).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    links = g.edges.select("src", "dst").unionByName(parent)
    any_start = first.df.limit(1).count() > 0
    seen = reach(first.df, links)
    return g.symbols.where(F.lit(any_start) & (F.col("category") != "module")).join(seen, "id", "left_anti").select("id", "kind").orderBy("id")


def reachers(links: DataFrame) -> DataFrame:
    """(id, transitive): how many other nodes reach a node, where any does; by blocks of sources (see ``sums``) or, in a large graph, the closure."""
    simple = durable(links.where("src <> dst").select("src", "dst", F.lit(1.0).alias("m"), F.lit(True).alias("start")).distinct()).df
    sums = path_sums(simple, paths=False)
    if sums is not None:
        return sums.select("id", F.col("reachers").alias("transitive"))
    pairs = closure(simple).where("src <> dst")
    return pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("transitive"))


def transitive_fan_in(g: Graph) -> DataFrame:
    """(id, fan_in, transitive): distinct nodes that reach a symbol, where they are more than its edges in."""
    uses = durable(g.uses.select("src", "dst")).df
    fan_in = uses.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    rows = fan_in.join(reachers(uses), "id").where(F.col("transitive") > F.col("fan_in"))
    return rows.orderBy(F.col("transitive").desc(), "id")
