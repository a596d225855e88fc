"""Parent-child links to full hierarchies (problem 2).

1. Parents: the link of highest ``ord`` gives a child its parent.
2. Peeling: one round removes every leaf; 2^k rounds leave exactly the nodes that are reached by
   2^k parent steps from somewhere, so doubling the parent pointers peels 2^k rounds at once.
   Once a doubling removes nothing more, what is left lies on a loop (or nothing is left).
3. Euler tour: loops are cut at their nodes, which become roots. Leaf children stand directly
   behind their parent's entry and need no tour element of their own; every inner node has an
   entry and an exit. Siblings are ordered by (bucket of a hash, id), and windows run per
   (parent, bucket), so that a parent of a third of all nodes is spread over many tasks.
4. List ranking: pointer jumping over the tour elements. Each element is pointed to by at most
   one other, so its joins have no hot keys. Suffix sums give depth and entry number, the
   difference of entry and exit the size of the subtree, the end of a list its root.

A node's interval [entry, entry + size) within its root answers ancestor and descendant
questions: x is below y iff both have the same root and entry(x) falls into y's interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Durable, durable, lookup

BUCKETS = 64
#: Entries of one block that may meet in a task, as a power of two.
BLOCK = 16


def _text(column: str) -> Column:
    return F.col(f"`{column}`")


def parent_links(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(child, parent) with one row per child: the row of highest ord (then greatest src) counts.

    Kinds are compared after trimming white space and ignoring case; rows with a null or empty
    end are left out. A null ord is below all others.
    """
    same = F.lower(F.regexp_replace(_text("kind"), r"^\s+|\s+$", "")) == F.lit(kind)
    rows = edges.where(same & (_text("src") != "") & (_text("dst") != ""))
    return rows.groupBy(_text("dst").alias("child")).agg(F.max(F.struct(_text("ord").alias("ord"), _text("src").alias("src")))["src"].alias("parent"))


def _loops(parent: DataFrame) -> tuple[Durable, int]:
    """Nodes on loops by doubling, from (x, p)."""
    jump = durable(parent.select("x", F.col("p").alias("j")))
    before, rounds = -1, 0
    while True:
        left = jump.df.agg(F.count_distinct("j")).first()[0]
        if left == before or left == 0:
            break
        before = left
        step = lookup(jump.df, "j", jump.df.select(F.col("x").alias("j"), F.col("j").alias("j2")), "inner")
        jump, rounds = durable(step.select("x", F.col("j2").alias("j")), drop=(jump,)), rounds + 1
    on = durable(jump.df.select(F.col("j").alias("x")).distinct(), drop=())
    jump.drop()
    return on, left


def _loop_names(on: DataFrame, parent: DataFrame, nodes: DataFrame) -> Durable:
    """(x, loop): the smallest node name on the loop of each loop node, by doubling."""
    now = durable(on.join(parent, "x").join(nodes, "x").select("x", F.col("p").alias("j"), F.col("node").alias("loop")))
    while True:
        nxt = now.df.select(F.col("x").alias("j"), F.col("j").alias("j2"), F.col("loop").alias("loop2"))
        new = durable(now.df.join(nxt, "j").select("x", F.col("j2").alias("j"), F.least("loop", "loop2").alias("loop"), (F.col("loop2") < F.col("loop")).alias("moved")))
        moved = new.df.where("moved").limit(1).count()
        now.drop()
        now = Durable(new.spark, new.path, new.df.schema)
        now.df = new.df.select("x", "j", "loop")
        if not moved:
            return now


def _siblings(child: DataFrame) -> DataFrame:
    """(x, p, at): the place of x among the rows of p, from 0, without one task per parent."""
    hashed = child.select("x", "p", F.xxhash64("x").alias("h")).withColumn("b", F.pmod(F.shiftrightunsigned("h", 58), F.lit(BUCKETS)))
    place = hashed.withColumn("in_bucket", F.row_number().over(Window.partitionBy("p", "b").orderBy("h", "x")) - 1)
    sizes = child.groupBy("p", F.pmod(F.shiftrightunsigned(F.xxhash64("x"), 58), F.lit(BUCKETS)).alias("b")).count()
    # at most BUCKETS rows per parent here
    starts = sizes.withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "b", "start")
    return place.join(starts, ["p", "b"]).select("x", "p", (F.col("start") + F.col("in_bucket")).alias("at"))


def _rank_lists(elements: Durable) -> Durable:
    """Pointer jumping: (e, next, depth, count) with next < 0 where the list has ended.

    depth and count become the sums over the element and all that follow it; next ends as
    -(root) - 1 of the element's list.
    """
    now = elements
    while now.df.where("next >= 0").limit(1).count():
        behind = now.df.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("depth").alias("d2"), F.col("count").alias("c2"))
        active = now.df.where("next >= 0").join(behind, "next").select("e", F.col("n2").alias("next"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("count") + F.col("c2")).alias("count"))
        now = durable(now.df.where("next < 0").select("e", "next", "depth", "count").unionByName(active), drop=(now,))
    return now


def hierarchy(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(node, parent, root, depth, entry, size) for every end of a ``kind`` edge.

    depth counts edges from the root (root 0, parent null). A node on a loop has depth -1, one
    below a loop -2; for both, root is the smallest node name on that loop, and entry and size
    are null. size counts the node and all its descendants. Repeated rows change nothing, an
    empty table gives no rows, and other columns of ``edges`` are ignored.
    """
    named = durable(parent_links(edges, kind))
    names = named.df.select(F.col("child").alias("node")).unionAll(named.df.select("parent")).distinct()
    all_ends = edges.where((F.lower(F.regexp_replace(_text("kind"), r"^\s+|\s+$", "")) == F.lit(kind)) & (_text("src") != "") & (_text("dst") != "")).select(_text("src").alias("node")).distinct()
    # a parent whose every child went to another parent is still an end of an edge
    nodes = durable(names.unionAll(all_ends).distinct().withColumn("x", F.monotonically_increasing_id()))
    by_child = named.df.join(nodes.df.select(F.col("node").alias("child"), "x"), "child").select("x", F.col("parent").alias("node"))
    by_child = durable(by_child)
    parent = durable(lookup(by_child.df, "node", nodes.df.select("node", F.col("x").alias("p")), "inner").select("x", "p"), drop=(by_child, named))

    on, looped = _loops(parent.df)
    loop_names = _loop_names(on.df, parent.df, nodes.df) if looped else None
    cut = durable(parent.df.join(on.df, "x", "left_anti")) if looped else parent

    inner = durable(cut.df.groupBy("p").agg(F.count("*").alias("children")).withColumnRenamed("p", "x"))
    kids = durable(cut.df.join(inner.df.select("x", F.lit(True).alias("inner")), "x", "left"))
    leaf_at = durable(_siblings(kids.df.where("inner IS NULL").select("x", "p")))
    inner_at = durable(_siblings(kids.df.where("inner").select("x", "p")))
    leaves = durable(inner.df.join(leaf_at.df.groupBy(F.col("p").alias("x")).agg(F.count("*").alias("leaves")), "x", "left").join(inner_at.df.groupBy(F.col("p").alias("x")).agg(F.count("*").alias("inners")), "x", "left").select("x", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("inners", F.lit(0)).alias("inners")))

    # Tour elements of the inner nodes below a root: 2x is the entry of x, 2x + 1 its exit.
    joined = lookup(inner_at.df, "p", leaves.df.select(F.col("x").alias("p"), F.col("inners").alias("of")))
    placed = durable(joined.join(leaves.df, "x"))
    after = placed.df.select("p", (F.col("at") - 1).alias("at"), F.col("x").alias("sibling"))
    first = placed.df.where("at = 0").select(F.col("p").alias("x"), F.col("x").alias("first"))
    tops = placed.df.select("x").withColumn("below_top", F.lit(True))
    entries = placed.df.join(first, "x", "left").select((F.col("x") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("x") * 2 + 1).alias("next"), F.lit(1).alias("depth"), (F.col("leaves") + 1).cast("bigint").alias("count"))
    last = durable(placed.df.where("at = of - 1").select("x", "p"))
    ends = lookup(last.df, "p", tops.withColumnRenamed("x", "p"))
    to_parent = ends.select((F.col("x") * 2 + 1).alias("e"), F.when(F.col("below_top"), F.col("p") * 2 + 1).otherwise(-F.col("p") - 1).alias("next"))
    to_sibling = placed.df.join(after, ["p", "at"]).select((F.col("x") * 2 + 1).alias("e"), (F.col("sibling") * 2).alias("next"))
    exits = to_parent.unionByName(to_sibling).select("e", "next", F.lit(-1).alias("depth"), F.lit(0).cast("bigint").alias("count"))
    ranked = _rank_lists(durable(entries.unionByName(exits).select("e", "next", F.col("depth").cast("bigint").alias("depth"), "count")))

    # suffix sums to numbers from the front: the whole list of a root counts its total
    down = ranked.df.where("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("x"), (-F.col("next") - 1).alias("root"), (F.lit(1) - F.col("depth")).alias("depth"), F.col("count").alias("from_here"))
    up = ranked.df.where("e % 2 = 1").select(((F.col("e") - 1) / 2).cast("bigint").alias("x"), F.col("count").alias("behind"))
    both = durable(down.join(up, "x"))
    totals = both.df.groupBy("root").agg(F.max("from_here").alias("total"))
    roots = leaves.df.join(tops, "x", "left_anti").join(totals.withColumnRenamed("root", "x"), "x", "left")
    top_rows = roots.select("x", F.col("x").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("entry"), (F.lit(1) + F.col("leaves") + F.coalesce("total", F.lit(0))).alias("size"))
    root_info = roots.select(F.col("x").alias("root"), F.col("leaves").alias("root_leaves"), "total")
    inner_rows = lookup(both.df, "root", root_info).select("x", "root", "depth", (F.lit(1) + F.col("root_leaves") + F.col("total") - F.col("from_here")).alias("entry"), (F.col("from_here") - F.col("behind")).alias("size"))
    placed_inner = durable(top_rows.unionByName(inner_rows))
    leaf_rows = lookup(leaf_at.df, "p", placed_inner.df.select(F.col("x").alias("p"), "root", "depth", "entry")).select("x", "root", (F.col("depth") + 1).alias("depth"), (F.col("entry") + 1 + F.col("at")).alias("entry"), F.lit(1).cast("bigint").alias("size"))
    lone = nodes.df.select("x").join(cut.df.select("x"), "x", "left_anti").join(inner.df.select("x"), "x", "left_anti").select("x", F.col("x").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("entry"), F.lit(1).cast("bigint").alias("size"))
    ranks = durable(placed_inner.df.unionByName(leaf_rows).unionByName(lone), drop=(both, placed_inner, leaf_at, inner_at, kids, last, placed, ranked, leaves, inner))

    # names: of the root, of the parent, and of the loop
    root_names = nodes.df.select(F.col("x").alias("root"), F.col("node").alias("root_name"))
    parent_names = nodes.df.select(F.col("x").alias("p"), F.col("node").alias("parent"))
    full = durable(lookup(ranks.df, "root", root_names).join(nodes.df, "x").join(parent.df, "x", "left"), drop=(ranks,))
    full = lookup(full.df, "p", parent_names)
    if loop_names is None:
        return full.select("node", "parent", F.col("root_name").alias("root"), F.col("depth").cast("int").alias("depth"), "entry", "size")
    loops = loop_names.df.select(F.col("x").alias("root"), "loop")
    full = lookup(durable(full).df, "root", loops)
    looped_depth = F.when(F.col("x") == F.col("root"), -1).otherwise(-2)
    plain = F.col("loop").isNull()
    return full.select(
        "node", "parent", F.coalesce("loop", "root_name").alias("root"), F.when(plain, F.col("depth")).otherwise(looped_depth).cast("int").alias("depth"),
        F.when(plain, F.col("entry")).alias("entry"), F.when(plain, F.col("size")).alias("size"),
    )


def ancestors(tree: DataFrame, itself: bool = False) -> DataFrame:
    """(ancestor, ancestor_depth, descendant, depth) for all pairs on loop-free branches, from the entry intervals of ``hierarchy``.

    A node is below every node of its root whose interval holds its entry. Intervals are cut into aligned blocks of powers of
    two, at most two of a size, and an entry lies in one block of every size, so containment is an equality of (root, size,
    block), met exactly once. Blocks of more than 2^BLOCK entries are split by a hash of the descendant, whose ancestors are
    repeated for every part. With ``itself`` every node is its own ancestor as well. The result has one row
    per node and ancestor, so its size is the sum of all depths.
    """
    rows = durable(tree.where("depth >= 0").select("node", "root", "depth", "entry", "size"))
    top = rows.df.agg(F.max(F.col("entry") + F.col("size"))).first()[0] or 1
    levels = range(int(top).bit_length() + 1)
    parts = lambda level: 1 << max(0, level - BLOCK)
    end = F.col("entry") + F.col("size")
    blocks = []
    for level in levels:
        low, high = F.shiftright(F.col("entry") + F.lit((1 << level) - 1).cast("bigint"), level), F.shiftright(end, level)
        inside = low < high
        blocks.append(F.when(inside & (low % 2 == 1), F.struct(F.lit(level).alias("level"), low.alias("block"))))
        blocks.append(F.when(inside & (high % 2 == 1), F.struct(F.lit(level).alias("level"), (high - 1).alias("block"))))
    above = rows.df.where("size > 1").select(F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), "root", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull())).alias("b"))
    split = F.element_at(F.array(*[F.lit(parts(level)) for level in levels]), F.col("b.level") + 1)
    above = above.select("ancestor", "ancestor_depth", "root", "b.level", "b.block", F.explode(F.sequence(F.lit(0), split - 1)).alias("part"))
    places = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("entry", level).alias("block"), F.pmod(F.xxhash64("node"), F.lit(parts(level))).cast("int").alias("part")) for level in levels])
    below = rows.df.where("depth > 0").select(F.col("node").alias("descendant"), "depth", "root", F.explode(places).alias("b")).select("descendant", "depth", "root", "b.*")
    pairs = below.join(above, ["root", "level", "block", "part"]).where("ancestor_depth < depth").select("ancestor", "ancestor_depth", "descendant", "depth")
    if not itself:
        return pairs
    return pairs.unionByName(rows.df.select(F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), F.col("node").alias("descendant"), "depth"))


def paths(tree: DataFrame, separator: str = " > ") -> DataFrame:
    """(node, path): the names from the root to each node of ``hierarchy``'s rows: its ancestors in order of depth.

    Loop nodes and nodes below a loop have no path from a root and get null.
    """
    looped = tree.where("depth < 0").select("node", F.lit(None).cast("string").alias("path"))
    steps = ancestors(tree, itself=True).groupBy(F.col("descendant").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("steps"))
    return steps.select("node", F.array_join(F.transform("steps", lambda x: x["ancestor"]), separator).alias("path")).unionByName(looped)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for all pairs on loop-free branches, by intervals; ``hierarchy``'s size has their number."""
    return ancestors(tree).select("ancestor", "descendant", (F.col("depth") - F.col("ancestor_depth")).alias("distance"))
