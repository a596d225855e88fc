import random

from graphloom.operators.hierarchy import descendants, hierarchy, paths

SCHEMA = "src string, dst string, kind string, ord bigint"


def brute(rows):
    parent, nodes = {}, set()
    for src, dst, kind, order in rows:
        if not src or not dst or kind is None or kind.strip().lower() != "contains":
            continue
        nodes |= {src, dst}
        key = (order if order is not None else -(10**18), src)
        if dst not in parent or key > parent[dst]:
            parent[dst] = key
    parent = {c: p[1] for c, p in parent.items()}
    out = {}
    for v in nodes:
        seen, x = [], v
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            loop = seen[seen.index(x):]
            out[v] = (min(loop), -1 if v in loop else -2)
        else:
            out[v] = (x, len(seen))
    return out


def found(df):
    return {r.node: (r.root, r.depth) for r in df.collect()}


def test_trees_loops_and_dirt(spark):
    rnd = random.Random(5)
    rows = [(f"n{k - 1 if rnd.random() < 0.7 else rnd.randrange(k)}" if k else "root", f"n{k}", " Contains ", k) for k in range(120)]
    rows += [(f"c{(k + 1) % 7}", f"c{k}", "contains", k) for k in range(7)] + [(f"c{k}", f"d{k}", "CONTAINS", 1) for k in range(7)]
    rows += [("s", "s", "contains", 1), (None, "s", "contains", 9), ("", "q", "contains", 1), ("late", "n5", "contains", -1), ("a", "b", None, 1), ("a", "b", "calls", 2)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    tree = hierarchy(df)
    assert found(tree) == brute(rows)
    spans = {r.node: (r.root, r.entry, r.size) for r in tree.collect() if r.depth >= 0}
    below = {(r.ancestor, r.descendant) for r in descendants(tree).collect()}
    inside = {(a, b) for a, x in spans.items() for b, y in spans.items() if a != b and x[0] == y[0] and x[1] < y[1] < x[1] + x[2]}
    assert below == inside
    way = {r.node: r.path for r in paths(tree).collect()}
    assert way["n0"] == "root > n0" and way["c0"] is None


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy(df).count() == 0
    wide = spark.createDataFrame([("a", "b", "contains", 1, "x", "y")], SCHEMA + ", node string, parent string")
    assert found(hierarchy(wide)) == {"a": ("a", 0), "b": ("a", 1)}
