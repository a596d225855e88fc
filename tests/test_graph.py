import itertools
import random

import pytest

from graphloom.operators import iterate, paths, structure
from graphloom.plans.views import build_graph

SYMBOLS = "id string, name string, file_path string, category string, kind string, properties map<string,string>"
EDGES = "src string, dst string, kind string, ord bigint"
SMALL = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("d", "e"), ("e", "f"), ("g", "d"), ("h", "h")]


def graph(spark, edges, kind="calls", names=None):
    names = names or sorted({x for e in edges for x in e[:2]})
    symbols = spark.createDataFrame([(n, n, f"p{n[0]}/{n}.go", "callable", "function", {}) for n in names], SYMBOLS)
    return build_graph(symbols, spark.createDataFrame([(a, b, kind, k) for k, (a, b) in enumerate(edges)], EDGES))


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, SMALL)


def test_page_rank(small):
    got = {r.id: r.rank for r in iterate.page_rank(small.symbols, small.uses).collect()}
    want = {"a": 0.089503, "b": 0.110799, "c": 0.128903, "d": 0.119012, "e": 0.135883, "f": 0.150226, "g": 0.034713, "h": 0.230961}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_betweenness(small):
    got = {r.id: r.value for r in paths.betweenness(small.symbols, small.uses).collect()}
    want = {"a": 0.023810, "b": 0.095238, "c": 0.166667, "d": 0.190476, "e": 0.119048, "f": 0, "g": 0, "h": 0}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_change_propagation(small):
    got = {r.id: (r.reached, r.probability) for r in paths.change_propagation(small).collect()}
    assert got == {"a": (2, 0.375), "b": (2, 0.375), "c": (2, 0.375), "d": (4, 0.34375), "e": (5, 0.2375), "f": (5, 0.2125)}


def test_components_and_cycles(small):
    assert {(r.id, r.component) for r in iterate.strong_components(small.uses).collect()} == {(x, "a") for x in "abc"}
    assert [(r.component, r.members) for r in iterate.weak_components(small).collect()] == [("a", 7), ("h", 1)]
    assert {r.id: r.transitive for r in iterate.transitive_fan_in(small).collect()} == {"a": 2, "b": 2, "c": 2, "d": 4, "e": 5, "f": 6}


def test_cut_points(spark):
    edges = [(f"l{k}", f"l{k + 1}") for k in range(3)] + [("l3", "m"), ("m", "r0")] + [(f"r{k}", f"r{k + 1}") for k in range(3)]
    got = {r.id: r.second for r in paths.articulation_points(graph(spark, edges), 3).collect()}
    assert got == {"m": 4, "l3": 3, "r0": 3}


def test_components_random(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(45)]
    names = [f"n{k}" for k in range(60)]
    group = {n: {n} for n in names}
    for a, b in edges:
        joined = group[a] | group[b]
        for x in joined:
            group[x] = joined
    g = graph(spark, edges, names=names)
    got = {r.id: r.component for r in iterate.components(g.symbols.select("id"), g.uses).collect()}
    assert got == {n: min(group[n]) for n in names}


def test_relational(spark):
    edges = [(f"x{k}", "hub") for k in range(12)] + [("hub", "y1")]
    g = graph(spark, edges)
    assert [(r.id, r.fan_in, r.fan_out) for r in structure.hubs(g).collect()] == [("hub", 12, 1)]
    assert {(r.src, r.dst, r.weight) for r in structure.dependency_weight(g).collect()} == {("px", "ph", 12), ("ph", "py", 1)}
    assert {r.id for r in structure.orphans(g).collect()} == {f"x{k}" for k in range(12)}
    groups = structure.shotgun_surgery(graph(spark, [(s, t) for t in ("t1", "t2", "t3") for s in ("a", "b")])).collect()
    assert [(r.package, r.callers, r.targets) for r in groups] == [("pt", 2, 3)]


def test_closure_matches_brute_force(spark):
    rnd = random.Random(8)
    edges = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(18)}
    reach = set(edges)
    for k, i, j in itertools.product(range(12), repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    assert {(int(r.src), int(r.dst)) for r in iterate.closure(df).collect()} == reach


def test_chains_into_loops(spark):
    from graphloom.operators.iterate import chain_depths

    parent = {"a": "b", "b": "c", "c": "d", "d": "b", "x": "a", "s": "s", "t": "s", "p": "q", "q": "r"}
    want = {}
    for n in parent:
        seen, at = [n], n
        while at in parent:
            at = parent[at]
            if at in seen:
                break
            seen.append(at)
        want[n] = (len(seen) - 1 if at not in parent else len(seen), at)
    want["r"] = (0, "r")
    got = {r.id: (r.depth, r.top) for r in chain_depths(spark.createDataFrame(list(parent.items()), "child string, parent string")).collect()}
    assert got == want
