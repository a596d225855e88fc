import random

from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.operators import iterate, paths, sums
from tests.test_graph import graph


def counted_writes(monkeypatch, *modules):
    """The tables written from now on, rounds included."""
    written = []

    def counting(df, drop=()):
        written.append(df)
        return durable(df, drop)

    for m in modules:
        monkeypatch.setattr(m, "durable", counting)
    return written


def random_links(seed, n, m):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]


def test_betweenness_equals_rounds(spark, monkeypatch):
    edges = random_links(4, 50, 90) + [("n1", "n2")] * 3 + [(f"c{k}", f"c{k + 1}") for k in range(6)]
    e = spark.createDataFrame(edges, "src string, dst string").cache()
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    some = nodes.where("id < 'n3'")
    for room in (sums.VISITS, 100):  # with little room a batch is cut short
        monkeypatch.setattr(sums, "VISITS", room)
        got = [{r.id: round(r.value, 12) for r in paths.betweenness(nodes, e, s).collect()} for s in (None, some)]
        with monkeypatch.context() as m:
            m.setattr(sums, "MOST_LINKS", 10)
            want = [{r.id: round(r.value, 12) for r in paths.betweenness(nodes, e, s).collect()} for s in (None, some)]
        assert got == want and got[0] != got[1] and max(got[0].values()) > 0
    e.unpersist()


def test_betweenness_of_a_chain_takes_no_rounds(spark, monkeypatch):
    written = counted_writes(monkeypatch, paths, sums)
    e = spark.createDataFrame([(f"c{k:02d}", f"c{k + 1:02d}") for k in range(12)], "src string, dst string")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {r.id: round(r.value * 12 * 11) for r in paths.betweenness(nodes, e).collect()}
    assert got == {f"c{k:02d}": k * (12 - k) for k in range(13)}
    assert len(written) < 8


def test_fan_in_equals_closure(spark, monkeypatch):
    g = graph(spark, random_links(9, 20, 30) + [("n1", "n2")] * 3)
    got = [tuple(r) for r in iterate.transitive_fan_in(g).collect()]
    monkeypatch.setattr(sums, "MOST_LINKS", 10)
    assert [tuple(r) for r in iterate.transitive_fan_in(g).collect()] == got and got


def test_fan_in_of_a_chain_takes_no_rounds(spark, monkeypatch):
    g = graph(spark, [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(12)])
    written = counted_writes(monkeypatch, iterate, sums)
    assert {r.id: r.transitive for r in iterate.transitive_fan_in(g).collect()} == {f"c{k:02d}": k for k in range(2, 13)}
    assert len(written) < 8


def test_centrality_is_betweenness_and_reachers(spark, monkeypatch):
    e = spark.createDataFrame(sorted(set(random_links(5, 30, 50))), "src string, dst string").cache()
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {r.id: (round(r.value, 12), r.transitive) for r in paths.centrality(nodes, e).collect()}
    monkeypatch.setattr(sums, "MOST_LINKS", 10)
    assert {r.id: (round(r.value, 12), r.transitive) for r in paths.centrality(nodes, e).collect()} == got
    assert max(t for _, t in got.values()) > 10
    e.unpersist()


def test_cut_points_by_one_search(spark, monkeypatch):
    g = graph(spark, random_links(3, 40, 36) + [(f"c{k}", f"c{k + 1}") for k in range(6)])
    got = []
    for local in (False, True):
        with monkeypatch.context() as m:
            written = counted_writes(m, paths, iterate)
            got.append([tuple(r) for r in paths.articulation_points(g, 1, local).collect()])
        assert len(written) == 1
    monkeypatch.setattr(paths, "ONE_TASK", 0)
    assert [[tuple(r) for r in paths.articulation_points(g, 1, local).collect()] for local in (False, True)] == got
    assert len(got[0]) > 5 and got[0] != got[1]


def test_rank_by_one_task(spark, monkeypatch):
    g = graph(spark, random_links(6, 20, 25))
    written = counted_writes(monkeypatch, iterate)
    got = {r.id: r.rank for r in iterate.page_rank(g.symbols, g.uses, 6).collect()}
    assert len(written) == 2
    monkeypatch.setattr(iterate, "RANKED", 0)
    want = {r.id: r.rank for r in iterate.page_rank(g.symbols, g.uses, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
