import math

from graphloom.operators.outranking import TOP, best_of, latest, ranking, score_flows

ROWS = [("r", f"f{k}", [3.0, None, float("nan"), 0.0, -0.0, 3.0, float("inf")][k], [k * 1.0, 5.0, 5.0, 5.0, None, 0.0, 1e9][k]) for k in range(7)] + [("one", "x", 1.0, 2.0)]


def position(rows, at):
    value = lambda r: -math.inf if r[at] is None or math.isnan(r[at]) else r[at]
    rank = lambda r: (0 if r[at] is None or math.isnan(r[at]) else 1, value(r) + 0.0)
    return {(r[0], r[1]): 1 + sum(rank(o) > rank(r) for o in rows if o[0] == r[0]) for r in rows}


def test_positions_and_flows(spark):
    df = spark.createDataFrame(ROWS, "repo string, file string, a double, b double")
    flows = score_flows(df, "repo", "file", {"a": 1.0, "b": 2.0})
    a, b = position(ROWS, 2), position(ROWS, 3)
    got = {(r.repo, r.file): r for r in ranking(flows, "repo", "file").collect()}
    assert {k: r.position_sum for k, r in got.items()} == {k: a[k] + b[k] for k in a}
    assert abs(sum(r.net for r in got.values())) < 1e-9
    by_position = ranking(score_flows(df, "repo", "file", {"a": 1.0, "b": 1.0}, TOP), "repo", "file")
    units = {(r.repo, r.file): r.units for r in by_position.collect()}
    for score, at in (("a", a), ("b", b)):
        one = {(r.repo, r.file): r.units for r in score_flows(df, "repo", "file", {score: 1.0}, TOP).collect()}
        assert one == {k: sum(2 * (at[o] - at[k]) for o in at if o[0] == k[0]) for k in at}
    assert sum(units.values()) == 0
    top = best_of(by_position, "repo", "file", "units", 2).collect()
    want = sorted(a, key=lambda k: (k[0], a[k] + b[k], k[1]))
    assert {(r.repo, r.file) for r in top} == {k for n in ("r", "one") for k in [x for x in want if x[0] == n][:2]}


def test_latest_and_empty(spark):
    df = spark.createDataFrame([("f", 1, 1.0), ("f", 3, 2.0), ("f", 2, 9.0), (None, 1, 1.0), ("g", None, 5.0), ("g", None, 5.0)], "file string, generated_at int, a double")
    assert {(r.file, r.a) for r in latest(df).collect()} == {("f", 2.0), ("g", 5.0)}
    empty = spark.createDataFrame([], "repo string, file string, a double")
    assert score_flows(empty, "repo", "file", {"a": 1.0}).count() == 0
