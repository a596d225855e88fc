import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.functions import tokens as T
from graphloom.operators import history as H
from graphloom.plans import resolve
from graphloom.sinks import reports
from graphloom.sources import extract, scan


def test_history_window(spark):
    now = dt.datetime(2024, 1, 1)
    commits = spark.createDataFrame([("c1", now - dt.timedelta(days=100), 1), ("c2", now - dt.timedelta(days=10), 1), ("c3", now - dt.timedelta(hours=1), 1)], "commit_id string, ts timestamp, n_parents int")
    files = spark.createDataFrame([(c, p, 1, 0) for c, ps in (("c1", "ab"), ("c2", "ab"), ("c3", "axy")) for p in ps], "commit_id string, path string, additions int, deletions int")
    window = H.commit_window(commits, files, max_files=2)
    assert tuple(H.commit_counters(window).first()) == (3, 2, 0, 1)
    rows = H.touched(window, files)
    m = {r.path: r for r in H.file_metrics(rows, F.lit(now)).collect()}
    assert m["a"].commits == 2 and m["a"].last_changed == now - dt.timedelta(days=10)
    assert abs(m["a"].recency_score - (0.925875 + 0.462937)) < 1e-5
    pairs = H.co_changes(rows)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]


def test_hotspots(spark):
    metrics = spark.createDataFrame([("api", 5, 20, 0, 2.0), ("service", 12, 140, 0, 8.0), ("util", 2, 5, 0, 1.0)], "path string, commits long, additions long, deletions long, recency_score double")
    shape = spark.createDataFrame([("api", 0.212766, 0.0, 0), ("service", 0.574468, 0.0, 2), ("util", 0.212766, 0.0, 0)], "path string, pagerank double, betweenness double, transitive long")
    got = [(r.file, round(r.history, 6), round(r.structure, 6), round(r.score, 6)) for r in H.hotspots(metrics, shape).collect()]
    assert got == [("service", 1.0, 0.75, 0.875), ("api", 0.579673, 0.148148, 0.332775), ("util", 0.344465, 0.148148, 0.197748)]


def test_look_back():
    assert [H.look_back_days(x) for x in ("90d", "2w", "12mo", "1y")] == [90, 14, 360, 365]
    with pytest.raises(ValueError):
        H.look_back_days("0d")


def symbols(spark, rows):
    df = spark.createDataFrame([(f, n, "", "callable", k) for k, (f, n) in enumerate(rows)], "file_path string, name string, scoped_name string, category string, ord int")
    return resolve.global_ids(df)


@pytest.mark.parametrize(
    ("files", "where", "module", "target"),
    [
        (["src/api/utils.go", "lib/models/helper.go"], "src/api/handler.go", None, "src/api/utils.go::H"),
        (["lib/deep/nested/utils.go"], "src/api/handler.go", None, "lib/deep/nested/utils.go::H"),
        (["pkg/beta/logger.go", "pkg/alpha/logger.go"], "src/main.go", None, "pkg/alpha/logger.go::H"),
        ([], "src/app.go", None, "src/app.go::H"),
        (["src/api/utils/user.go", "src/models/user.go"], "src/api/handler.go", "models", "src/models/user.go::H"),
        (["src/helpers/format.go", "lib/format.go"], "src/app.go", "nonexistent.module", "src/helpers/format.go::H"),
        (["folder1/ModuleA.ts", "folder2/ModuleA.ts"], "folder2/ModuleC.ts", "./ModuleA", "folder2/ModuleA.ts::H"),
        (["pkg1/models.py", "pkg2/models.py"], "pkg1/app.py", ".models", "pkg1/models.py::H"),
    ],
)
def test_resolution(spark, files, where, module, target):
    syms = symbols(spark, [(f, "H") for f in files] + [("other.go", "x")])
    refs = spark.createDataFrame([(where, "H")], "file_path string, name string")
    imports = spark.createDataFrame([(where, "H", "elsewhere.entirely", 1), (where, "H", module, 2)], "file_path string, name string, module string, ord int") if module else None
    row = resolve.nearest_definitions(refs, syms, imports).first()
    assert row.target == target and row.resolved == bool(files)


@pytest.mark.parametrize(
    ("hints", "calls", "added"),
    [
        ([("handler", "my")], [("main", "handler")], {("main", "my")}),
        ([("y", "x"), ("x", "my")], [("caller", "y")], {("caller", "x"), ("caller", "my")}),
        ([("x", "y"), ("y", "x")], [("caller", "x")], {("caller", "y")}),
        ([], [("a", "b")], set()),
    ],
)
def test_aliases(spark, hints, calls, added):
    h = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(hints)], "src string, dst string, ord int")
    c = spark.createDataFrame(calls, "src string, dst string")
    assert {tuple(r) for r in resolve.resolve_aliases(c, h).collect()} == added


def test_ids(spark):
    syms = symbols(spark, [("a.py", "f"), ("a.py", "f"), ("b.py", "g")])
    assert {r.gid for r in syms.collect()} == {"a.py::f", "a.py::f#1", "b.py::g"}
    assert {(r.file_path, r.sid) for r in resolve.short_ids(syms).collect()} == {("a.py", "S1"), ("a.py", "S2"), ("b.py", "S3")}


def test_fuzzy_hash():
    assert T.fuzzy_hash(bytes([1, 2, 3, 4])) == "2:8c32d3:8ab2d3:8a82"
    assert T.fuzzy_hash(bytes([1, 5, 0x12, 0x13, 5])) == "2:8c409240:f840:f840"
    assert T.fuzzy_hash(bytes(range(1, 41))).startswith("2:8c32e2da1ae292bafa92a29adaa2f27afaf2a25a17:")
    assert T.fuzzy_hash(b"\x01\x02") == "" and T.fuzzy_hash(None) == ""
    assert T.fnv1a(b"struct") == 0x92C2BE20
    assert T.structural(bytes([0x46, 9, 0x13, 1, 2, 3, 0x40, 1, 2, 3, 4, 0x05, 0x44, 1, 9, 9, 9, 9, 0x01])) == bytes([0x13, 0x40, 0x05, 0x44, 0x01])


def test_similarities(spark):
    a, b = T.fuzzy_hash(bytes(range(1, 41))), T.fuzzy_hash(bytes(x for x in range(1, 41) if x != 20))
    df = spark.createDataFrame([(a, b, b"\x01\x02\x03\x04", b"\x01\x09\x03\x08"), ("", a, b"", b""), (a, a, b"", b"\x01")], "x string, y string, p binary, q binary")
    got = df.select(T.fuzzy_similarity(F.col("x"), F.col("y")), T.edit_similarity(F.col("p"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(96, 50), (-1, 100), (100, 0)]


def test_sources(spark):
    paths = ["a/x.py", "a/test_x.py", "node_modules/y.js", "a/y.spec.ts", "tests/z.go", "b/w.JS", "b/out/gen.go", "b/XTest.java", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    ext = spark.createDataFrame([(".py", "python"), (".js", "javascript"), (".ts", "typescript"), (".go", "go"), (".java", "java")], "ext string, language string")
    assert {r.path for r in scan.select_sources(files, ext, ["out/"]).collect()} == {"a/x.py"}
    text = spark.createDataFrame([("l1\nl2\nl3",)], "t string")
    assert text.select(scan.source_slice(F.col("t"), F.lit(2), F.lit(3))).first()[0] == "l2\nl3"


def test_extraction():
    code = "import os\nfrom a.b import c\n\nclass A(B):\n    def f(self, x):\n        g(x)\n        return 1\n\nX = 2\n"
    syms, edges = extract.extract("python", "p.py", code)
    assert [(s[3], s[4], s[5], s[7]) for s in syms] == [("A", "type", "class", 4), ("A.f", "callable", "method", 5), ("X", "value", "variable", 9)]
    kinds = {(e[2], e[3], e[4]) for e in edges}
    assert {("A", "A.f", "contains"), ("A", "B", "inherits"), ("A.f", "g", "calls"), ("c", "a.b", "imports")} <= kinds


def test_sinks(spark, tmp_path):
    tokens = spark.createDataFrame([("callable", 5), ("f", 9), ("type", 1)], "token string, count long")
    assert [tuple(r) for r in reports.dictionary(tokens).collect()] == [("d0", "callable"), ("d1", "type")]
    many = [(f"t{k:03}" if k % 3 else f"t{k:03}"[:3] + "y" * (k % 2), k % 5) for k in range(130)] + [("x", 9), ("zz", 3), (None, 2)]
    many = list({t: (t, n) for t, n in many}.values())
    want, n = [], 0
    for token, count in sorted(x for x in many if x[0] is not None):
        if (len(token) - len(f"d{n}")) * count > 0:
            want.append((f"d{n}", token))
            n += 1
    assert sorted(tuple(r) for r in reports.dictionary(spark.createDataFrame(many, "token string, count long")).collect()) == sorted(want)
    blocks = spark.createDataFrame([("a", 300), ("b", 300), ("c", 100)], "file_path string, lines int")
    assert {r.file_path: r.part for r in reports.flat_blocks(blocks).collect()} == {"a": 0, "b": 1, "c": 1}
    sizes = [400, 300, 300, 90, 7, 700, 1, 1, 494, 1, 496, 1] + [(k * 37) % 90 + 1 for k in range(150)]
    part, held, want = 0, 1, {}
    for k, n in enumerate(sizes):
        if held > 1 and held + n + 2 > 500:
            part, held = part + 1, 1
        held += n
        want[f"f{k:03}"] = part
    many = spark.createDataFrame([(f"f{k:03}", n) for k, n in enumerate(sizes)], "file_path string, lines int")
    assert {r.file_path: r.part for r in reports.flat_blocks(many).collect()} == want
    (tmp_path / "old.map").write_text("x")
    with pytest.raises(FileExistsError):
        reports.guard_output(str(tmp_path), ".map")
    reports.guard_output(str(tmp_path), ".map", clean=True)
    assert not list(tmp_path.iterdir())
    page = reports.html_page(spark.createDataFrame([("</script>",)], "id string"), spark.createDataFrame([], "src string, dst string"))
    assert page.count("</script>") == 1


def test_nearest_definition_without_pairs(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e//b", "./a", "e/b/c/d"]
    place = lambda k: (rnd.choice(folders) + f"/f{k}.go").lstrip("/")
    syms = spark.createDataFrame([(f"g{rnd.randrange(10**6):06d}", place(k), rnd.choice("xyz"), None, k) for k in range(25)], "gid string, file_path string, name string, scoped_name string, ord long").cache()
    refs = spark.createDataFrame([(place(100 + k), rnd.choice("xyzw")) for k in range(40)], "file_path string, name string").distinct().cache()
    pairs = refs.join(syms.select("name", "gid", F.col("file_path").alias("there")), "name")
    far = resolve.path_distance(resolve.folder_of(F.col("file_path")), resolve.folder_of(F.col("there")))
    want = {(r.file_path, r.name): r.gid for r in pairs.groupBy("file_path", "name").agg(F.min(F.struct(far.alias("far"), "gid"))["gid"].alias("gid")).collect()}

    def fail(*_):
        raise AssertionError("every definition of a name was looked at")

    monkeypatch.setattr(resolve, "path_distance", fail)
    got = {(r.file_path, r.name): r.target for r in resolve.nearest_definitions(refs, syms).where("resolved").collect()}
    assert got == want and len(set(want.values())) > 5
