import random

from graphloom.plans import types
from graphloom.sinks import documents

BLOCK = "file_path string, section string, ord long, line string"


def rows_of(sizes):
    out = []
    for name, s, e in sizes:
        out += [(name, "symbols", k - 1, f"s{k:04}") for k in range(s)] + [(name, "edges", k, f"e{k:04}") for k in range(e)]
    return out


def filled(s, e, most):
    """One part after another, line by line."""
    symbols, edges = [f"s{k:04}" for k in range(s)], [f"e{k:04}" for k in range(e)]
    if 1 + s + (2 + e if e else 0) <= most:
        return [["[symbols]", *symbols, *(["", "[edges]", *edges] if e else [])]]
    parts = []
    while symbols or edges:
        part = ["[symbols]"]
        while symbols and len(part) < most:
            part.append(symbols.pop(0))
        if edges and len(part) + 2 < most:
            part += ["", "[edges]"]
            while edges and len(part) < most:
                part.append(edges.pop(0))
        parts.append(part)
    return parts


def test_tree_parts(spark):
    rnd = random.Random(4)
    sizes = [(f"d/f{k}.c", rnd.randrange(1, 40), rnd.choice([0, 0, 1, rnd.randrange(40)])) for k in range(60)] + [("x.c", 9, 7), ("y.c", 10, 1), ("z.c", 7, 3), ("w.c", 6, 1)]
    df = spark.createDataFrame(rows_of(sizes), BLOCK)
    got = {}
    for r in documents.tree_documents(df, most=10).collect():
        got.setdefault((r.document, r.part), {})[r.place] = r.line
    want = {(name + ".map", n): dict(enumerate(part)) for name, s, e in sizes for n, part in enumerate(filled(s, e, 10))}
    assert got == want


def test_inline_and_reader(spark):
    blocks = spark.createDataFrame([("b.c", "symbols", -1, "## b.c"), ("b.c", "symbols", 0, "S2 x"), ("a.c", "symbols", -1, "## a.c"), ("a.c", "symbols", 3, "S1 y"), ("b.c", "edges", 1, "S2 --calls--> S1, S1")], BLOCK)
    errors = spark.createDataFrame([("z.c", None), ("y.c", "bad"), (None, "x"), ("y.c", "bad")], "file_path string, reason string")
    doc = documents.inline_document(blocks, errors)
    lines = [r.line for r in doc.orderBy("place").collect()]
    assert lines == ["[symbols]", "## a.c", "S1 y", "## b.c", "S2 x", "", "[edges]", "S2 --calls--> S1, S1", "", "[errors]", "- y.c: bad", "- y.c: bad", "- z.c: "]
    read = {(r.section, r.file_path, r.line) for r in documents.read_document(doc.selectExpr("'d' AS document", "place", "line")).collect()}
    assert read == {("symbols", "a.c", "S1 y"), ("symbols", "b.c", "S2 x"), ("edges", None, "S2 --calls--> S1, S1"), ("errors", None, "- y.c: bad"), ("errors", None, "- z.c: ")}
    nothing = spark.createDataFrame([], BLOCK)
    assert [r.line for r in documents.inline_document(nothing).collect()] == ["[symbols]"]
    assert documents.tree_documents(nothing).count() == 0


def test_report_lines(spark):
    entry = spark.createDataFrame([("a/b.c", 0.5, None, float("nan"), 3, None, 2, 0.1, 0.25, None)], "file string, score double, history_score double, structure_score double, commits long, churn long, transitive_in long, pagerank double, betweenness double, last_changed timestamp")
    assert documents.hotspot_lines(entry).first().line == "score=0.500 history=0.000 structure=0.000 commits=3 churn=0 transitive_fan_in=2 pagerank=0.100000 betweenness=0.250000 last_changed=- | a/b.c"
    pairs = spark.createDataFrame([(80, 0.913, "x::f", "y::g"), (70, None, "x::f", "z::h")], "similarity int, cosine double, left string, right string")
    assert {r.line for r in documents.duplicate_lines(pairs).collect()} == {"similarity:80%  cosine:0.91  x::f <-> y::g", "similarity:70%  x::f <-> z::h"}


def test_type_positions():
    typed = lambda s, own="me": [t for t, named in types.pieces(s, own) if named]
    assert typed("f(a: List<Item, Map<K, V>>, b: Other) -> Result, x") == ["List", "Item", "Map", "K", "V", "Other", "Result"]
    assert typed("me(x: me, a > b)") == [] and typed("") == []
    assert "".join(t for t, _ in types.pieces("f(a: B)\n->  \u00e9", "f")) == "f(a: B)\n->  \u00e9"


def test_types_by_distance(spark):
    schema = "gid string, sid string, file_path string, name string, scoped_name string, category string, signature string, ord long"
    rows = [("p/a.ts::f", "S1", "p/a.ts", "f", None, "callable", "f(x: T) -> U", 1), ("p/b.ts::T", "S2", "p/b.ts", "T", None, "type", None, 1), ("q/c.ts::T", "S3", "q/c.ts", "T", None, "type", "T<T>", 1)]
    got = {r.gid: r.signature for r in types.typed_signatures(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"p/a.ts::f": "f(x: S2) -> U", "p/b.ts::T": None, "q/c.ts::T": "T<T>"}


def test_ordinals_and_history(spark):
    names = spark.createDataFrame([("f", f"n{k}", k) for k in range(300)] + [("f", "n3", 900)], "file_path string, name string, ord long")
    got = {r.name: r.ordinal for r in types.name_ordinals(names).collect()}
    assert got["n0"] == 1 and got["n3"] == 4 and got["n255"] == 0 and got["n256"] == 1
    history = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "file string, n int")
    files = spark.createDataFrame([("a",), ("a",), (None,)], "path string")
    assert [r.n for r in types.only_current(history, files).collect()] == [1]
    assert types.without_edges(history).count() == 0
