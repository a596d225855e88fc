from graphloom.llm import provenance


def test_many_edited_versions(spark):
    line = lambda k: f"    let v{k} = g(x, {k * 7 % 11});\n"
    code = lambda own, lines=range(20): "function f(x) {\n" + "".join(f"    h({own}, {k});\n" if k == own else line(k) for k in lines) + "    return x;\n}\n"
    files = [("r0/vendor/lib/a.js", code(-1))] + [(f"r{k}/src/a.js", code(k)) for k in range(1, 13)]
    # a version with lines of its own, one that holds too little, and another third-party file that no one holds
    files += [("q/long.js", code(13) + "".join(f"more({k}, 'own');\n" for k in range(80))), ("q/half.js", code(14, range(11))), ("q/vendor/b.js", "".join(f"other({k});\n" for k in range(30)))]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    ext = spark.createDataFrame([(".js", "javascript")], "ext string, language string")
    rows = provenance.examined_files(df, ext).collect()
    theirs, ours = ([r for r in rows if (r.kind == "third-party") == f] for f in (True, False))
    want = {}
    for r in ours:
        share, source = max((len(set(r.lines) & set(o.lines)) / len(o.lines), o.path) for o in theirs)
        if share >= 0.8:
            want[r.path] = (source, round(share, 6))
    got = {r.path: (r.source, r.share) for r in provenance.vendored_edits(df, ext).collect()}
    assert got == want and set(got) == {p for p, _ in files[1:14]}


def test_short_copies(spark):
    files = [(f"r{k}/a{k}.js", "// of " + str(k) + "\nlet a = f(1);\n") for k in range(3)] + [(f"r{k}/c.js", f"// only a comment {k}\n") for k in range(3)]
    files += [("r0/two.js", "let b = f(2);\n"), ("r1/two.js", "let b = f(2);\n"), ("r2/two.js", "let b = f('2');\n")]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    ext = spark.createDataFrame([(".js", "javascript")], "ext string, language string")
    assert {r.path for r in provenance.not_handwritten(df, ext).collect()} == {f"r{k}/a{k}.js" for k in range(3)}


def test_edits_are_found_by_the_index(spark):
    body = lambda own: "function f(x) {\n" + "".join(f"    h{chr(97 + k)}({own if k == 3 else k});\n" for k in range(20)) + "    return x;\n}\n"
    # one in a vendor folder and two edited copies elsewhere make three repositories; of the other program there are only two
    files = [("a/vendor/l.js", body("aa")), ("b/src/m.js", body("bb")), ("c/src/n.js", body("cc"))]
    files += [("a/vendor/z.js", body("1").replace("h", "g")), ("d/z.js", body("2").replace("h", "g")), ("e/own.js", "let x = 1;\nlet y = 2;\nlet z = 3;\nlet w = 4;\n")]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    ext = spark.createDataFrame([(".js", "javascript")], "ext string, language string")
    named = lambda c: {r.path for r in provenance.not_handwritten(df, ext, c).collect()}
    assert named(0.8) == {"a/vendor/l.js", "b/src/m.js", "c/src/n.js", "a/vendor/z.js"}
    assert named(1.0) == {"a/vendor/l.js", "a/vendor/z.js"}
