import itertools
import random

import numpy as np
import pytest

from graphloom.llm import leaks, neardup, packing, provenance, rendering, syntax, textstats
from graphloom.llm.glr import Recogniser
from graphloom.llm.components import connected_groups, links
from graphloom.llm.forest import forest_neighbours, usable_vectors
from graphloom.llm.syntax_queries import checked_files


def test_groups(spark):
    rnd = random.Random(2)
    rows = [(k, k + 1, 0.9) for k in range(40)] + [(100, 200 + k, 0.8) for k in range(60)]
    rows += [(rnd.randrange(300, 330), rnd.randrange(300, 330), rnd.choice([0.5, 0.95])) for _ in range(150)]
    rows += [(None, 1, 0.9), (1, None, 0.9), (7, 7, 0.99), (500, 501, float("nan")), (502, 503, None), (504, 505, 0.79), (1, 0, 0.1)]
    df = spark.createDataFrame(rows + rows[:50], "i bigint, j bigint, cosine_sim float")
    group = {}
    for a, b, s in rows:
        if a is None or b is None or a == b or s is None or s != s or s < 0.8 - 1e-6:
            continue
        joined = group.get(a, {a}) | group.get(b, {b})
        for x in joined:
            group[x] = joined
    got = {(r.group_id, r.record_id) for r in connected_groups(links(df)).collect()}
    assert got == {(min(g), x) for x, g in group.items()}


def test_groups_of_nothing(spark):
    assert connected_groups(links(spark.createDataFrame([], "i bigint, j bigint, cosine_sim float, u string"))).count() == 0


def test_forest_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16))
    vecs = [(k, "a" if k < 80 else "b", (centres[k % 6] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(120)]
    vecs += [(200 + k, "a", vecs[0][2]) for k in range(12)] + [vecs[3]] * 3
    df = spark.createDataFrame(vecs, "id bigint, space string, vec array<float>")
    got = {}
    for r in forest_neighbours(df, 5).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    unique = {v[0]: v for v in vecs}
    hits = total = 0
    for i, (_, space, v) in unique.items():
        x = np.float32(v).astype(float)
        others = [(-round(float(np.float32(w) @ x / np.linalg.norm(np.float32(w).astype(float)) / np.linalg.norm(x)), 6), j) for j, s, w in unique.values() if s == space and j != i]
        want = [j for _, j in sorted(others)[:5]]
        hits += len(set(want) & {o for _, o in got[i]})
        total += 5
        assert len(got[i]) == 5 and i not in {o for _, o in got[i]}
    assert hits / total >= 0.9


def test_usable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>")
    assert [r.id for r in df.where(usable_vectors("vec", 2)).collect()] == [1]


def test_near_duplicates(spark):
    rnd = random.Random(4)
    base = [bytes(rnd.randrange(40) for _ in range(60)) for _ in range(8)]
    rows = [(f"b{k}", "callable", None, x) for k, x in enumerate(base)]
    for k, x in enumerate(base):
        y = bytearray(x)
        y[10] ^= 1
        rows += [(f"e{k}", "callable", None, bytes(y)), (f"c{k}", "callable" if k % 2 else "type", "", bytes(x))]
    sign = "name(first: int, second: string, third: list) -> int"
    rows += [("s1", "value", sign, None), ("s2", "value", sign.upper().replace(" ", "  "), b""), ("s3", "value", sign, b"x"), ("t", "value", "short", None), (None, "value", sign, None), ("b0", "callable", None, base[0])]
    df = spark.createDataFrame(rows, "id string, category string, signature string, body_tokens binary")
    got = {tuple(r) for r in neardup.similar_pairs(*neardup.similar_classes(neardup.symbol_strings(df))).collect()}
    sets = {}
    for i, c, s, b in rows:
        if i is None:
            continue
        if b and len(b) >= 24:
            sets[i] = ("b", c, {b[k : k + 5] for k in range(len(b) - 4)})
        elif not b and s and len("".join(s.lower().split())) >= 40:
            x = "".join(s.lower().split())
            sets[i] = ("s", c, {x[k : k + 5] for k in range(len(x) - 4)})
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][:2] == sets[b][:2] and len(sets[a][2] & sets[b][2]) >= 0.7 * len(sets[a][2] | sets[b][2])}
    assert got == want and ("s1", "s2") in got


def test_packing(spark):
    texts = [(k, "word " * n) for k, n in enumerate([1, 5, 700, 2500, 40, 2047, 2048, 10, 900, 900])] + [(90, None), (91, ""), (92, "x"), (92, "x"), (93, "a" * 250_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    enc = packing.encoder(packing.TOKENIZER)
    rows = packing.pack_texts(df).collect()
    per, docs = {}, {}
    for r in rows:
        per[r.container] = per.get(r.container, 0) + r.n_tokens
        docs[r.doc_id] = docs.get(r.doc_id, 0) + r.n_tokens
    assert max(per.values()) <= packing.CAPACITY
    want = {}
    for k, t in texts:
        if t:
            want[k] = want.get(k, 0) + packing.token_count(enc, t)
    assert docs == want
    assert all(sorted(r.piece for r in rows if r.doc_id == 3) == [0, 1] for _ in (0,))


def test_rendering():
    raw = "A '''b'''old [[target|shown]]s<ref name=x>note</ref> {{t|{{u}}}}&nbsp;caf&eacute; <!-- gone --><small>t</small>iny\n[[Category:Hidden]] [http://x.y label]"
    assert rendering.words(rendering.visible(raw)) == ["a", "bold", "showns", "cafe", "tiny", "label"]
    assert rendering.words("Straße ÉTÉ") == ["strasse", "ete"]


def test_leaks(spark):
    item = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(12))
    docs = [
        (1, "x y " + " ".join(f"'''W{k}'''" for k in range(5, 18)) + " z"), (2, " ".join(f"w{k}" for k in range(5, 17)) + " end"),
        (3, item.replace(" ", "\n")), (4, None), (5, ""), (6, other), (7, " ".join(f"w{k}" for k in range(20)) + " " + item), (3, item),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(10, item), (11, other), (12, None), (13, item + " more")], "item_id bigint, text string")
    got = {tuple(r) for r in leaks.leaked_items(d, i).collect()}
    assert got == {(a, b) for a in (1, 3, 7) for b in (10, 13)}
    assert leaks.leaked_items(d.limit(0), i).count() == 0


@pytest.mark.parametrize(("kind", "text"), [e for e in textstats.EXAMPLES])
def test_running_sentences(kind, text):
    share = textstats.profile(text)[textstats.FEATURES.index("running")]
    assert (share >= 0.5) == (kind == "prose")


def test_not_prose(spark):
    rows = [(n, t) for n, (_, t) in enumerate(textstats.EXAMPLES * 6)] + [(900, None), (901, ""), (902, "   \n")]
    got = {r.doc_id for r in textstats.not_prose(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {n for n, (k, _) in enumerate(textstats.EXAMPLES * 6) if k != "prose"}
    assert len(want - got) == 0 and not {n for n in got if n < 900} - want
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert textstats.not_prose(empty).count() == 0


def _least_edits(grammar, start, alphabet, tokens, most):
    """Brute force: breadth first over all edited strings."""
    now, seen = {tokens}, {tokens}
    for edits in range(most + 1):
        if any(grammar.accepts(start, t) for t in now):
            return edits
        new = {t[:k] + c + t[k + d :] for t in now for k in range(len(t) + 1) for c in [*alphabet, ""] for d in (0, 1)}
        now = new - seen
        seen |= new
    return None


def test_chart_of_edits():
    g = Recogniser("E: T | E + T\nT: n | ( E )\nL: E | L , E", ["E", "L"], lambda c: frozenset([c]))
    assert g.accepts("E", "n+(n+n)") and not g.accepts("E", "n+(n+)") and g.accepts("L", "n,n+n") and not g.accepts("L", "n,")
    rnd = random.Random(5)
    for text in ["n+(n+)", "nn", "", ")(", "n++n", *("".join(rnd.choice("n+(),") for _ in range(5)) for _ in range(25))]:
        assert g.repair("E", text, 2) == _least_edits(g, "E", "n+(),", text, 2), text


VALID = {
    "python": ["def f(a, b=1):\n    if a > b:\n        return [x for x in range(3)]\n    else:\n        pass\n", "X = {1: (2, 'a')}\n", "\ufeff# only a comment"],
    "javascript": ["import { a } from './b';\nfunction f(x) {\n    if (x > 1) {\n        g(x, \"}\");\n    } else {\n        let y = (x + 1) * 2;\n    }\n    return x;\n}\n", "!function(){var a=1,b=[2,3],c={k:4};}();\n"],
    "typescript": ["export function f(x: number): number {\n    const s: string = \"a\";\n    return (x) * 2;\n}\nclass A {\n    m(a: number): number {\n        return a;\n    }\n}\n"],
    "java": ["package a.b;\nimport java.util.List;\nclass A {\n    public int f(int x) {\n        String s = \"q\";\n        for (int i = 0; i < 3; i++) {\n            g(i);\n        }\n        return x;\n    }\n}\n"],
    "c": ["#include <stdio.h>\nstatic int f(int a) {\n    const char *s = \"x\";\n    return a * 2;\n}\nint T[] = { 1, 2, -3 };\n"],
    "go": ["package p\n\nimport \"fmt\"\n\ntype A struct {\n\tsize int\n}\n\nfunc (w *A) f(x int) int {\n\tfor i := 0; i < 3; i++ {\n\t\tg(i, \"s\")\n\t}\n\treturn x\n}\n"],
    "ruby": ["require \"x\"\nclass A\n  def f(a)\n    3.times do |i|\n      g(i)\n    end\n    if a > 1\n      b = 2\n    else\n      b = 3\n    end\n    return a\n  end\nend\n"],
}
CASES = [(lang, t) for lang, ts in VALID.items() for t in ts]


@pytest.mark.parametrize(("language", "text"), CASES)
def test_valid_files(language, text):
    assert syntax.problems(language, text.encode()) == []
    assert syntax.problems(language, text.replace("\n", "\r\n").encode()) == []


@pytest.mark.parametrize(("language", "text"), [(k, v[0]) for k, v in VALID.items()])
def test_broken_files(language, text):
    lines = text.split("\n")
    marks = "\n".join([*lines[:2], "<<<<<<< a", lines[2], "=======", lines[2], ">>>>>>> b", *lines[3:]])
    cut = text.rstrip()[: -max(4, len(text) // 4)].rsplit(" ", 1)[0] + " ("
    for broken in (marks, cut, "<!DOCTYPE html>\n<p>Not found.</p>\n", text + '\n"open\n'):
        assert syntax.problems(language, broken.encode()), broken
    assert syntax.problems(language, b"") == []


def test_checked_files(spark):
    files = spark.createDataFrame([("r/a.py", bytearray(b"x = (1\n")), ("r/b.py", bytearray(b"")), ("r/c.txt", bytearray(b"(")), (None, bytearray(b"x")), ("r/d.py", None)], "path string, content binary")
    ext = spark.createDataFrame([(".py", "python")], "ext string, language string")
    assert {(r.path, r.edits > 0) for r in checked_files(files, ext).collect()} == {("r/a.py", True), ("r/b.py", False)}


def test_provenance(spark):
    code = "function f(x) {\n" + "".join(f"    let v{k} = g(x, {k * 7 % 11});\n" for k in range(12)) + "    return x;\n}\n"
    files = [
        ("r/src/a.js", code), ("r/vendor/lib/a.js", "let a = 1;\n" + code), ("r/vendors/b.js", code + "// b\n"), ("r/g.js", "// Code generated by tool v1. DO NOT EDIT.\n" + code.replace("g(", "h(")),
        ("r/n.js", "// Checks that files marked 'DO NOT EDIT' were left alone.\n" + code.replace("g(", "k(")), ("r/m.js", "!function(){" + "var a=1,b=[2,3],c={k:4};" * 12 + "}();"),
        ("r/d.js", "module.exports = [\n" + "12345, 67890, 13579,\n" * 20 + "];\n"), ("q1/z.js", code.replace("g(", "w(")), ("q2/z.js", "\ufeff" + code.replace("g(", "w(").replace("\n", "\r\n")), ("q3/y.js", code.replace("g(", "w(") + "// end\n"), ("r/x.txt", "@generated"), ("r/e.js", ""),
    ]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files] + [("r/null.js", None)], "path string, content binary")
    ext = spark.createDataFrame([(".js", "javascript")], "ext string, language string")
    got = {r.path: r.kind for r in provenance.not_handwritten(df, ext).collect()}
    assert got == {"r/vendor/lib/a.js": "third-party", "r/g.js": "generated", "r/m.js": "minified", "r/d.js": "data", "q1/z.js": "third-party", "q2/z.js": "third-party", "q3/y.js": "third-party"}


def test_tokens_of_stretches():
    enc = packing.encoder(packing.TOKENIZER)
    rnd = random.Random(8)
    for text in ["", "a" * 500, " " * 300, *("".join(rnd.choice("ab1é.,'  \n\t\u3000s") for _ in range(700)) for _ in range(20))]:
        assert packing.token_count(enc, text, 50) == len(enc.encode_ordinary(text))
