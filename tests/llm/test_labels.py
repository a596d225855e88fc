import pytest

from graphloom.llm import syntax

SWITCH = {
    "c": "int f(int x) {\n    switch (x) {\n    case A: g(); break;\n    case 2:\n    case 'c': { g(); } break;\n    case B ? 1 : 2: g();\n    default: g();\n    }\n    return x;\n}\n",
    "java": "class A {\n    void f(int x) {\n        switch (x) {\n        case A.B: g(); break;\n        case 2: case 3:\n            g();\n        default: g();\n        }\n        switch (x) {\n        case 1, 2 -> g();\n        case String s -> g();\n        default -> { g(); }\n        }\n    }\n}\n",
    "go": "package p\n\nfunc f(x int) {\n\tswitch x {\n\tcase 1, 2:\n\t\tg()\n\tcase a[1:2]:\n\tdefault:\n\t\tg()\n\t}\n}\n",
    "javascript": "switch (x) {\ncase 'a': f(); break;\ncase b ? 1 : 2:\n    f()\n    break\ncase y.z: { f(); }\ndefault: f();\n}\n",
}
SWITCH["typescript"] = SWITCH["javascript"]
BROKEN = {
    "c": ["int f(int x) { switch (x) { case 1 foo(); break; case 2: bar(); } return x; }\n", "int f(int x) { switch (x) { case 1 +: bar(); } return x; }\n", "int f(int x) { switch (x) { case 1: a = 1 + case 2: bar(); } return x; }\n"],
    "java": ["class A { void f(int x) { switch (x) { case 1 foo(); break; case 2: bar(); } } }\n", "class A { void f(int x) { switch (x) { case ] ) -> bar(); } } }\n"],
    "go": ["package p\n\nfunc f(x int) {\n\tswitch x {\n\tcase 1 foo()\n\tcase 2:\n\t\tbar()\n\t}\n}\n"],
    "javascript": ["switch (x) { case 1 foo(); break; case 2: bar(); }\n", "switch (x) { case 1: f(); default bar(); case 3: g(); }\n", 'f(a "b");\n', 'x = [a "b"];\n'],
}
BROKEN["typescript"] = BROKEN["javascript"]


@pytest.mark.parametrize("language", SWITCH)
def test_switch(language):
    assert syntax.problems(language, SWITCH[language].encode()) == []


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken_labels_and_strings(language, text):
    assert syntax.problems(language, text.encode())


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_templates(language):
    for text in ("let a = `x`;\n", "let a = tag`x ${y}`;\n", "f(`a`, b.c`d`);\nlet q = `a`\nlet r = 'b'\n"):
        assert syntax.problems(language, text.encode()) == []
