"""Extraction of symbols and raw edges from source files: one table function for all languages.

Definitions are read from lines by a small table of patterns per language family; nesting comes from
indentation, braces or end marks. It is a reading of declarations, not a full parser: symbols, containment, inheritance, imports
and calls come out, types of expressions do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "file_path string, ord int, name string, scoped_name string, category string, kind string, signature string, start int, end int"
EDGES = "file_path string, ord int, src string, dst string, kind string"
_ID = r"[A-Za-z_$][\w$]*"
#: Declarations: (pattern, category, kind) per language; group n is the name, s a parameter list, b base names (written for this project).
RULES = {
    "python": [(rf"(?:async )?def (?P<n>{_ID})\s*(?P<s>\([^)]*\))?", "callable", "function"), (rf"class (?P<n>{_ID})\s*(?:\((?P<b>[^)]*)\))?", "type", "class"), (rf"(?P<n>{_ID})\s*(?::[^=]+)?=(?!=)", "value", "variable")],
    "ruby": [(rf"def (?:self\.)?(?P<n>{_ID}[?!=]?)\s*(?P<s>\([^)]*\))?", "callable", "function"), (rf"class (?P<n>{_ID})(?:\s*<\s*(?P<b>[\w:]+))?", "type", "class"), (rf"module (?P<n>{_ID})", "type", "module"), (r"(?P<n>[A-Z][A-Z0-9_]+)\s*=", "value", "constant")],
    "go": [(rf"func (?:\([^)]*\) )?(?P<n>{_ID})\s*(?P<s>\([^)]*\))", "callable", "function"), (rf"type (?P<n>{_ID}) struct", "type", "struct"), (rf"type (?P<n>{_ID}) interface", "type", "interface"), (rf"package (?P<n>{_ID})", "module", "package"), (rf"(?:var|const) (?P<n>{_ID})", "value", "variable")],
    "java": [(rf"(?:\w+ )*class (?P<n>{_ID})(?:<[^>]*>)?(?: extends (?P<b>[\w.]+))?", "type", "class"), (rf"(?:\w+ )*interface (?P<n>{_ID})", "type", "interface"), (rf"(?:\w+ )*enum (?P<n>{_ID})", "type", "enum"), (rf"package (?P<n>[\w.]+);", "module", "package"), (rf"(?:(?:public|private|protected|static|final|abstract) )*[\w<>\[\]]+ (?P<n>{_ID})\s*(?P<s>\([^)]*\))\s*(?:throws [\w, ]+)?\{{", "callable", "method")],
    "javascript": [(rf"(?:export )?(?:default )?(?:async )?function\s*\*?\s*(?P<n>{_ID})\s*(?P<s>\([^)]*\))", "callable", "function"), (rf"(?:export )?(?:default )?(?:abstract )?class (?P<n>{_ID})(?: extends (?P<b>[\w.]+))?", "type", "class"), (rf"(?:export )?interface (?P<n>{_ID})", "type", "interface"), (rf"(?:export )?type (?P<n>{_ID})\b.*=", "type", "type_alias"), (rf"(?:export )?enum (?P<n>{_ID})", "type", "enum"), (rf"(?:export )?(?:const|let|var) (?P<n>{_ID})\s*(?::[^=]+)?=\s*(?:async )?(?:\([^)]*\)|{_ID})\s*=>", "callable", "arrow_function"), (rf"(?:static |async |public |private |protected |get |set )*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b){_ID})\s*(?P<s>\([^)]*\))(?:\s*:\s*[^{{]+)?\s*\{{", "callable", "method")],
    "c": [(rf"(?:typedef )?struct (?P<n>{_ID})\s*\{{", "type", "struct"), (rf"(?:typedef )?union (?P<n>{_ID})\s*\{{", "type", "union"), (rf"enum (?:class )?(?P<n>{_ID})", "type", "enum"), (rf"class (?P<n>{_ID})(?:\s*:\s*(?:public|private|protected) (?P<b>\w+))?\s*\{{", "type", "class"), (rf"namespace (?P<n>{_ID})", "module", "namespace"), (rf"#define (?P<n>{_ID})(?P<s>\([^)]*\))", "callable", "macro_function"), (rf"#define (?P<n>{_ID})", "value", "macro"), (rf"(?:[\w*]+ )+\*?(?P<n>(?!if\b|for\b|while\b|switch\b){_ID})\s*(?P<s>\([^)]*\))\s*\{{", "callable", "function")],
    "rust": [(rf"(?:pub(?:\([^)]*\))? )?(?:async )?fn (?P<n>{_ID})[^(]*(?P<s>\([^)]*\))", "callable", "function"), (rf"(?:pub )?struct (?P<n>{_ID})", "type", "struct"), (rf"(?:pub )?enum (?P<n>{_ID})", "type", "enum"), (rf"(?:pub )?trait (?P<n>{_ID})", "type", "trait"), (rf"(?:pub )?mod (?P<n>{_ID})", "module", "module"), (rf"(?:pub )?(?:const|static) (?P<n>{_ID})", "value", "constant"), (rf"macro_rules! (?P<n>{_ID})", "callable", "macro")],
    "scala": [(rf"(?:\w+ )*def (?P<n>{_ID})\s*(?P<s>\([^)]*\))?", "callable", "function"), (rf"(?:\w+ )*(?:class|object) (?P<n>{_ID})(?:\([^)]*\))?(?: extends (?P<b>\w+))?", "type", "class"), (rf"(?:\w+ )*trait (?P<n>{_ID})", "type", "trait"), (r"package (?P<n>[\w.]+)", "module", "package"), (rf"(?:val|var) (?P<n>{_ID})", "value", "variable")],
    "php": [(rf"(?:(?:public|private|protected|static|final|abstract) )*function (?P<n>{_ID})\s*(?P<s>\([^)]*\))", "callable", "function"), (rf"(?:abstract |final )?class (?P<n>{_ID})(?: extends (?P<b>\w+))?", "type", "class"), (rf"interface (?P<n>{_ID})", "type", "interface"), (rf"trait (?P<n>{_ID})", "type", "trait"), (r"namespace (?P<n>[\w\\]+);", "module", "namespace")],
}
RULES["typescript"], RULES["cpp"], RULES["csharp"] = RULES["javascript"], RULES["c"], [*RULES["java"], (rf"namespace (?P<n>[\w.]+)", "module", "namespace")]
_IMPORT = re.compile(r"""^(?:import\s+(?:static\s+)?(?P<a>[\w.*]+);?$|from (?P<b>[\w.]+) import (?P<c>.+)|import (?:\w+\s+)?"(?P<d>[^"]+)"|import .*? from ["'](?P<e>[^"']+)["']|require(?:_relative)?\s*\(?["'](?P<f>[^"']+)["']|#include\s*[<"](?P<g>[^>"]+)[>"]|use (?P<h>[\w:\\]+)|using (?P<i>[\w.]+);)""")
_CALL = re.compile(rf"(?<![\w$.])({_ID})\s*\(")
_NO_CALL = frozenset("if for while switch catch return function def func class elif print and or not in new sizeof fn match".split())
_QUIET = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|//.*|/\*.*?\*/')


def _compiled(language: str) -> list[tuple[re.Pattern, str, str]]:
    return [(re.compile("^" + p), c, k) for p, c, k in RULES.get(language, [])]


def extract(language: str, path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and raw edges of one file, in order."""
    rules = _compiled(language)
    symbols: list[list] = []
    edges: list[tuple] = []
    stack: list[tuple[int, int, str]] = []  # indentation, symbol, scope
    lines = text.replace("\r\n", "\n").split("\n")
    for at, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith(("//", "*", "/*")) or line.startswith("#") and not line.startswith(("#define", "#include")):
            continue
        indent = len(raw.expandtabs(4)) - len(raw.expandtabs(4).lstrip())
        closing = line.startswith(("}", "end", ")"))
        while stack and (indent < stack[-1][0] or indent == stack[-1][0] and not line.startswith(("{", ")"))):
            done = stack.pop()
            symbols[done[1]][8] = at if closing and indent == done[0] else at - 1
        found = _IMPORT.match(line)
        if found:
            module = next(x for x in (found["a"], found["b"], found["d"], found["e"], found["f"], found["g"], found["h"], found["i"]) if x) if any(found.groupdict().values()) else ""
            for name in [x.strip().split(" as ")[0] for x in (found["c"] or module).split(",")]:
                edges.append((path, len(edges), name, module, "imports"))
            continue
        for pattern, category, kind in rules:
            m = pattern.match(line)
            if not m:
                continue
            if category == "value" and stack and symbols[stack[-1][1]][4] == "callable":
                break
            name = m["n"]
            parent = stack[-1] if stack else None
            scope = f"{parent[2]}.{name}" if parent else name
            if kind == "function" and parent and symbols[parent[1]][4] == "type":
                kind = "method"
            params = m.groupdict().get("s") or ""
            symbols.append([path, len(symbols), name, scope, category, kind, name + params if category == "callable" else name, at, at])
            if parent:
                edges.append((path, len(edges), parent[2], scope, "contains"))
            for base in (m.groupdict().get("b") or "").split(","):
                if base.strip() and "=" not in base:
                    edges.append((path, len(edges), scope, base.strip().split(".")[-1].split("::")[-1], "inherits"))
            if category in ("callable", "type") and not line.endswith((";",)) and not (line.endswith("}") and "{" in line):
                stack.append((indent, len(symbols) - 1, scope))
            break
        else:
            owner = next((s for s in reversed(stack) if symbols[s[1]][4] == "callable"), None)
            if owner:
                for callee in dict.fromkeys(_CALL.findall(_QUIET.sub('""', line))):
                    if callee not in _NO_CALL and not any(e[2] == owner[2] and e[3] == callee and e[4] == "calls" for e in edges[-64:]):
                        edges.append((path, len(edges), owner[2], callee, "calls"))
    for _, k, _ in stack:
        symbols[k][8] = len(lines)
    return [tuple(s) for s in symbols], edges


def _run(extensions: dict[str, str], edges: bool):
    names = [x.split()[0] for x in (EDGES if edges else SYMBOLS).split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.string() for x in (EDGES if edges else SYMBOLS).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = path.rsplit("/", 1)[-1]
                language = extensions.get(base[base.rfind(".") :] if "." in base else "")
                if language and content:
                    out += extract(language, path, content.decode("utf-8", "replace"))[1 if edges else 0]
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def _files(files: DataFrame, extensions: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    known = {r[0]: r[1] for r in extensions.select("ext", "language").where("ext IS NOT NULL").limit(10_000).collect()}
    return files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content"), known


def extract_symbols(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """Symbols of all files (path, content) with a registered extension; a parse problem leaves out lines, never a file."""
    rows, known = _files(files, extensions)
    return rows.mapInArrow(_run(known, False), SYMBOLS)


def extract_edges(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """Raw edges by local names: contains, inherits, imports, calls."""
    rows, known = _files(files, extensions)
    return rows.mapInArrow(_run(known, True), EDGES)
