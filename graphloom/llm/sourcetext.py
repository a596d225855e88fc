"""Source files as text: decoding, line ends, comments and strings by language."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a language writes comments and strings (fixed values).
FAMILY = {
    "c": "brace", "cpp": "brace", "csharp": "brace", "go": "brace", "java": "brace", "javascript": "brace", "typescript": "brace",
    "rust": "brace", "scala": "brace", "php": "php", "python": "python", "ruby": "ruby",
}
_DOUBLE = r'"(?:[^"\\\n]|\\.)*"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*'"
_BACK = r"`(?:[^`\\]|\\.)*`"
_SLASHED = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
PIECES = {
    "brace": re.compile(f"(?P<comment>{_SLASHED})|(?P<string>{_DOUBLE}|{_SINGLE}|{_BACK})", re.S),
    "php": re.compile(f"(?P<comment>{_SLASHED}|#(?!\\[)[^\n]*)|(?P<string>{_DOUBLE}|{_SINGLE})", re.S),
    "python": re.compile(rf'(?P<comment>#[^\n]*)|(?P<string>"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|{_DOUBLE}|{_SINGLE})', re.S),
    "ruby": re.compile(rf"(?P<comment>^=begin\b.*?(?:^=end\b[^\n]*|\Z)|#(?!\{{)[^\n]*)|(?P<string>{_DOUBLE}|{_SINGLE})", re.S | re.M),
}


def decode(content: bytes) -> tuple[str, bool]:
    """The text with line feeds only and without a byte order mark, and whether its bytes were in order.

    UTF-8 first; UTF-16 where a mark says so; else each byte as one character (then False).
    """
    clean = True
    if content[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        text = content.decode("utf-16", "replace")
    else:
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text, clean = content.decode("latin-1"), False
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.lstrip("\ufeff"), clean


def opening_and_closing(text: str, family: str) -> tuple[list[str], list[str]]:
    """The comment lines before the first and after the last line of code, without their marks."""
    lines = text.split("\n")
    return _run(lines, family), [] if len(lines) < 3 else _run_back(lines, family)


_BARE = re.compile(r"^\s*(?://+|/\*+|\*+/?|#+(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|undef|pragma)\b)|\"\"\"|'''|<!--)\s?(.*?)\s*(?:\*/|\"\"\"|'''|-->)?\s*$")


def _run(lines: list[str], family: str) -> list[str]:
    out, inside = [], False
    for line in lines:
        s = line.strip()
        if not s:
            continue
        if inside:
            end = "*/" in s
            out.append(s.replace("*/", " ").lstrip("* ").strip())
            inside = not end
            continue
        if s.startswith("#!") or s.startswith("<?php"):
            continue
        m = _BARE.match(line)
        if not m:
            break
        if family != "python" and s[:3] in ('"""', "'''"):
            break
        if s.startswith("/*"):
            inside = "*/" not in s
            end = s.find("*/")
            if 0 <= end < len(s) - 2 and not s[end + 2 :].lstrip().startswith(("//", "/*")):
                out.append(s[2:end].strip("* "))
                break  # code behind the comment
            out.extend(p.strip("/* ") for p in re.split(r"\*/", s))
            continue
        out.append(m.group(1).strip())
    return out


def _run_back(lines: list[str], family: str) -> list[str]:
    out = []
    for line in reversed(lines):
        if not line.strip():
            continue
        m = _BARE.match(line)
        if not m or line.strip()[:3] in ('"""', "'''"):
            break
        out.append(m.group(1).strip())
    return out


def code_and_literals(text: str, family: str) -> tuple[str, int]:
    """The code without comments, every string as two quotes; and how many characters the strings held.

    Strings that stand alone on their lines in a language of indented blocks are comments (docstrings).
    """
    held = 0

    def blank(m: re.Match) -> str:
        nonlocal held
        if m.lastgroup == "comment":
            return " "
        s = m.group()
        if s[:3] in ('"""', "'''") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            return "''"
        held += len(s) - 2
        return '""'

    return PIECES[family].sub(blank, text), held


def registered(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """(path, content, language) of rows with a path, content and an extension in ``extensions`` (ext, language; case-sensitive).

    The extension is what follows the last dot of the last path segment, with its dot. Null extensions match nothing; an
    extension registered twice counts with its smaller language.
    """
    known = extensions.where("ext IS NOT NULL AND language IS NOT NULL").groupBy(F.col("ext").alias("_ext")).agg(F.min("language").alias("language"))
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rows = files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content", ext.alias("_ext")).where("_ext <> ''")
    return rows.join(known, "_ext").select("path", "content", "language")
