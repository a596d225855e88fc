"""Source text as a string of one character per token: names, numbers and strings become one character each.

Comments go, strings are cut out by one regular expression per language, and what is left is split into words and the signs
between them; both are looked up, so that Python does no work per character. Tokens have characters of the private use area.
"""

from __future__ import annotations

import re
import sys
from functools import partial

from graphloom.llm.grammars import CLASSES, OPERATORS, OWN, WORDS

STR, TPL, LIFE, PRIV, SYM, VAR, GONE, IF, ELSE, ENDIF, BAD = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006", "\ue007", "\ue008", "\ue009", "\ue00a"
_NAMED = {"id": "a", "num": "0", "str": STR, "tpl": TPL, "life": LIFE, "priv": PRIV, "sym": SYM, "var": VAR}
_FIRST_WORD, _FIRST_GROUP, _FIRST_BRACE, _INDENT = 0xE010, 0xE400, 0xEC00, 0x20000
NEWLINES = frozenset(["go", "javascript", "typescript", "scala", "python", "ruby"])


def state() -> dict:
    """What a worker has learned. Kernels travel by value, so module globals end with a task; this stays with the process."""
    return sys.__dict__.setdefault("_graphloom_syntax", {"codes": dict(_NAMED), "names": {c: n for n, c in _NAMED.items()}})


def code(token: str) -> str:
    """The character of a token."""
    if len(token) == 1 and not token.isalnum():
        return token
    known = state()["codes"]
    got = known.get(token)
    if got is None:
        got = known[token] = chr(_FIRST_WORD + len(known))
        state()["names"][got] = token
    return got


def name_of(char: str) -> str:
    return state()["names"].get(char, char)


# -- what is cut out first ------------------------------------------------------------------------

_D, _S = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_SLASHED = r"//[^\n]*|/\*(?:.*?\*/|.*)"
_NESTED = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|/\*.*"
_DIRECTIVE = r"\#[ \t]*(?:(?:include|include_next|import|define|undef|ifdef|ifndef|if|elifdef|elif|else|endif|error|warning|pragma|line|region|endregion|nullable)\b(?:/\*.*?\*/|\\\n|//[^\n]*|[^\n])*|(?=\n))"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{[^{}]*\})*\})*\})*`"
_REGEX = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_INTERPOLATED = r'"(?:[^"\\#]|\\.|\#(?!\{)|\#\{(?:[^{}"]|"[^"\n]*"|\{[^{}]*\})*\})*"'
_PATTERNS = {
    "c": rf"(?P<pp>{_DIRECTIVE})|(?P<comment>{_SLASHED}|\\\n)|(?P<str>{_D}|{_S})",
    "cpp": rf"(?P<pp>{_DIRECTIVE})|(?P<comment>{_SLASHED}|\\\n)|(?P<str>(?<=R)\"(?P<delim>[^\s()\\]*)\(.*?\)(?P=delim)\"|{_D}|(?<![0-9A-Fa-f]){_S})|(?<=[0-9A-Fa-f])(?P<comment2>')(?=[0-9A-Fa-f])",
    "java": rf'(?P<comment>{_SLASHED})|(?P<str>"""(?:[^\\]|\\.)*?"""|{_D}|{_S})',
    "csharp": rf'(?P<pp>{_DIRECTIVE})|(?P<comment>{_SLASHED})|(?P<str>\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$"(?:[^"\\{{\n]|\\.|\{{\{{|\{{(?:[^{{}}"]|"[^"]*")*\}})*"|{_D}|{_S})',
    "go": rf"(?P<comment>{_SLASHED})|(?P<str>{_D}|{_S}|`[^`]*`)",
    "javascript": rf"(?P<comment>{_SLASHED}|(?<![^\n])\#![^\n]*)|(?P<str>{_D}|{_S})|(?P<tpl>{_TEMPLATE})|(?P<priv>\#[A-Za-z_$][\w$]*)|(?P<regex>{_REGEX})",
    "php": rf"(?P<comment>{_SLASHED}|\#(?!\[)[^\n]*)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\n.*?^[ \t]*(?P=tag)\b)|(?P<html>\?>.*?(?:<\?(?:php\b|=)|\Z))",
    "rust": rf"(?P<comment>{_NESTED})|(?P<str>\b[bc]?r(?P<hash>\#*)\".*?\"(?P=hash)|(?:\b[bc])?\"(?:[^\"\\]|\\.)*\"|\bb'(?:[^'\\\n]|\\[^u]|\\u\{{[^}}]*\}}|\\x..)'|'(?:[^'\\\n]|\\[^ux]|\\u\{{[^}}]*\}}|\\x..)')|(?P<life>'[^\W\d]\w*)",
    "scala": rf'(?P<comment>{_NESTED})|(?P<str>\b\w*""".*?"""+|(?:\b[a-z]\w*)?{_D}|\'(?:[^\'\\\n]|\\.[^\']*)\')|(?P<sym>\'[^\W\d]\w*)|(?P<word>`[^`\n]+`)',
    "python": rf"(?P<comment>\#[^\n]*|\\\n)|(?P<str>(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|{_D}|{_S}))",
    "ruby": rf"(?P<comment>^=begin\b.*?(?:\n=end\b[^\n]*|\Z)|(?<![\w)\]])\#[^\n]*|\#(?!\{{)[^\n]*|\\\n)|(?P<str>{_INTERPOLATED}|'(?:[^'\\]|\\.)*'|`[^`]*`|%[wWiIqQrx]?(?:\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]|\{{(?:[^{{}}\\]|\\.|\{{[^{{}}]*\}})*\}}|\((?:[^()\\]|\\.|\([^()]*\))*\)|<[^<>\n]*>|(?<=[qQwWiIrx])([|!/]).*?\8)[a-z]*)|<<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_]\w*)(?P=q)(?P<rest>[^\n]*)\n(?:.*?\n)??[ \t]*(?P=tag)(?=\n|\Z)|(?P<sym>(?<![:\w]):(?:[A-Za-z_]\w*[?!=]?(?![=:>\w])|[A-Za-z_]\w*[?!]?|\"[^\"\n]*\"|\[\]=?|[-+*/<>=!~%&|^]+))|(?P<regex>/(?![*/ ])(?:[^/\\\n]|\\.)*/[a-z]*)",
}
_PATTERNS["ruby"] = _PATTERNS["ruby"].replace(r"([|!/]).*?\8", r"(?P<rim>[|!/]).*?(?P=rim)")
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_BEFORE_REGEX = re.compile(r"(?:^|[^\w.$])(?:return|typeof|case|of|in|if|unless|when|and|or|not|while|until|elsif|yield|await|delete|void)$")
#: No cut begins with another character than these.
_BEGINS = {"c": r"[/\"'\\\#]", "cpp": r"[/\"'\\\#]", "java": r"[/\"']", "go": r"[/\"'`]", "python": r"[\#\\\"']", "csharp": r"[/\"'\#$@]", "javascript": r"[/\"'`\#]", "typescript": r"[/\"'`\#]", "ruby": r"[=\#\\\"'`%<:/]"}
#: Letters before a string that belong to it.
_PREFIX = {"c": re.compile(rf"\b(?:u8|[LuU]) (?={STR})"), "cpp": re.compile(rf"\b(?:u8|[LuU])?R? (?={STR})"), "python": re.compile(rf"\b[rRbBuUfFtT]{{1,2}}(?={STR})")}
_WORD = {"java": r"[\w$]", "javascript": r"[\w$]", "typescript": r"[\w$]", "scala": r"[\w$]"}
_SPACES = {"python": " \t\f", "go": " \t\r"}


class _Words(dict):
    """Token characters of words and of the signs between words, filled as they occur."""

    def __init__(self, language: str) -> None:
        super().__init__()
        self.language, self.words = language, WORDS[language]
        self.classes = {**CLASSES, **OWN.get(language, {})}
        ops = sorted(OPERATORS[language].split(), key=len, reverse=True)
        keep = r"|(?P<line>\n)" if language in NEWLINES else ""
        self.signs = re.compile(rf"(?P<op>{'|'.join(map(re.escape, ops))}|[-+*/%=<>!&|^~?:;,.(){{}}\[\]@#$\\]){keep}|(?P<space>[ \t\f\v\u00a0\ufeff]+|\n)|(?P<gone>{GONE})|(?P<own>[\ue000-\ue005])|(?P<bad>.)", re.S)

    def __missing__(self, text: str) -> str:
        first = text[0]
        if first.isdigit():
            out = "0"
        elif first.isalpha() or first in "_$@":
            out = self._word(text)
        else:
            out = self._signs(text)
        if len(self) > 150_000:
            self.clear()
        self[text] = out
        return out

    def _word(self, text: str) -> str:
        if text in self.words:
            return code(text)
        if self.language == "php" and text[0] == "$" and len(text) > 1:
            return VAR
        if self.language == "php" and text.lower() in self.words:
            return code(text.lower())
        if self.language == "ruby" and text == "defined?":
            return code("definedq")
        if self.language == "scala" and text == "_":
            return code("_")
        return "a"

    def _signs(self, text: str) -> str:
        out = []
        for m in self.signs.finditer(text):
            kind = m.lastgroup
            if kind == "op":
                s = m[0]
                out.append(code(self.classes.get(s, s)))
            elif kind == "line":
                if self.language == "python":
                    rest = text[m.end() :]
                    if not rest.strip(" \t\f\n" + GONE):
                        width = 0
                        for c in rest[rest.rfind("\n") + 1 :]:
                            width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + (c == " ")
                        return "".join(out) + "\n" + chr(_INDENT + min(width, 5000))
                    if rest.lstrip(" \t\f" + GONE)[:1] != "\n":
                        lead = rest[: len(rest) - len(rest.lstrip(" \t\f"))]
                        width = 0
                        for c in lead:
                            width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
                        out.append("\n" + chr(_INDENT + min(width, 5000)))
                elif not out or out[-1] != "\n":
                    out.append("\n")
            elif kind == "own":
                out.append(m[0])
            elif kind == "bad":
                out.append(BAD)
        return "".join(out)


class Lexer:
    def __init__(self, language: str) -> None:
        self.language = language
        begins = _BEGINS.get(language)
        self.cut = re.compile(f"(?={begins})(?:{_PATTERNS[language]})" if begins else _PATTERNS[language], re.S | re.M)
        self.prefix = _PREFIX.get(language)
        word = _WORD.get(language, r"\w")
        words = {"ruby": r"@{0,2}[^\W\d]\w*[?!]?(?![=~]=?(?<=[?!]=))|\$(?:\w+|.)", "php": r"\$?[^\W\d]\w*"}.get(language, rf"{word}+")
        own = "\ue000-\uf8ff"
        numbers = r"\d\w*(?:\.\d\w*|\.(?![\w.]))?(?:(?<=[eEpP])[-+]?\d\w*)?"
        if language in ("ruby", "scala", "rust"):
            numbers = r"\d\w*(?:\.\d\w*)?(?:(?<=[eE])[-+]?\d\w*)?"
        if language == "rust":
            numbers = r"\d\w*(?:\.\d\w*|\.(?![\w.=]))?(?:(?<=[eE])[-+]?\d\w*)?"
        sign = {"ruby": r"[^\w@$]|@(?![^\W\d]|@)", "php": r"[^\w$]|\$(?![^\W\d])"}.get(language, rf"[^\w$]" if word != r"\w" else r"\W")
        self.split = re.compile(rf"{numbers}|{words}|(?:{sign})+")
        self.words = _Words(language)
        self.foreign = re.compile(f"[{own}]")

    def _replace(self, m: re.Match, lines: bool) -> str:
        kind = m.lastgroup
        s = m[0]
        g = m.groupdict()
        tail = GONE * s.count("\n") if lines else ""
        if kind in ("delim", "q", "hash", "tag", "rim"):
            kind = "str" if g.get("str") is not None else "doc"
        if kind == "comment":
            if s[:2] == "/*" and not (s.endswith("*/") and len(s) > 3):
                return BAD
            if s == "\\\n":
                return tail or " "
            return " " + ("\n" + GONE * (s.count("\n") - 1) if lines and "\n" in s else "\n" if "\n" in s else "")
        if kind == "comment2":
            return ""
        if kind == "str":
            return f" {STR}{tail} " if self.language != "python" else STR + tail + " "
        if kind == "tpl":
            return TPL + tail
        if kind in ("life", "sym", "priv"):
            return {"life": LIFE, "sym": SYM, "priv": PRIV}[kind] + " "
        if kind == "word":
            return " a "
        if kind == "html":
            return "; echo " if s.endswith("<?=") else ";" + tail
        if kind == "pp":
            if m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                return BAD
            word = re.match(r"\s*#\s*(\w*)", s)[1]
            if word in ("if", "ifdef", "ifndef"):
                off = re.match(r"\s*#\s*if(?:def)?\s+(?:0|__cplusplus|defined\s*\(?\s*__cplusplus\s*\)?)\s*(?:/[/*].*)?$", s, re.S) and (self.language == "c" or " 0" in s[:12])
                return (IF + "0" if off else IF + "1") + tail
            return (ELSE if word.startswith(("else", "elif")) else ENDIF if word == "endif" else "") + tail
        if g.get("rest") is not None:
            return STR + self.cut.sub(partial(self._replace, lines=lines), g["rest"]) + tail
        if kind == "regex":
            lead = m.string[max(0, m.start() - 200) : m.start()].rstrip(" \t" if self.language == "ruby" else None)
            if not lead or lead[-1] in "=(,:;!&|?{}[+*%~^<>\n-" or _BEFORE_REGEX.search(lead):
                return STR + tail
            return "/" + self.cut.sub(partial(self._replace, lines=lines), s[1:])
        return s

    def text(self, text: str, lines: bool = False) -> str:
        """The text without comments, with strings and the like as single characters; line breaks inside them as GONE."""
        if self.foreign.search(text):
            text = self.foreign.sub("\x00", text)
        if self.language == "php":
            at = text.find("<?")
            if at < 0:
                return ""
            text = "\n" * (text.count("\n", 0, at) if lines else 0) + text[at + (5 if text[at : at + 5].lower() == "<?php" else 3 if text[at + 2 : at + 3] == "=" else 2) :]
        if self.language == "ruby":
            text = re.sub(r"\n__END__\n.*", "\n", text, flags=re.S)
        out = self.cut.sub(partial(self._replace, lines=lines), text)
        if self.prefix:
            out = self.prefix.sub("", out)
        return _first_branches(out) if IF in out or ELSE in out or ENDIF in out else out

    def shape(self, text: str) -> str:
        """One character a token."""
        out = self.text(("\n" + text) if self.language == "python" else text)
        return self._ended("".join(map(self.words.__getitem__, self.split.findall(out))))

    def _ended(self, shape: str) -> str:
        if self.language == "go":
            shape = go_ends().sub(r"\1;", shape).replace("\n", "")
        elif self.language == "scala":
            shape = scala_ends().sub(r"\1;", shape).replace("\n", "")
        return shape

    def lined(self, text: str) -> list[tuple[str, int]]:
        """(token character, line) of every token."""
        out: list[tuple[str, int]] = []
        line = 0 if self.language == "python" else 1
        for piece in self.split.findall(self.text(("\n" + text) if self.language == "python" else text, lines=True)):
            chars = self.words[piece]
            if "\n" in piece or GONE in piece:
                before = line
                line += piece.count("\n") + piece.count(GONE)
                k = chars.find("\n")
                out.extend((c, line if k >= 0 and n >= k else before) for n, c in enumerate(chars))
            else:
                out.extend((c, line) for c in chars)
        if self.language in ("go", "scala"):
            pattern = go_ends() if self.language == "go" else scala_ends()
            shape = "".join(c for c, _ in out)
            ends = {m.end() - 1 for m in pattern.finditer(shape)}
            out = [(";" if k in ends else c, at) for k, (c, at) in enumerate(out) if c != "\n" or k in ends]
        return out


def go_ends() -> re.Pattern:
    got = state().get("go_ends")
    if got is None:
        ends = "a0" + STR + ")]}" + "".join(code(w) for w in ("return", "break", "continue", "fallthrough", "inc"))
        got = state()["go_ends"] = re.compile(f"([{re.escape(ends)}])\n")
    return got


def scala_ends() -> re.Pattern:
    got = state().get("scala_ends")
    if got is None:
        ends = "a0" + STR + SYM + ")]}" + "".join(code(w) for w in ("this", "null", "type", "return", "_", "super"))
        goes = "".join(code(w) for w in ("catch", "else", "extends", "finally", "match", "with", "yield", "=>", "<-", "<:", ">:", "<%")) + ",.;:=#[)]}{"
        got = state()["scala_ends"] = re.compile(f"([{re.escape(ends)}])\n(?![{re.escape(goes)}])")
    return got


def _first_branches(text: str) -> str:
    """Of every conditional the first branch that is not switched off, as a compiler would see one of them."""
    out, stack = [], []
    for part in re.split(f"({IF}[01]|{ELSE}|{ENDIF})", text):
        if part[:1] == IF:
            stack.append([part[1] == "1", part[1] == "1"])
        elif part == ELSE:
            if stack:
                on, had = stack[-1]
                stack[-1] = [not had, True]
        elif part == ENDIF:
            if stack:
                stack.pop()
        elif all(on for on, _ in stack):
            out.append(part)
        else:
            out.append("\n" * part.count("\n") + GONE * part.count(GONE))
    return "".join(out)


def lexer(language: str) -> Lexer:
    known = state().setdefault("lexers", {})
    got = known.get(language)
    if got is None:
        got = known[language] = Lexer(language)
    return got
