"""Syntax of source files by language, and the least repair they need (problem 5).

A file becomes a string of one character per token (``shapes``). Bracketed groups are reduced from the inside out to one token
that says what the group can be (block, arguments, parameters, literal ...): islands of a chart over the whole file. Statements,
members and lines are cut where the grammar says one is complete and the next token cannot go on with it. Groups and units
repeat endlessly as strings of token kinds, so each is parsed once per worker. What the grammar does not derive is repaired by the
error-correcting chart chart (``glr``): a file's cost is the sum of the least edits of its units and of its unmatched brackets,
and files of cost 0 are valid. Where the edits fall tells what happened: at the end (truncation), at conflict marks, or in
many places (another language).

The least edits of a unit are exact up to ``REPAIR``; a unit that needs more counts REPAIR + 1, a lower bound, which does not change which
files are flagged. This holds for every unit, whatever the size of its file and whatever files came before.
"""

from __future__ import annotations

import ast
import re
import warnings

from graphloom.llm.glr import Recogniser
from graphloom.llm.grammars import ASI, GROUPS, TEXT, groups_of
from graphloom.llm.shapes import _FIRST_BRACE, _FIRST_GROUP, _INDENT, BAD, STR, VAR, code, lexer, name_of, state
from graphloom.llm.sourcetext import decode

REPAIR = 2
_PAIR = {")": "(", "]": "[", "}": "{"}
CUT, GOES_ON, DEAD, COULD = 0, 1, 2, 3
_GENERIC = frozenset(["cpp", "java", "csharp", "typescript", "rust", "scala"])  # an operand may be the arguments behind a closing ">"
_RESTRICTED = ("return", "break", "continue", "throw")


class Problem(Exception):
    """Edits a file needs: cost, line (1-based) and what was there."""

    def __init__(self, cost: int, line: int, what: str) -> None:
        super().__init__(what)
        self.cost, self.line, self.what = cost, line, what


class Invalid(Exception):
    """The quick pass has met a group that cannot be read."""


class Checker:
    """Grammar, automaton and everything parsed so far of one language."""

    def __init__(self, language: str) -> None:
        self.language, self.asi = language, language in ASI
        self.kinds = groups_of(language)
        self.units = {kind: content[:-1] for pairs in self.kinds.values() for kind, content in pairs if content[-1] == ";"}
        starts = {c.rstrip("?;") for pairs in self.kinds.values() for _, c in pairs if c != "ATT*"} | {"T", "S", "Line", "Line0"}
        self.terminals: dict[str, frozenset] = {}
        self.of_group: dict[str, frozenset] = {}
        self.group_chars: dict[tuple[str, frozenset], str] = {}
        self.recogniser = Recogniser(TEXT[language], starts, self.matches)
        self.memo: dict = {}
        self.implied: dict[str, set[str]] = {}
        for name, symbols in self.recogniser.rules:
            if len(symbols) == 1:  # what is made of these units is made of those, too
                self.implied.setdefault(name, set()).add(symbols[0])
        self.loose = frozenset(c for c in ("\n",) if language in ("javascript", "typescript", "python", "ruby"))
        self.blanks = re.compile("\n[\U00020000-\U00023000]?" if language == "python" else "\n")
        self.pieces = re.compile(f"[^;\n{chr(_FIRST_BRACE)}-\uf8ff]*(?:[;\n{chr(_FIRST_BRACE)}-\uf8ff]|$)")
        self.island = self._islands()
        self.restricted = frozenset(code(w) for w in _RESTRICTED)

    def _islands(self) -> re.Pattern:
        """Two operands and their operator where only an expression can stand.

        Reading them as one number changes nothing about whether the whole can be parsed, and leaves far fewer different units.
        """
        plain = [self.group_char("(", self.kinds_of("(", x)) for x in ("0", "a")] if self.kinds["("] else []
        operand = "[a0" + "".join(re.escape(c) for c in plain if "EXP" in self.matches(c)) + "]"
        sure, compares = "".join(map(re.escape, ("+", "-", code("bop")))), "<>" if self.language in ("javascript", "python", "ruby", "php") else ""
        around = ("+", "-", "<", ">", "*", ",", *map(code, ("bop", "&&", "||", "and", "or")))
        heads = [code(w) for w in ("if", "elif", "elsif", "unless", "while", "until", "for", "switch", "case", "in")] if self.language in ("go", "python", "ruby", "rust", "scala") else []
        before = "".join(map(re.escape, ("(", "=", *heads, *map(code, ("return", "asg", ":=", "not")), *(t for t in around if t != ">" or self.language not in _GENERIC))))
        colon = (":",) if self.language == "python" else ()
        after = "".join(map(re.escape, (")", ";", "\n", *colon, *around)))
        ends = "".join(map(re.escape, (")", ";", "\n", *colon, *map(code, ("&&", "||", "and", "or")))))
        pair = f"(?:{operand}[{sure}]{operand}|0\\*{operand}|{operand}\\*0)(?=[{after}])"
        compared = f"(?:0[<>{compares}]{operand}|{operand}[<>{compares}]0{f'|{operand}[{compares}]{operand}' if compares else ''})(?=[{ends}])"
        headed = ""
        if self.language == "go":
            # a block follows; a name before it could be the type of a literal, unless the header is this expression alone
            block = f"(?=[{chr(_FIRST_BRACE)}-\uf8ff])"
            sign = f"[{sure}<>*]"
            headed = f"|{operand}{sign}0{block}|(?<=[{''.join(map(re.escape, (code('if'), code('for'))))}]){operand}{sign}{operand}{block}"
        return re.compile(f"(?<=[{before}])(?:{pair}|{compared}{headed})")

    def shorter(self, shape: str) -> str:
        n = 1
        while n:
            shape, n = self.island.subn("0", shape)
        return _REPEATED.sub(r"\1\1", shape) if shape.count(",") > 5 else shape

    def matches(self, char: str) -> frozenset:
        got = self.terminals.get(char)
        if got is None:
            kinds = self.of_group.get(char)
            got = self.terminals[char] = kinds if kinds is not None else frozenset([name_of(char)])
        return got

    def group_char(self, opener: str, kinds: frozenset) -> str:
        key = (opener, kinds)
        got = self.group_chars.get(key)
        if got is None:
            first = _FIRST_BRACE if opener == "{" else _FIRST_GROUP
            got = chr(first + sum(1 for o, _ in self.group_chars if (o == "{") == (opener == "{")))
            self.group_chars[key], self.of_group[got] = got, kinds
        return got

    def any_group(self, opener: str) -> str:
        return self.group_char(opener, frozenset(k for k, _ in self.kinds[opener]))

    # -- the quick pass ---------------------------------------------------------------------------

    def reduce(self, m: re.Match) -> str:
        group = m[0]
        got = self.memo.get(group)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            if _PAIR.get(group[-1]) != group[0]:
                raise Invalid
            short = self.shorter(group)
            got = self.memo.get(short)
            if got is None:
                kinds = self.kinds_of(short[0], short[1:-1])
                got = self.memo[short] = self.group_char(short[0], kinds) if kinds else ""
            if len(group) < 40:
                self.memo[group] = got
        if not got:
            raise Invalid
        return got

    def kinds_of(self, opener: str, inside: str) -> frozenset:
        flat = self.blanks.sub("", inside) if self.loose else inside
        out, units = [], set()
        flat_only = ";" in flat
        for kind, content in self.kinds[opener]:
            if flat_only and content[-1] != ";" and content != "ATT*" and not self.semicolons(content.rstrip("?")) and flat.strip(";").count(";"):
                continue
            if content == "ATT*":
                fits = BAD not in flat
            elif content[-1] == ";":
                fits = not units.isdisjoint(self.implied.get(content[:-1], ())) or self.body(content[:-1], inside)
                if fits:
                    units.add(content[:-1])
            elif not flat.strip(";") if self.language in ("go", "scala") else not flat:
                fits = content[-1] == "?"
            else:
                fits = self.fits(content.rstrip("?"), flat)
            if fits:
                out.append(kind)
        return frozenset(out)

    def semicolons(self, start: str) -> bool:
        """Whether a semicolon can stand in what ``start`` derives."""
        got = self.memo.get(("semicolons", start))
        if got is None:
            seen, agenda, by = {start}, [start], self.recogniser.by
            while agenda:
                for k in by.get(agenda.pop(), ()):
                    new = set(self.recogniser.rules[k][1]) - seen
                    seen |= new
                    agenda.extend(new)
            got = self.memo["semicolons", start] = ";" in seen
        return got

    def fits(self, start: str, unit: str) -> bool:
        """Whether the grammar derives the unit; a line end that Go or Scala turned into a semicolon does no harm at its end."""
        key = (start, unit)
        got = self.memo.get(key)
        if got is None:
            got = self.recogniser.accepts(start, unit)
            if not got and self.language in ("go", "scala") and unit[-1:] == ";":
                got = self.recogniser.accepts(start, unit[:-1])
            self.memo[key] = got
        return got

    def status(self, start: str, unit: str, ahead: str, line_end: bool) -> int:
        """What to do after ``unit``: cut, go on reading, give up, or go on with a unit that could end here. ``ahead`` is the next token ("" at the end)."""
        key = (start, unit, ahead, line_end)
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = self._status(start, unit, ahead, line_end)
        return got

    def _status(self, start: str, unit: str, ahead: str, line_end: bool) -> int:
        heads, n = self.recogniser.run(start, unit)
        if n < len(unit):
            return DEAD
        open_end = self.asi and (line_end or not ahead) or not ahead and self.language in ("go", "java", "rust", "php", "csharp")
        complete = self.recogniser.complete(start, heads)
        goes_on = bool(ahead) and self.recogniser.continues(heads, ahead)
        if complete:
            return COULD if goes_on else CUT
        if not complete and open_end:
            closed = self.recogniser.feed(heads, ";")
            complete = bool(closed) and self.recogniser.complete(start, closed)
            if complete and (not goes_on or unit[-1] in self.restricted or line_end and name_of(ahead) == "inc"):
                return CUT
            if complete:
                return COULD
        return GOES_ON if ahead else DEAD

    def body(self, start: str, inside: str) -> bool:
        """Whether the contents are units of the kind ``start``, one behind the other."""
        if self.language == "ruby":
            return not self.ruby(self._ruby_body(inside), None)
        for _ in self.cut(start, inside):
            return False
        return True

    def cut(self, start: str, inside: str, where: list | None = None):
        """Cut into units; yields (unit, place) of each that the grammar does not derive. ``where`` collects all units' places."""
        pieces = self.pieces.findall(inside)
        rests = [p.rstrip("\n") for p in pieces]
        n, unit, began, place = len(pieces), "", 0, 0
        following = [""] * n
        ahead = ""
        for k in range(n - 1, -1, -1):
            following[k] = ahead
            ahead = rests[k][:1] or ahead
        k, could = 0, None
        while k < n:
            if not unit:
                began, could = place, None
            unit += rests[k]
            place += len(pieces[k])
            k += 1
            if not unit:
                continue
            step = self.status(start, unit, following[k - 1], pieces[k - 1][-1:] == "\n")
            if step == CUT:
                unit = ""
            elif step == COULD:
                could = (k, place)
            elif step == DEAD:
                if could is None:
                    yield unit, began
                else:
                    k, place = could
                unit = ""

    def quick(self, text: str) -> bool:
        """Whether the file is valid."""
        shape = lexer(self.language).shape(text)
        if BAD in shape:
            return False
        try:
            while True:
                shape, n = _GROUP.subn(self.reduce, shape)
                if not n:
                    break
        except Invalid:
            return False
        if _BRACKETS.search(shape):
            return False
        shape = self.shorter(shape)
        if self.language == "python":
            return not self.python([(line[0], line[1:], 0) for line in shape.split("\n") if len(line) > 1])
        if self.language == "ruby":
            return not self.ruby(self._ruby_body(shape), None)
        return self.body("S" if self.language in ("javascript", "typescript", "php", "scala") else "T", shape)

    # -- lines of Python and Ruby -----------------------------------------------------------------

    def python(self, lines: list[tuple[str, str, int]]) -> list[Problem]:
        """Lines as (indentation, tokens, line): each against the grammar, and the nesting of their blocks."""
        found, indents, opened, heads = [], [chr(_INDENT)], False, {}
        words = state().setdefault("python_words", {w: code(w) for w in ("if", "elif", "else", "for", "while", "try", "except", "finally", "async", "match", "case")})
        before_of = {words["else"]: ("if", "elif", "for", "while", "except", "try"), words["elif"]: ("if", "elif"), words["except"]: ("try", "except"), words["finally"]: ("try", "except", "else")}
        before_of = {k: frozenset(words[w] for w in v) for k, v in before_of.items()}
        unit, line = "", 1
        for indent, unit, line in lines:
            cost = 0 if self.fits("Line", unit) else self.cost("Line", unit)
            if opened:
                if indent <= indents[-1]:
                    cost += 1
                else:
                    indents.append(indent)
            elif indent > indents[-1]:
                cost += 1
            else:
                while indent < indents[-1]:
                    heads.pop(indents.pop(), None)
                if indent != indents[-1]:
                    cost += 1
            head = unit[1:2] if unit[0] == words["async"] else unit[0]
            allowed = before_of.get(head)
            if allowed is not None and heads.get(indents[-1]) not in allowed:
                cost += 1
            opened = unit[-1] == ":"
            heads[indents[-1]] = head
            if cost:
                found.append(Problem(cost, line, self.show(unit)))
        if opened:
            found.append(Problem(1, line, "end of file"))
        return found

    def _ruby_body(self, inside: str) -> list[tuple[str, int]]:
        bar = code("bar")
        inside = re.sub(rf"^\n*{bar}[^{bar}]*{bar}", "\n", inside)
        return [(u, 0) for u in re.split("[;\n]+", self._ruby_lines(inside)) if u]

    def _ruby_lines(self, shape: str) -> str:
        made = state().get("ruby_lines")
        if made is None:
            c = {w: code(w) for w in ("do", "then", "else", "elsif", "end", "when", "bop", "asg", "&&", "||", "and", "or", "not", "&.", "::", "..", "=>", "def", "alias", "undef", "ensure", "in", "**", "bar")}
            goes = "".join(c[w] for w in ("bop", "asg", "&&", "||", "and", "or", "not", "&.", "=>", "**")) + ",=+.&?<("
            named = "".join(c[w] for w in ("&.", "::", "def", "alias", "undef")) + "."
            made = state()["ruby_lines"] = (
                re.compile(f"(?<=[{re.escape(goes)}])(?<![{re.escape(named)}].)\n+"),
                re.compile(rf"\n+(?=(?:\.(?!\.)|{c['&.']}|&&|{re.escape(c['bop'])}(?=.)))"),
                re.compile(rf"(?<![{re.escape(named)}])({c['do']})(?!:)({c['bar']}[^{c['bar']}\n]*{c['bar']})?+(?=[^\n])"),
                re.compile(rf"(?<![{re.escape(named)}])({c['then']})(?!:)(?=[^\n])"),
                re.compile(rf"(?<![{re.escape(named)}\n])(?=[{c['end']}{c['else']}{c['elsif']}{c['ensure']}](?!:))"),
                re.compile(rf"(?<=\n{c['else']})(?=[^\n])"),
            )
        joined, leading, do, then, before, after = made
        shape = leading.sub("", joined.sub("", shape))
        shape = then.sub("\\1\n", do.sub("\\1\\2\n", shape))
        return after.sub("\n", before.sub("\n", "\n" + shape))

    def ruby(self, lines: list[tuple[str, int]], end: int | None) -> list[Problem]:
        """Lines as (tokens, line): each against the grammar, and the nesting of class ... end."""
        made = state().get("ruby_words")
        if made is None:
            opens = {code(w): w for w in ("class", "module", "def", "if", "unless", "while", "until", "for", "begin", "case")}
            opened = re.compile(rf"(?:(?<=[={code('asg')}(])|(?<=<<))[{code('if')}{code('unless')}{code('case')}{code('begin')}{code('while')}](?!:)")
            do = re.compile(rf"(?<![.{code('&.')}]){code('do')}(?!:)")
            inner = {code(w): (w, frozenset(a)) for w, a in {"else": ("if", "unless", "case", "begin", "def", "do", "elsif"), "elsif": ("if",), "when": ("case",), "rescue": ("begin", "def", "do", "class", "module"), "ensure": ("begin", "def", "do", "class", "module", "else-part"), "in": ("case",)}.items()}
            made = state()["ruby_words"] = (opens, opened, do, inner, code("end"), code("def"), code("return"))
        opens, opened, do, inner, end_word, def_word, return_word = made
        found, stack, line = [], [], 1
        for unit, line in lines:
            if not self.fits("Line", unit):
                found.append(Problem(self.cost("Line", unit), line, self.show(unit)))
                continue
            head = unit[0]
            if head == end_word and unit[1:2] != ":":
                if stack:
                    stack.pop()
                else:
                    found.append(Problem(1, line, self.show(unit)))
                if do.search(unit):
                    stack.append("do")
            elif head in opens and unit[1:2] != ":":
                if not (head == def_word and "=" in unit and re.search(r"^.a(?:[^=]*)=[^=]", unit) and not unit[2:3] == "=" and self._endless(unit)):
                    stack.append(opens[head])
            elif head in inner and unit[1:2] != ":":
                name, allowed = inner[head]
                if not stack or stack[-1] not in allowed:
                    found.append(Problem(1, line, self.show(unit)))
                elif name == "else":
                    stack[-1] = "else-part"
            elif do.search(unit):
                stack.append("do")
            elif opened.search(unit) or unit[1:2] == def_word:
                stack.append("if" if code("if") in unit or code("unless") in unit else "case" if code("case") in unit else "begin" if code("begin") in unit else "def")
        if stack:
            found.append(Problem(len(stack), end or line, "end of file"))
        return found

    def _endless(self, unit: str) -> bool:
        return bool(re.search(f"^.a[{chr(_FIRST_GROUP)}-\uf8ff]?=", unit))

    # -- the careful pass: places and costs -------------------------------------------------------

    def show(self, unit: str) -> str:
        return " ".join("()" if c in self.of_group else name_of(c) for c in unit)[:80]

    def cost(self, start: str, unit: str, room: int = 10**6) -> int:
        """Least edits of one unit that the grammar does not derive, at most REPAIR + 1; exact only if not above ``room``."""
        most = min(REPAIR, room)
        key = (start, unit, most)
        got = self.memo.get(key)
        if got is None:
            got = self.recogniser.repair(start, unit, most)
            got = self.memo[key] = max(1, most + 1 if got is None else got)
        return got

    def widest(self, opener: str) -> list[tuple[str, str]]:
        """Kinds of a group whose content is not one symbol of another kind's content: their repairs cost no more than those left out."""
        got = self.memo.get(("widest", opener))
        if got is None:
            reach: dict[str, set[str]] = {}
            for _, content in self.kinds[opener]:
                start = content.rstrip("?;")
                seen, agenda = {start}, [start]
                while agenda:
                    new = self.implied.get(agenda.pop(), set()) - seen
                    seen |= new
                    agenda.extend(new)
                reach[content] = seen - {start}
            pairs = list(dict((c, k) for k, c in reversed(self.kinds[opener])).items())
            covered = lambda c: any(c.rstrip("?;") in r and (c[-1] == ";") == (d[-1] == ";") for d, r in reach.items() if d.rstrip("?;") != c.rstrip("?;"))
            got = [(k, c) for c, k in pairs if not covered(c)] or [(k, c) for c, k in pairs]
            self.memo["widest", opener] = got
        return got

    def repaired(self, opener: str, items: list[tuple[str, int]], found: list[Problem], line: int) -> str:
        """The token of a group; what no kind of group derives is repaired as the kind that costs least."""
        inside = "".join(c for c, _ in items)
        # not what the quick pass knows of the shorter group: which groups it has met depends on the files before
        key = ("group", opener, inside)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            kinds = self.kinds_of(opener, inside) if BAD not in inside else frozenset()
            known = self.memo[key] = self.group_char(opener, kinds) if kinds else ""
        if known:
            return known
        flat = self.blanks.sub("", inside) if self.loose else inside
        tries: list[tuple[int, str, list[tuple[str, int]]]] = []
        for _, content in self.widest(opener):
            if content == "ATT*" or not flat or self.language == "ruby" and content[-1] == ";":
                continue
            start = content.rstrip("?;")
            units = list(self.cut(start, inside)) if content[-1] == ";" else [(flat, 0)]
            tries.append((len(units), start, units))
        best = self.ruby(self._ruby_body(inside), line) if self.language == "ruby" and opener == "{" else None
        for least, start, units in sorted(tries, key=lambda t: t[0]):
            now: list[Problem] = []
            for n, (unit, place) in enumerate(units):
                room = 10**6 if best is None else sum(p.cost for p in best) - 1 - sum(p.cost for p in now) - (least - n - 1)
                if room < 1:
                    break
                now.append(Problem(self.cost(start, unit, room), items[min(place, len(items) - 1)][1], self.show(unit)))
            else:
                if best is None or sum(p.cost for p in now) < sum(p.cost for p in best):
                    best = now
        found.extend(best or [Problem(1, line, self.show(flat))])
        return self.any_group(opener)

    def careful(self, text: str) -> list[Problem]:
        """All problems of a file that the quick pass did not take, with their lines."""
        items = lexer(self.language).lined(text)
        found: list[Problem] = []
        stack: list[tuple[str, int, list]] = []
        now: list[tuple[str, int]] = []
        for char, line in items:
            if char == BAD:
                found.append(Problem(1, line, "character"))
            elif char in "([{":
                stack.append((char, line, now))
                now = []
            elif char in ")]}":
                while stack and stack[-1][0] != _PAIR[char] and any(o == _PAIR[char] for o, _, _ in stack):
                    opener, at, outer = stack.pop()
                    found.append(Problem(1, line, char))
                    outer.append((self.repaired(opener, now, found, at), at))
                    now = outer
                if not stack or stack[-1][0] != _PAIR[char]:
                    found.append(Problem(1, line, char))
                    continue
                opener, at, outer = stack.pop()
                outer.append((self.repaired(opener, now, found, at), line))
                now = outer
            else:
                now.append((char, line))
        last = items[-1][1] if items else 1
        if stack:
            found.append(Problem(len(stack), last, "end of file"))
            while stack:
                opener, at, outer = stack.pop()
                outer.append((self.repaired(opener, now, found, at), at))
                now = outer
        shape = "".join(c for c, _ in now)
        if self.language == "python":
            lines, k = [], 0
            for part in shape.split("\n"):
                if len(part) > 1:
                    lines.append((part[0], part[1:], now[k + 1][1]))
                k += len(part) + 1
            found.extend(self.python(lines))
        elif self.language == "ruby":
            found.extend(self._ruby_places(shape, now, last))
        else:
            start = "S" if self.language in ("javascript", "typescript", "php", "scala") else "T"
            for unit, place in self.cut(start, shape):
                found.append(Problem(self.cost(start, unit), now[place][1], self.show(unit)))
        return found

    def _ruby_places(self, shape: str, now: list[tuple[str, int]], last: int) -> list[Problem]:
        lines, k = [], 0
        for part in re.split("[;\n]", self._ruby_lines(shape)):
            if not part:
                continue
            while k < len(now) and now[k][0] != part[0]:
                k += 1
            lines.append((part, now[min(k, len(now) - 1)][1]))
            k += len(part)
        return self.ruby(lines, last)


_GROUP = re.compile(r"\([^(){}\[\]]*[)}\]]|\[[^(){}\[\]]*[)}\]]|\{[^(){}\[\]]*[)}\]]")
#: Three or more equal elements of a list are read as two.
_REPEATED = re.compile(r"(?<![^\n,(\[{])([^;,\n]{1,6},\n*)\1{2,}")
_BRACKETS = re.compile(r"[(){}\[\]]")


def checker(language: str) -> Checker:
    known = state().setdefault("checkers", {})
    got = known.get(language)
    if got is None:
        got = known[language] = Checker(language)
    return got


def problems(language: str, content: bytes) -> list[Problem]:
    """What a parser of the language would reject; empty for valid and for blank files."""
    text, _ = decode(content)
    if not text.strip():
        return []
    check = checker(language)
    if check.quick(text):
        return []
    if language == "python" and _python_accepts(text):
        return []  # exact check: the language's own parser takes it
    found = check.careful(text)
    return sorted(found, key=lambda p: p.line) or [Problem(1, 1, "file")]


def _python_accepts(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def cause(found: list[Problem], text: str) -> str:
    """truncated, conflict, other-language or edit, from the places of the edits."""
    lines = text.count("\n") + 1
    if re.search(r"^(?:<{7} |={7}$|>{7} )", text, re.M):
        return "conflict"
    if any(p.what == "end of file" for p in found) and len(found) <= 2 or len(found) == 1 and found[0].line >= lines - 1:
        return "truncated"
    return "other-language" if len(found) > 3 else "edit"
