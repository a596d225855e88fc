"""A generalized LR recogniser over strings of one-character tokens.

Grammars are text, one rule a line (``Name: alternative | alternative``); ``X?``, ``X*`` and ``X+`` mark optional and repeated
symbols and are expanded, so no rule is empty. The automaton of item sets is built as far as the input needs it. Ambiguity costs
nothing but shared stack nodes. A character may match several terminals: ``matches`` says which.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

END, ANY = "\0end", "\0any"


def rules_of(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """The rules of a grammar text without optional or repeated symbols."""
    lines = [x.split(":", 1) for x in text.strip().splitlines() if x.strip()]
    names = {n.strip() for n, _ in lines}
    rules: dict[tuple[str, tuple[str, ...]], None] = {}

    def choices(symbol: str) -> list[tuple[str, ...]]:
        inner = symbol[:-1]
        if len(symbol) > 1 and symbol[-1] in "?*+" and (inner in names or inner[0].isalpha() or symbol[-1] == "?" and inner in ("&", "...", "*", ";")):
            if symbol[-1] == "?":
                return [(), (inner,)]
            rules[inner + "+", (inner,)] = None
            rules[inner + "+", (inner + "+", inner)] = None
            return [(inner + "+",)] if symbol[-1] == "+" else [(), (inner + "+",)]
        return [(symbol,)]

    for name, body in lines:
        for alternative in body.split(" | "):
            for picked in product(*[choices(s) for s in alternative.split()]):
                flat = tuple(s for part in picked for s in part)
                if flat and flat != (name.strip(),):
                    rules[name.strip(), flat] = None
    return list(rules)


#: Cells and stack nodes kept from one string to the next.
KEPT = 100_000


class Recogniser:
    def __init__(self, text: str, starts: Iterable[str], matches: Callable[[str], frozenset]) -> None:
        self.rules = rules_of(text)
        self.by: dict[str, list[int]] = {}
        for k, (name, _) in enumerate(self.rules):
            self.by.setdefault(name, []).append(k)
        self.matches = matches
        self.follow = self._follow(set(starts))
        self.states: dict[tuple, int] = {}
        self.closed: list[dict[str, list]] = []
        self.done: list[list[tuple[str, int]]] = []
        self.goto: list[dict[str, int]] = []
        self.kernels: list[tuple] = []
        self.shifts: list[dict[str, tuple[int, ...]]] = []
        self.reduces: list[dict[str, tuple]] = []
        self.inserts: dict[tuple[int, str], tuple[int, ...]] = {}
        self.initial: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        # stacks of equal content are one node, wherever they end; equal sets of heads are one cell, and 0 is the cell without heads
        self.nodes: dict[tuple[int, ...], int] = {}
        self.state_of: list[int] = []
        self.parents: list[tuple[int, ...]] = []
        self.cells: dict[tuple[int, ...], int] = {(): 0}
        self.heads: list[tuple[int, ...]] = [()]
        self.fed: dict[tuple[int, str], int] = {}
        self.edited: dict[tuple[int, str], int] = {}
        self.merged: dict[tuple[int, ...], int] = {}
        self.ready: dict[int, list[tuple[int, int]]] = {}

    def _follow(self, starts: set[str]) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {n: set() for n in self.by}
        changed = True
        while changed:
            changed = False
            for name, body in self.rules:
                new = first.get(body[0], {body[0]})
                if not new <= first[name]:
                    first[name] |= new
                    changed = True
        follow: dict[str, set[str]] = {n: {END} if n in starts else set() for n in self.by}
        changed = True
        while changed:
            changed = False
            for name, body in self.rules:
                for k, s in enumerate(body):
                    if s in follow:
                        new = follow[name] if k + 1 == len(body) else first.get(body[k + 1], {body[k + 1]})
                        if not new <= follow[s]:
                            follow[s] |= new
                            changed = True
        return follow

    def _state(self, kernel: tuple) -> int:
        got = self.states.get(kernel)
        if got is not None:
            return got
        moves: dict[str, list] = {}
        done, seen, agenda = [], set(), list(kernel)
        while agenda:
            rule, dot = agenda.pop()
            name, body = self.rules[rule] if rule >= 0 else ("", (self._start_names[-rule - 1],))
            if dot == len(body):
                if rule >= 0:
                    done.append((name, dot))
                continue
            s = body[dot]
            moves.setdefault(s, []).append((rule, dot + 1))
            if s in self.by and s not in seen:
                seen.add(s)
                agenda.extend((r, 0) for r in self.by[s])
        got = self.states[kernel] = len(self.kernels)
        self.kernels.append(kernel)
        self.closed.append({s: tuple(sorted(set(items))) for s, items in moves.items()})
        self.done.append(done)
        self.goto.append({})
        self.shifts.append({})
        self.reduces.append({})
        return got

    _start_names: list[str] = []

    def _begin(self, start: str) -> int:
        got = self.initial.get(start)
        if got is None:
            self._start_names = [*self._start_names, start]
            got = self.initial[start] = self._state(((-len(self._start_names), 0),))
        return got

    def _go(self, state: int, symbol: str) -> int | None:
        known = self.goto[state]
        if symbol in known:
            return known[symbol]
        kernel = self.closed[state].get(symbol)
        got = known[symbol] = None if kernel is None else self._state(kernel)
        return got

    def _shift(self, state: int, token: str) -> tuple[int, ...]:
        known = self.shifts[state]
        got = known.get(token)
        if got is None:
            found = [self._go(state, t) for t in self.matches(token) if t in self.closed[state]]
            got = known[token] = tuple(found)
        return got

    def _reduce(self, state: int, token: str) -> tuple:
        known = self.reduces[state]
        got = known.get(token)
        if got is None:
            ahead = (END,) if token == END else () if token == ANY else self.matches(token)
            got = known[token] = tuple((n, k) for n, k in self.done[state] if token == ANY or any(t in self.follow[n] for t in ahead))
        return got

    def _node(self, state: int, parents: Iterable[int]) -> int:
        key = (state, *sorted(parents))
        got = self.nodes.get(key)
        if got is None:
            got = self.nodes[key] = len(self.state_of)
            self.state_of.append(state)
            self.parents.append(key[1:])
        return got

    def _cell(self, heads: dict[int, set[int]]) -> int:
        key = tuple(sorted([self._node(state, parents) for state, parents in heads.items()]))
        got = self.cells.get(key)
        if got is None:
            got = self.cells[key] = len(self.heads)
            self.heads.append(key)
        return got

    def _reduced(self, cell: int, token: str) -> dict[int, set[int]]:
        """States and parents of the heads after all reductions that ``token`` may follow."""
        # no rule is empty, so parents belong to earlier cells: a new parent matters only to the node that gets it
        state_of, parents_of = self.state_of, self.parents
        agenda = [(state_of[node], parents_of[node]) for node in self.heads[cell]]
        heads = {state: set(parents) for state, parents in agenda}
        while agenda:
            state, parents = agenda.pop()
            for name, size in self._reduce(state, token):
                bases = parents
                for _ in range(size - 1):
                    bases = parents_of[bases[0]] if len(bases) == 1 else tuple({b for base in bases for b in parents_of[base]})
                for base in bases:
                    target = self._go(state_of[base], name)
                    if target is None:
                        continue
                    old = heads.get(target)
                    if old is None:
                        heads[target] = {base}
                    elif base in old:
                        continue
                    else:
                        old.add(base)
                    agenda.append((target, (base,)))
        return heads

    def feed(self, cell: int, token: str) -> int:
        got = self.fed.get((cell, token))
        if got is None:
            out: dict[int, set[int]] = {}
            for state, parents in self._reduced(cell, token).items():
                targets = self._shift(state, token)
                if targets:
                    node = self._node(state, parents)
                    for target in targets:
                        out.setdefault(target, set()).add(node)
            got = self.fed[cell, token] = self._cell(out)
        return got

    def run(self, start: str, tokens: str) -> tuple[int, int]:
        """The cell of the stacks after ``tokens``, and how many of them could be read."""
        cell = self._origin(start)
        for k, token in enumerate(tokens):
            cell = self.feed(cell, token)
            if not cell:
                return cell, k
        return cell, len(tokens)

    def _origin(self, start: str) -> int:
        if len(self.nodes) + len(self.fed) + len(self.edited) + len(self.merged) > KEPT:
            self._forget()
        return self._cell({self._begin(start): set()})

    def complete(self, start: str, cell: int) -> bool:
        first = self._begin(start)
        target = self._go(first, start)
        return any(self.state_of[base] == first for base in self._reduced(cell, END).get(target, ()))

    def continues(self, cell: int, token: str) -> bool:
        return self.feed(cell, token) > 0

    def repair(self, start: str, tokens: str, most: int) -> int | None:
        """Least insertions, deletions and replacements of tokens that make ``tokens`` a ``start``; None if more than ``most``.

        A chart over (edits, position): each cell holds the heads of all stacks that reach the position with so many edits. A row
        ends with the last cell that can be reached.
        """
        n = len(tokens)
        below: list[int] = []
        for edits in range(most + 1):
            row: list[int] = []
            cell, reach = 0, len(below)
            for k in range(n + 1):
                if not cell and k > reach:
                    break
                if cell:
                    cell = self.feed(cell, tokens[k - 1])
                if not edits and not k:
                    cell = self._origin(start)
                if k <= reach and edits:
                    # in the last row only stacks that take the next token are of use
                    ahead = (tokens[k] if k < n else END) if edits == most else ANY
                    parts = {cell}
                    if k < reach:
                        parts.add(self._any(below[k], ahead))
                    if k:
                        parts.add(below[k - 1])
                        parts.add(self._any(below[k - 1], ahead))
                    cell = self._merge(parts)
                row.append(cell)
            if len(row) > n and row[n] and self.complete(start, row[n]):
                return edits
            while row and not row[-1]:
                row.pop()
            below = row
        return None

    def _merge(self, cells: set[int]) -> int:
        """The heads of several cells as those of one."""
        cells.discard(0)
        if len(cells) < 2:
            return cells.pop() if cells else 0
        key = tuple(sorted(cells))
        got = self.merged.get(key)
        if got is None:
            out: dict[int, set[int]] = {}
            for cell in key:
                for node in self.heads[cell]:
                    out.setdefault(self.state_of[node], set()).update(self.parents[node])
            got = self.merged[key] = self._cell(out)
        return got

    def _any(self, cell: int, ahead: str) -> int:
        """The cell after one more token, whichever it is, that can take ``ahead``."""
        got = self.edited.get((cell, ahead))
        if got is None:
            ready = self.ready.get(cell)
            if ready is None:
                ready = self.ready[cell] = [(state, self._node(state, parents)) for state, parents in self._reduced(cell, ANY).items() if self._inserted(state, ANY)]
            out: dict[int, set[int]] = {}
            for state, node in ready:
                for target in self._inserted(state, ahead):
                    out.setdefault(target, set()).add(node)
            got = self.edited[cell, ahead] = self._cell(out)
        return got

    def _inserted(self, state: int, ahead: str) -> tuple[int, ...]:
        """States after ``state`` and any token that can take ``ahead``."""
        got = self.inserts.get((state, ahead))
        if got is None:
            targets = [self._go(state, symbol) for symbol in self.closed[state] if symbol not in self.by]
            got = self.inserts[state, ahead] = tuple(t for t in targets if ahead == ANY or self._reduce(t, ahead) or ahead != END and self._shift(t, ahead))
        return got

    def accepts(self, start: str, tokens: str) -> bool:
        cell, n = self.run(start, tokens)
        return n == len(tokens) and self.complete(start, cell)
