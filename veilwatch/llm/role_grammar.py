"""Generalised LR repair over a small grammar of roles.

The grammar's SLR tables are built from its rules.  A stack is a chain of shared nodes, one node per
(state, node below), so equal stacks are one node however they came about.  Reading a row, every live
stack may delete it, keep it, rerole it, and before any of these insert roles; results that end in the
same stack merge by the least (cost, audit).  Audits are compared by rank: behind a row all audits have
the same number of letters other than I and end in one, so none is the beginning of another and the order
of two is settled for good.  A step depends only on the live stacks, their cost differences and ranks, of
which a left-recursive grammar has few; steps are remembered.
"""

from __future__ import annotations

from functools import cache, lru_cache
from typing import NamedTuple

#: A conversation: an optional system row, then pairs of user and assistant; or nothing.
ROLES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "X"), ("P", "PX"), ("X", "ua"))
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an undeleted row with a cut-off text adds.
TRUNCATED_COST = 1
#: Roles that may be given or inserted.
FREE = "ua"
#: Codes of a row: kind (place in this text; one more is any other role) times three plus its class.
KINDS = "sua"
FINE, TRUNCATED, MUST_GO = 0, 1, 2
END = "$"


class Live(NamedTuple):
    """A live stack: its top node, its cost and the rank of its audit."""

    node: int
    cost: int
    rank: int


class Back(NamedTuple):
    """Where a live stack came from: the stack before the row, the row's letters and their roles."""

    before: int
    letters: str
    roles: str


class Automaton:
    """SLR tables and shared stacks of a grammar whose first rule's left side is the start."""

    def __init__(self, rules=ROLES):
        self.rules = (("", rules[0][0]), *rules)
        self.names = {left for left, _ in rules}
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self.follow = self._follow()
        self._add(self._closure({(0, 0)}))
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known: dict[tuple[int, int], int] = {(0, -1): 0}
        self._steps: dict = {}

    def _first(self) -> tuple[dict[str, set], set]:
        first, empty = {n: set() for n in self.names}, set()
        size = -1
        while size != (size := sum(map(len, first.values())) + len(empty)):
            for left, right in self.rules[1:]:
                for symbol in right:
                    first[left] |= first[symbol] if symbol in self.names else {symbol}
                    if symbol not in empty:
                        break
                else:
                    empty.add(left)
        return first, empty

    def _follow(self) -> dict[str, set]:
        first, empty = self._first()
        follow = {n: set() for n in self.names}
        follow[self.rules[0][1]].add(END)
        size = -1
        while size != (size := sum(map(len, follow.values()))):
            for left, right in self.rules[1:]:
                rest = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= rest
                        rest = first[symbol] | (rest if symbol in empty else set())
                    else:
                        rest = {symbol}
        return follow

    def _closure(self, items: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right) and right[dot] in self.names:
                for k, (left, _) in enumerate(self.rules):
                    if left == right[dot] and (k, 0) not in items:
                        items.add((k, 0))
                        todo.append((k, 0))
        return frozenset(items)

    def _add(self, items: frozenset) -> int:
        if items in self.states:
            return self.states.index(items)
        self.states.append(items)
        at = len(self.states) - 1
        moves: dict[str, set] = {}
        for rule, dot in items:
            if dot < len(self.rules[rule][1]):
                moves.setdefault(self.rules[rule][1][dot], set()).add((rule, dot + 1))
        for symbol in sorted(moves):
            self.goto[at, symbol] = self._add(self._closure(moves[symbol]))
        return at

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _done(self, node: int) -> list[int]:
        """The rules that end at the top of the stack."""
        return [r for r, dot in sorted(self.states[self.nodes[node][0]]) if r and dot == len(self.rules[r][1])]

    def _reduced(self, node: int, rule: int) -> int:
        left, right = self.rules[rule]
        for _ in right:
            node = self.nodes[node][1]
        return self._node(self.goto[self.nodes[node][0], left], node)

    def _reductions(self, node: int, symbol: str) -> list[int]:
        """The stack itself and all it reduces to before ``symbol``."""
        out = [node]
        for at in out:
            out += [n for r in self._done(at) if symbol in self.follow[self.rules[r][0]]
                    for n in [self._reduced(at, r)] if n not in out]
        return out

    def shifted(self, node: int, symbol: str) -> list[int]:
        """The stacks after ``symbol``; a state that can only reduce by one rule does so at once."""
        out = []
        for at in self._reductions(node, symbol):
            state = self.goto.get((self.nodes[at][0], symbol))
            if state is None:
                continue
            top = self._node(state, at)
            while len(self.states[self.nodes[top][0]]) == 1 and self._done(top):
                top = self._reduced(top, self._done(top)[0])
            out.append(top)
        return sorted(set(out))

    def accepts(self, node: int) -> bool:
        return any((0, 1) in self.states[self.nodes[n][0]] for n in self._reductions(node, END))

    def stacks(self) -> list[int]:
        """All stacks there can be between two rows; a left-recursive grammar has finitely many."""
        found = [0]
        for node in found:
            found += [n for s in KINDS for n in self.shifted(node, s) if n not in found]
        return found

    def with_inserts(self, live: tuple[Live, ...]) -> dict[int, tuple]:
        """Per stack the least (cost, rank, inserts, place in ``live``, inserted roles)."""
        best = {}
        todo = [(s.cost, s.rank, 0, k, "", s.node) for k, s in enumerate(live)]
        while todo:
            *value, node = todo.pop()
            if node in best and best[node] <= tuple(value):
                continue
            best[node] = tuple(value)
            cost, rank, n, k, roles = value
            todo += [(cost + COSTS[INSERT], rank, n + 1, k, roles + s, after)
                     for s in FREE for after in self.shifted(node, s)]
        return best

    def step(self, live: tuple[Live, ...], code: int) -> tuple[tuple[Live, ...], tuple[Back, ...], int]:
        """The live stacks after a row, where each came from, and the cost all of them share."""
        key = (live, code)
        if key not in self._steps:
            self._steps[key] = self._step(live, *divmod(code, 3))
        return self._steps[key]

    def _step(self, live, kind, state):
        found: dict[int, tuple] = {}
        extra = TRUNCATED_COST if state == TRUNCATED else 0
        for node, (cost, rank, n, k, roles) in self.with_inserts(live).items():
            options = [(DELETE, COSTS[DELETE], "-", [node])]
            if state != MUST_GO:
                options += [(REROLE, COSTS[REROLE] + extra, s, self.shifted(node, s)) for s in FREE]
                if kind < len(KINDS):
                    options.append((KEEP, COSTS[KEEP] + extra, "-", self.shifted(node, KINDS[kind])))
            for letter, price, role, tops in options:
                for top in tops:
                    value = (cost + price, rank, INSERT * n + letter, k, roles + role)
                    found[top] = min(found.get(top, value), value)
        least = min(v[0] for v in found.values())
        ranks = {r: k for k, r in enumerate(sorted({v[1:3] for v in found.values()}))}
        tops = sorted(found)
        return (tuple(Live(t, found[t][0] - least, ranks[found[t][1:3]]) for t in tops),
                tuple(Back(found[t][3], found[t][2], found[t][4]) for t in tops), least)

    def run(self, entry: int, codes) -> tuple[tuple[Live, ...], int, list[tuple[Back, ...]]]:
        live, shared, backs = (Live(entry, 0, 0),), 0, []
        for code in codes:
            live, back, cost = self.step(live, code)
            shared += cost
            backs.append(back)
        return live, shared, backs

    def last(self, live: tuple[Live, ...]) -> tuple[int, int, str]:
        """The best accepted end: its cost, place in ``live`` and the roles inserted behind it."""
        ends = [v for node, v in self.with_inserts(live).items() if self.accepts(node)]
        cost, _, _, k, roles = min(ends)
        return cost, k, roles


def walked(backs: list[tuple[Back, ...]], at: int) -> list[Back]:
    """The edits of every row on the way to the live stack at place ``at``."""
    out = []
    for back in reversed(backs):
        out.append(back[at])
        at = back[at].before
    return out[::-1]


@cache
def automaton() -> Automaton:
    """The role automaton; its stacks are numbered alike in every process."""
    own = Automaton()
    own.stacks()
    return own


@lru_cache(1 << 14)
def transfer(codes: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """Per way through the rows: stack before, stack after, cost and rank of its audit among the ways."""
    own = automaton()
    ways = []
    for entry in own.stacks():
        live, shared, backs = own.run(entry, codes)
        ways += [(entry, s.node, shared + s.cost, "".join(b.letters for b in walked(backs, k)))
                 for k, s in enumerate(live)]
    ranks = {a: k for k, a in enumerate(sorted({w[3] for w in ways}))}
    return [(e, x, cost, ranks[audit]) for e, x, cost, audit in ways]


@lru_cache(1 << 14)
def edits(codes: tuple[int, ...], entry: int, leave: int) -> list[tuple[str, str]]:
    """Letters and roles of every row on the best way from one stack to another."""
    own = automaton()
    live, _, backs = own.run(entry, codes)
    at = next(k for k, s in enumerate(live) if s.node == leave)
    return [(b.letters, b.roles) for b in walked(backs, at)]
