"""Rules compiled into byte automata: subset construction, minimisation, transition arrays.

The combined automaton reads the text backwards and marks every place where a
match of any rule begins; all rules share the one pass. Matches are then
walked forwards from those places with the anchored automaton of their rule,
so each rule gets its leftmost longest matches that don't overlap.

Pattern syntax: literals, ``\\xHH`` and escaped characters, ``[...]`` classes,
``( )``, ``|``, ``? * +`` and ``{m} {m,} {m,n}``; ASCII only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """A kind of match. What follows the longest match of ``head`` must have ``least`` bytes, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    head: str | None = None


# A tree: ("set", frozenset of bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", node, least, most or None)


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.p!r} ends too early")
        self.i += 1
        return c

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def members(self) -> frozenset[int]:
        out, negated = set(), self.peek() == "^"
        if negated:
            self.take()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                d = self.take()
                out.update(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
            else:
                out.add(low)
        return frozenset(set(range(256)) - out if negated else out)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, at: int, backwards: bool) -> int:
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((node[1], to))
            return to
        if kind == "cat":
            for part in reversed(node[1]) if backwards else node[1]:
                at = self.add(part, at, backwards)
            return at
        if kind == "alt":
            ends = [self.add(part, self.branch(at), backwards) for part in node[1]]
            to = self.state()
            for end in ends:
                self.free[end].append(to)
            return to
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at, backwards)
        if high is None:
            loop = self.branch(at)
            self.free[self.add(inner, loop, backwards)].append(loop)
            at = self.branch(loop)
        else:
            out = self.state()
            for _ in range(high - low):
                self.free[at].append(out)
                at = self.add(inner, self.branch(at), backwards)
            self.free[at].append(out)
            at = out
        return at

    def branch(self, at: int) -> int:
        new = self.state()
        self.free[at].append(new)
        return new

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """Minimal deterministic automaton. ``table[state, byte class]``; a bit of ``accepts[state]`` for each rule; ``dead``: the state without a way out, or -1."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int


def compile_rules(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """``anywhere``: matches may begin at any byte that is read, not only at the first."""
    nfa = _Nfa()
    root = nfa.state()
    finals = {}
    for bit, pattern in enumerate(patterns):
        finals[nfa.add(_Parser(pattern).parse(), nfa.branch(root), backwards)] = 1 << bit
    # Bytes that no set tells apart form a class.
    sets = {members for moves in nfa.moves for members, _ in moves}
    signatures: dict[tuple[bool, ...], int] = {}
    classes = np.array([signatures.setdefault(tuple(b in s for s in sets), len(signatures)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signatures))]
    first = nfa.closed({root})
    index, order, rows = {first: 0}, [first], []
    for states in order:  # subset construction; the list grows as it is read
        row = []
        for byte in sample:
            to = {t for s in states for members, t in nfa.moves[s] if byte in members}
            new = nfa.closed(to | ({root} if anywhere else set()))
            if new not in index:
                index[new] = len(order)
                order.append(new)
            row.append(index[new])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(finals.get(s, 0) for s in states) for states in order], np.int64)
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # minimisation: split groups until all members move alike
        new = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == group.max():
            break
        group = new
    picked = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(accepts[picked] > 0, kind="stable"), kind="stable")  # accepting states come last
    old = picked[np.argsort(rank)]
    table, accepts = rank[group[table[old]]], accepts[old]
    own = np.arange(len(old))
    dead = np.flatnonzero((table == own[:, None]).all(1) & (accepts == 0))
    return Automaton(classes, table, accepts, int(rank[group[0]]), int(dead[0]) if len(dead) and not anywhere else -1)


class Scanner:
    """All rules over many texts. Byte 0 must not occur in any rule: it separates texts."""

    #: Bytes between the places where a lane of the pass may begin.
    LANE = 2048

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.marks = compile_rules([r.pattern for r in rules], backwards=True, anywhere=True)
        self.walks = [self._walk(r.pattern) for r in rules]
        self.heads = [self._walk(r.head) if r.head else None for r in rules]
        moves = self.marks.table
        resets = (moves == self.marks.start).all(0)  # after such a byte nothing before it matters
        if not resets[self.marks.classes[0]]:
            raise ValueError("a rule can match byte 0")
        self.reset = resets[self.marks.classes]
        self.flat = np.ascontiguousarray(moves * moves.shape[1]).astype(np.int32).reshape(-1)
        self.first_accept = int((self.marks.accepts == 0).sum()) * moves.shape[1]

    @staticmethod
    def _walk(pattern: str):
        a = compile_rules([pattern])
        return [row[a.classes].tolist() for row in a.table], (a.accepts > 0).tolist(), a.start, a.dead

    def starts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where matches begin, in order, and a bit for each rule. ``raw`` begins and ends with byte 0."""
        ends = np.flatnonzero(self.reset[raw])
        cuts = np.unique(ends[np.searchsorted(ends, np.arange(0, len(raw) - 1, self.LANE))])
        cuts = np.union1d(cuts, [0, len(raw) - 1])
        length = np.diff(cuts) - 1
        order = np.argsort(-length, kind="stable")
        length, position = length[order], cuts[1:][order].copy()
        symbols = self.marks.classes[raw]
        state = np.full(len(order), self.marks.start * self.marks.table.shape[1], np.int32)
        falling = -length
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(falling, -t, "left"))
            at = position[:m]
            at -= 1
            now = self.flat[state[:m] + symbols[at]]
            state[:m] = now
            hit = np.flatnonzero(now >= self.first_accept)
            if len(hit):
                found.append((at[hit], now[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.concatenate([x for x, _ in found])
        bits = self.marks.accepts[np.concatenate([x for _, x in found]) // self.marks.table.shape[1]]
        order = np.argsort(place)
        return place[order], bits[order]

    @staticmethod
    def _longest(walk, raw: bytes, at: int) -> int:
        rows, accepts, state, dead = walk
        end = at if accepts[state] else -1
        while True:
            state = rows[state][raw[at]]
            at += 1
            if state == dead or at >= len(raw):
                return end
            if accepts[state]:
                end = at

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of each text, sorted."""
        joined = b"\0" + b"\0".join(texts) + b"\0"
        begins = np.concatenate(([1], 2 + np.arange(len(texts) - 1) + np.cumsum([len(t) for t in texts[:-1]]))).astype(np.int64) if texts else np.zeros(0, np.int64)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        place, bits = self.starts(np.frombuffer(joined, np.uint8))
        for k, rule in enumerate(self.rules):
            own = place[(bits >> k & 1) > 0]
            i = 0
            while i < len(own):
                start = int(own[i])
                end = self._longest(self.walks[k], joined, start)
                begin = max(start, self._longest(self.heads[k], joined, start)) if self.heads[k] else start
                if end - begin >= rule.least:
                    d = int(np.searchsorted(begins, start, "right")) - 1
                    out[d].append((start - int(begins[d]), k, end - int(begins[d])))
                i = int(np.searchsorted(own, max(end, start + 1)))
        for spans in out:
            spans.sort()
        return out
