"""Rule regexes to one minimal deterministic automaton over bytes: parse, subset construction, minimisation, lane scan."""

from __future__ import annotations

import string
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": {10}, "t": {9}, "d": set(string.digits.encode()), "w": set((string.ascii_letters + string.digits + "_").encode())}


@dataclass
class Automaton:
    """``table[state * classes + class]``; state 0 is the start; ``accepts[state]`` has a bit for each rule."""

    table: np.ndarray
    accepts: np.ndarray
    classes: int
    byte_class: np.ndarray


class _Parser:
    """A regex over ASCII: literals, classes, groups, alternation, ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.either()
        assert self.i == len(self.p), f"unexpected {self.p[self.i :]!r}"
        return tree

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat())
        return ("seq", items)

    def repeat(self):
        atom = self.atom()
        while self.peek() in tuple("?*+{"):
            c = self.take()
            if c == "{":
                body = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(body) + 1
                lo, _, hi = body.partition(",")
                atom = ("rep", atom, int(lo), int(hi) if hi else (None if "," in body else int(lo)))
            else:
                atom = ("rep", atom, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return atom

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.either()
            assert self.take() == ")"
            return tree
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", self.escape())
        return ("set", {ord(c)})

    def escape(self):
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        return _ESCAPES.get(c, {ord(c)})

    def members(self):
        out, negated = set(), self.peek() == "^"
        self.i += negated
        while self.peek() != "]":
            c = self.take()
            one = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                d = self.take()
                end = self.escape() if d == "\\" else {ord(d)}
                one = set(range(min(one), min(end) + 1))
            out |= one
        self.i += 1
        return set(range(256)) - out if negated else out

    def peek(self):
        return self.p[self.i : self.i + 1]

    def take(self):
        self.i += 1
        return self.p[self.i - 1]


def _fold(tree):
    """Letters in either case."""
    if tree[0] == "set":
        return ("set", {b for x in tree[1] for b in ({x, x ^ 32} if chr(x) in string.ascii_letters else {x})})
    return (tree[0], [_fold(x) for x in tree[1]]) if tree[0] in ("alt", "seq") else ("rep", _fold(tree[1]), *tree[2:])


def _flip(tree):
    """The reversed language."""
    if tree[0] == "set":
        return tree
    return (tree[0], [_flip(x) for x in (tree[1] if tree[0] == "alt" else tree[1][::-1])]) if tree[0] in ("alt", "seq") else ("rep", _flip(tree[1]), *tree[2:])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Lays tree out from start; the state where it ends."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((frozenset(tree[1]), end))
            return end
        if tree[0] == "seq":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if tree[0] == "alt":
            end = self.state()
            for x in tree[1]:
                one = self.state()
                self.empty[start].append(one)
                self.empty[self.add(x, one)].append(end)
            return end
        _, x, lo, hi = tree
        for _ in range(lo):
            start = self.add(x, start)
        if hi is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(hi - lo):
            start = self.add(x, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def compile_rules(rules: list[tuple[str, bool]], search: bool = True, flip: bool = False) -> Automaton:
    """One automaton for all rules (pattern, whether letters match in either case).

    With search, a rule's bit is set in a state if a match of it ends there,
    wherever it began. An extra last class, for the gap between texts, leads
    to the start from everywhere.
    """
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    if search:
        nfa.moves[root].append((frozenset(range(256)), root))
    for k, (pattern, fold) in enumerate(rules):
        tree = _Parser(pattern).parse()
        tree = _fold(tree) if fold else tree
        one = nfa.state()
        nfa.empty[root].append(one)
        ends[nfa.add(_flip(tree) if flip else tree, one)] = 1 << k
    sets = {s for row in nfa.moves for s, _ in row}
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(kinds))]
    # Subset construction.
    closed = [nfa.closure([s]) for s in range(len(nfa.empty))]
    steps = [[frozenset().union(*[closed[t] for chars, t in row if b in chars]) for b in sample] for row in nfa.moves]
    start = closed[root]
    number, queue, table = {start: 0}, [start], []
    for subset in queue:
        row, live = [], [steps[s] for s in subset if nfa.moves[s]]
        for c in range(len(sample)):
            to = frozenset().union(*[x[c] for x in live])
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        table.append(row)
    bits = [sum(ends.get(s, 0) for s in subset) for subset in queue]
    # Minimisation by refinement of the classes of equal accept bits.
    group = {b: i for i, b in enumerate(dict.fromkeys(bits))}
    block = [group[b] for b in bits]
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *[block[t] for t in table[s]]), len(names)) for s in range(len(table))]
        if len(names) == len(set(block)):
            break
        block = finer
    order = {b: i for i, b in enumerate(dict.fromkeys(block))}  # the start's block comes first
    small, accepts = [None] * len(order), [0] * len(order)
    for s, b in enumerate(block):
        small[order[b]] = [order[block[t]] for t in table[s]] + [0]
        accepts[order[b]] = bits[s]
    assert len(small) < 65536
    return Automaton(np.array(small, np.uint16).ravel(), np.array(accepts, np.uint32), len(kinds) + 1, byte_class)


def scan(auto: Automaton, classes: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """The state after each symbol, starting in state 0.

    The input is cut into lanes that advance together from state 0; then each
    lane whose true entry state differs is run again until it meets the
    states that it already has, so the result equals one sequential pass.
    """
    n = len(classes)
    lanes = max(1, min(lanes, n // 256))
    length = -(-n // lanes)
    padded = np.full(lanes * length, auto.classes - 1, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(lanes, length).T)
    states, now = np.empty((length, lanes), np.uint16), np.zeros(lanes, np.int32)
    table = auto.table
    for t in range(length):
        now *= auto.classes
        now += steps[t]
        states[t] = now = table[now].astype(np.int32)
    flat = np.ascontiguousarray(states.T).ravel()
    rows = table.tolist()
    for lane in range(1, lanes):
        at = lane * length
        state = int(flat[at - 1])
        while at < n and (state or at > lane * length):
            state = rows[state * auto.classes + int(padded[at])]
            if state == flat[at]:
                break
            flat[at] = state
            at += 1
    return flat[:n]
