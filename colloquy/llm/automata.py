"""Deterministic automata over bytes: regexes, subset construction, minimisation, transition arrays."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np

_WORDS = {"d": string.digits, "w": string.ascii_letters + string.digits + "_", "s": " \t\n\r\x0b\x0c"}


class _Parser:
    """ASCII regexes of literals, classes, groups, | ? * + {m} {m,} {m,n}, \\xHH, \\d \\w \\s and (?i:...)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self, n: int = 1) -> str:
        self.i += n
        return self.s[self.i - n : self.i]

    def either(self, fold: bool):
        options = [self.row(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.row(fold))
        return ("or", options) if len(options) > 1 else options[0]

    def row(self, fold: bool):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.single(fold)))
        return ("row", parts)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                body, self.i = self.s[self.i : self.s.index("}", self.i)], self.s.index("}", self.i) + 1
                a, _, b = body.partition(",")
                low, high = int(a), int(b) if b else None if "," in body else int(a)
            node = ("rep", node, low, high)
        return node

    def escaped(self) -> set[int]:
        c = self.take()
        if c == "x":
            return {int(self.take(2), 16)}
        return {ord(x) for x in _WORDS[c]} if c in _WORDS else {ord(c)}

    def single(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.s.startswith("?i:", self.i):
                self.take(3)
                fold = True
            elif self.s.startswith("?:", self.i):
                self.take(2)
            node = self.either(fold)
            self.take()
            return node
        if c == "[":
            found = set()
            while self.peek() != "]":
                low = self.escaped() if (c := self.take()) == "\\" else {ord(c)}
                if self.peek() == "-" and self.s[self.i + 1] != "]" and len(low) == 1:
                    self.take()
                    low = set(range(min(low), ord(self.take()) + 1))
                found |= low
            self.take()
        else:
            found = self.escaped() if c == "\\" else set(range(256)) - {10} if c == "." else {ord(c)}
        if fold:
            found |= {ord(x) for b in found if b < 128 for x in (chr(b).lower(), chr(b).upper())}
        return ("set", frozenset(found))


def parse(pattern: str):
    return _Parser(pattern).either(False)


def backwards(node):
    kind = node[0]
    if kind == "row":
        return ("row", [backwards(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [backwards(x) for x in node[1]])
    return ("rep", backwards(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class Automaton:
    """rows: 256 next states for each state, state 0 first; accepts: a bit for each rule; dead: the state without a way on, or -1."""

    rows: np.ndarray
    accepts: np.ndarray
    dead: int
    lists: list | None = field(default=None, repr=False, compare=False)

    def linked(self) -> list[list]:
        """A list for each state: the lists of the 256 next states, then the accept bits."""
        out = [[] for _ in self.rows]
        for own, row, bits in zip(out, self.rows.tolist(), self.accepts.tolist(), strict=True):
            own.extend(out[k] for k in row)
            own.append(bits)
        return out

    def ends(self, data: bytes, at: int, step: int = 1, stop: int = 0) -> list[int]:
        """Positions where a match that starts at ``at`` ends, nearest first; with step -1 it is read backwards, as far
        as ``stop``."""
        if self.lists is None:
            self.lists = self.linked()
        found, row, dead = [], self.lists[0], self.lists[self.dead] if self.dead >= 0 else None
        for i in range(at, len(data)) if step > 0 else range(at - 1, stop - 1, -1):
            row = row[data[i]]
            if row is dead:
                break
            if row[256]:
                found.append(i + 1 if step > 0 else i)
        return found


def build(nodes: list, anywhere: bool) -> Automaton:
    """Subset construction over all rules at once; ``anywhere``: a match may start at any byte."""
    step: list[tuple[frozenset, int] | None] = []
    free: list[list[int]] = []

    def new() -> int:
        step.append(None)
        free.append([])
        return len(free) - 1

    def add(node, a: int) -> int:
        kind = node[0]
        if kind == "set":
            step[a] = (node[1], b := new())
            return b
        if kind == "row":
            for x in node[1]:
                free[a].append(n := new())
                a = add(x, n)
            return a
        if kind == "or":
            out = new()
            for x in node[1]:
                free[a].append(n := new())
                free[add(x, n)].append(out)
            return out
        _, inner, low, high = node
        for _ in range(low):
            free[a].append(n := new())
            a = add(inner, n)
        out = new()
        if high is None:
            free[a].append(loop := new())
            free[loop] += [inside := new(), out]
            free[add(inner, inside)].append(loop)
        else:
            for _ in range(high - low):
                free[a] += [out, n := new()]
                a = add(inner, n)
            free[a].append(out)
        return out

    start = new()
    last = {}
    for k, node in enumerate(nodes):
        free[start].append(n := new())
        last[add(node, n)] = 1 << k

    def closure(found) -> frozenset:
        found, todo = set(found), list(found)
        while todo:
            for x in free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(x for x in found if step[x] is not None or x in last)

    sets = sorted({s[0] for s in step if s}, key=sorted)
    alike: dict[tuple, list[int]] = {}
    for b in range(256):
        alike.setdefault(tuple(b in s for s in sets), []).append(b)
    groups = list(alike.values())
    begin = closure([start])
    ids, order, table = {begin: 0}, [begin], []
    for state in order:
        row = []
        for g in groups:
            to = {step[x][1] for x in state if step[x] and g[0] in step[x][0]}
            to = closure(to) | begin if anywhere else closure(to)
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        table.append(row)
    table = np.array(table)
    accepts = np.array([sum({last[x] for x in s if x in last}) for s in order])
    # Minimisation: states stay together as long as they accept alike and lead to the same groups.
    part, n = np.unique(accepts, return_inverse=True)[1], 0
    while part.max() + 1 > n:
        n = part.max() + 1
        part = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
    first = np.unique(part, return_index=True)[1]
    move = np.empty(len(first), int)
    rest = [p for p in range(len(first)) if p != part[0]]
    move[[part[0], *rest]] = range(len(first))
    small, bits = np.empty((len(first), len(groups)), int), np.empty(len(first), int)
    small[move], bits[move] = move[part[table[first]]], accepts[first]
    rows = np.empty((len(first), 256), np.int32)
    for k, g in enumerate(groups):
        rows[:, g] = small[:, k : k + 1]
    dead = next((s for s in range(len(first)) if not bits[s] and (small[s] == s).all()), -1)
    return Automaton(rows, bits, -1 if anywhere else dead)
