"""Byte automata from small pattern expressions.

Expressions are plain tuples built by the functions below; ``compile_dfa``
turns one or several into a minimal deterministic automaton: position sets
by subset construction over classes of bytes that no pattern tells apart,
then minimisation by refining partitions until they are stable.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


def one_of(*ranges: str) -> tuple:
    """One byte out of characters and ranges such as "a-z"."""
    out: set[int] = set()
    for r in ranges:
        if len(r) == 3 and r[1] == "-":
            out.update(range(ord(r[0]), ord(r[2]) + 1))
        else:
            out.update(r.encode())
    return ("byte", frozenset(out))


def word(text: str, any_case: bool = False) -> tuple:
    return seq(*(("byte", frozenset((ch.lower() + ch.upper()).encode()) if any_case else frozenset(ch.encode()))
                 for ch in text))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def many(part: tuple, least: int = 0) -> tuple:
    """part, least times or more."""
    return seq(*[part] * least, ("star", part))


def maybe(part: tuple) -> tuple:
    return alt(part, seq())


def backward(e: tuple) -> tuple:
    """The expression of the reversed texts."""
    kind, arg = e
    if kind == "byte":
        return e
    if kind == "star":
        return (kind, backward(arg))
    parts = tuple(backward(p) for p in arg)
    return (kind, parts[::-1] if kind == "seq" else parts)


class _Nfa:
    """Thompson construction: edges on bytes, empty edges, one goal per rule."""

    def __init__(self) -> None:
        self.on: list[tuple[frozenset, int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.on.append(None)
        self.empty.append([])
        return len(self.on) - 1

    def add(self, e: tuple, a: int) -> int:
        """Build e from state a; the state after it."""
        kind, arg = e
        if kind == "byte":
            b, c = self.state(), self.state()
            self.empty[a].append(b)
            self.on[b] = (arg, c)
            return c
        if kind == "seq":
            for p in arg:
                a = self.add(p, a)
            return a
        end = self.state()
        if kind == "alt":
            for p in arg:
                s = self.state()
                self.empty[a].append(s)
                self.empty[self.add(p, s)].append(end)
            return end
        loop = self.state()
        self.empty[a].append(loop)
        self.empty[self.add(arg, loop)].append(loop)
        self.empty[loop].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """classes: class of each byte; step[state, class]; accept: bit r of
    accept[state] is set where rule r has a match that ends here. State 0
    starts; ``dead`` (or -1) never accepts again."""

    classes: bytes
    step: np.ndarray
    accept: np.ndarray
    dead: int

    def rows(self, by_byte: bool = False) -> list:
        """Row of the start in linked rows: row[class] (or row[byte]) is the
        next row, row[-1] the accepted rules, -1 in the dead state."""
        step = self.step[:, list(self.classes)] if by_byte else self.step
        rows = [[None] * (step.shape[1] + 1) for _ in range(len(step))]
        for s, nexts in enumerate(step.tolist()):
            rows[s][:-1] = [rows[t] for t in nexts]
            rows[s][-1] = -1 if s == self.dead else int(self.accept[s])
        return rows[0]


def _byte_classes(sets: list[frozenset]) -> tuple[bytes, list[int]]:
    kinds: dict[tuple, int] = {}
    of = bytearray(256)
    samples = []
    for b in range(256):
        sign = tuple(b in s for s in sets)
        if sign not in kinds:
            kinds[sign] = len(kinds)
            samples.append(b)
        of[b] = kinds[sign]
    return bytes(of), samples


def compile_dfa(rules: list[tuple], anywhere: bool) -> Dfa:
    """Minimal automaton of the rules; anywhere: matches may start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    goals = {}
    for r, e in enumerate(rules):
        s = nfa.state()
        nfa.empty[start].append(s)
        goals[nfa.add(e, s)] = 1 << r
    if anywhere:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.on[loop] = (ANY, start)
    classes, samples = _byte_classes(list({on[0] for on in nfa.on if on}))
    first = nfa.closure([start])
    number, todo, step, accept, closed = {first: 0}, [first], [], [], {}
    for states in todo:  # grows while it is read
        edges = [nfa.on[s] for s in states if nfa.on[s]]
        accept.append(sum(goals[s] for s in states if s in goals))
        row = []
        for b in samples:
            next_ = frozenset(t for on, t in edges if b in on)
            to = closed.get(next_)
            if to is None:
                to = closed[next_] = nfa.closure(next_)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        step.append(row)
    return _minimal(classes, np.array(step, dtype=np.int32), np.array(accept, dtype=np.int64))


def _minimal(classes: bytes, step: np.ndarray, accept: np.ndarray) -> Dfa:
    block = np.unique(accept, return_inverse=True)[1].ravel()
    while True:
        sign = np.column_stack([block, block[step]])
        finer = np.unique(sign, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # Number the blocks so that the start's is 0.
    order = np.unique(block, return_index=True)[1]
    rank = np.arange(len(order))
    rank[[0, block[0]]] = rank[[block[0], 0]]
    small = np.empty((len(order), step.shape[1]), dtype=np.int32)
    small[rank] = rank[block[step[order]]]
    goal = np.empty(len(order), dtype=np.int64)
    goal[rank] = accept[order]
    dead = [s for s in range(len(order)) if not goal[s] and (small[s] == s).all()]
    return Dfa(classes, small, goal, dead[0] if dead else -1)
