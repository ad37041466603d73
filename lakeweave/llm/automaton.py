"""Regular expressions over bytes, compiled to minimal deterministic automata in transition arrays.

Syntax: bytes, classes with ranges and ^, \\xNN, groups, |, ?, *, +, {m}, {m,}, {m,n}. A machine for several rules keeps
for each state the set of rules that it accepts.
"""

from __future__ import annotations

import numpy as np

ALL = (1 << 256) - 1


class Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[int, int]]] = []  # (set of bytes as a bit mask, state)

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def turned(self) -> Nfa:
        """All arrows the other way round."""
        out = Nfa()
        for _ in self.empty:
            out.state()
        for a, (empty, steps) in enumerate(zip(self.empty, self.steps, strict=True)):
            for b in empty:
                out.empty[b].append(a)
            for mask, b in steps:
                out.steps[b].append((mask, a))
        return out


class _Parser:
    def __init__(self, text: str, nfa: Nfa, fold: bool):
        self.t, self.i, self.nfa, self.fold = text, 0, nfa, fold

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def either(self, a: int) -> int:
        ends = [self.chain(a)]
        while self.peek() == "|":
            self.i += 1
            ends.append(self.chain(a))
        out = self.nfa.state()
        for e in ends:
            self.nfa.empty[e].append(out)
        return out

    def chain(self, a: int) -> int:
        at = self.nfa.state()
        self.nfa.empty[a].append(at)
        while self.peek() not in ("", "|", ")"):
            at = self.repeated(at)
        return at

    def repeated(self, a: int) -> int:
        begin = self.i
        self.skip_atom()
        low, high = self.counts()
        after, at = self.i, a
        for _ in range(low):
            at = self.again(begin, at)
        if high is None:
            loop = self.nfa.state()
            self.nfa.empty[at].append(loop)
            self.nfa.empty[self.again(begin, loop)].append(loop)
            at = loop
        else:
            ends = [at]
            for _ in range(high - low):
                at = self.again(begin, at)
                ends.append(at)
            at = self.nfa.state()
            for e in ends:
                self.nfa.empty[e].append(at)
        self.i = after
        return at

    def again(self, begin: int, a: int) -> int:
        self.i = begin
        return self.atom(a)

    def skip_atom(self) -> None:
        spare, self.nfa = self.nfa, Nfa()
        self.atom(self.nfa.state())
        self.nfa = spare

    def counts(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        close = self.t.index("}", self.i)
        low, comma, high = self.t[self.i + 1 : close].partition(",")
        self.i = close + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def byte(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        if self.t[self.i] == "x":
            self.i += 3
            return int(self.t[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(self.t[self.i - 1])

    def atom(self, a: int) -> int:
        if self.peek() == "(":
            self.i += 1
            out = self.either(a)
            self.i += 1
            return out
        if self.peek() == "[":
            self.i += 1
            negative = self.peek() == "^"
            self.i += negative
            mask = 0
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.t[self.i + 1] != "]":
                    self.i += 1
                    high = self.byte()
                for b in range(low, high + 1):
                    mask |= 1 << b
            self.i += 1
            mask = ALL ^ mask if negative else mask
        else:
            mask = 1 << self.byte()
        if self.fold:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> b + 32 & 1:
                    mask |= 1 << b | 1 << b + 32
        out = self.nfa.state()
        self.nfa.steps[a].append((mask, out))
        return out


class Machine:
    """``next[state * classes + class_of[byte]]`` is the next state times ``classes``. ``accepts[state]`` is a bit mask of rules.

    States from ``first`` on accept something. ``dead`` is the state that nothing leaves, or -1. A machine that reads
    ``backwards`` accepts, after the bytes from a text's end to some place, the rules of which a match begins at that place.
    """

    def __init__(self, rules: list[tuple[str, bool]], backwards: bool = False):
        nfa, goals, ends = Nfa(), {}, []
        start = nfa.state()
        for k, (text, fold) in enumerate(rules):
            begin = nfa.state() if backwards else start
            ends.append(_Parser(text, nfa, fold).either(begin))
            goals[begin if backwards else ends[-1]] = 1 << k
        if backwards:
            nfa = nfa.turned()
            nfa.empty[start] += ends
            nfa.steps[start].append((ALL, start))
        groups: dict[tuple, int] = {}
        masks = sorted({m for s in nfa.steps for m, _ in s})
        class_of = [groups.setdefault(tuple(m >> b & 1 for m in masks), len(groups)) for b in range(256)]
        sample = [class_of.index(c) for c in range(len(groups))]

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        begin = closed({start})
        names, order, table = {begin: 0}, [begin], []
        for now in order:  # grows meanwhile: subset construction
            row = []
            for b in sample:
                to = closed({t for s in now for m, t in nfa.steps[s] if m >> b & 1})
                if to not in names:
                    names[to] = len(order)
                    order.append(to)
                row.append(names[to])
            table.append(row)
        accepts = [sum({goals[s] for s in now if s in goals}) for now in order]
        part = accepts  # minimisation: split the states until each part agrees on all classes
        while True:
            ids: dict[tuple, int] = {}
            new = [ids.setdefault((part[s], *[part[t] for t in row]), len(ids)) for s, row in enumerate(table)]
            if len(ids) == len(set(part)):
                break
            part = new
        one = {p: s for s, p in reversed(list(enumerate(part)))}
        ranked = sorted(one, key=lambda p: (accepts[one[p]] != 0, one[p]))
        place = {p: i for i, p in enumerate(ranked)}
        n = len(groups)
        self.classes, self.class_of = n, np.array(class_of, np.uint8)
        self.next = np.array([place[part[t]] * n for p in ranked for t in table[one[p]]], np.int32)
        self.accepts = [accepts[one[p]] for p in ranked]
        self.start = place[part[0]] * n
        self.first = sum(not a for a in self.accepts)
        dead = [i for i, p in enumerate(ranked) if not accepts[one[p]] and all(part[t] == p for t in table[one[p]])]
        self.dead = dead[0] * n if dead else -1
        self._next, self._class = self.next.tolist(), bytes(class_of)

    def longest(self, text: bytes, at: int) -> int:
        """Where the longest match that begins at ``at`` ends, or -1."""
        s, end, step, kind, dead, first = self.start, -1, self._next, self._class, self.dead, self.first * self.classes
        for i in range(at, len(text)):
            s = step[s + kind[text[i]]]
            if s == dead:
                break
            if s >= first:
                end = i + 1
        return end

    def begins(self, text: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a machine that reads backwards: the places where matches begin, in order, and the bit masks of the rules.

        One pass over the bytes of all lines (``starts`` and ``sizes``), many lines abreast.
        """
        order = np.argsort(-sizes, kind="stable")
        end, size = (starts + sizes)[order].astype(np.int64), sizes[order]
        kinds = self.class_of[np.frombuffer(text, np.uint8)] if text else np.empty(0, np.uint8)
        state, first, falling, j = np.full(len(end), self.start, np.int32), self.first * self.classes, -size, 0
        at, met = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        live = int(np.searchsorted(falling, 0))
        while live >= 100:
            here = end[:live] - 1 - j
            s = self.next[state[:live] + kinds[here]]
            state[:live] = s
            if (hit := np.flatnonzero(s >= first)).size:
                at.append(here[hit])
                met.append(s[hit])
            j += 1
            live = int(np.searchsorted(falling, -j))
        step, kind = self._next, self._class
        for i in range(live):  # a few long lines are left
            s, here, states = int(state[i]), int(end[i] - size[i]), []
            own = []
            for k in range(int(end[i]) - 1 - j, here - 1, -1):
                s = step[s + kind[text[k]]]
                if s >= first:
                    own.append(k)
                    states.append(s)
            at.append(np.array(own, np.int64))
            met.append(np.array(states, np.int32))
        places = np.concatenate(at)
        order = np.argsort(places)
        return places[order], np.array(self.accepts, np.int64)[np.concatenate(met)[order] // self.classes]
