"""Regular expressions over bytes, compiled to minimal deterministic automata.

The syntax is the part that secret rules need: literals, escapes (``\\.``, ``\\x20``), classes with
ranges and negation, groups, ``(?i:...)`` for ASCII letters in either case, ``|``, ``?``, ``*``,
``+`` and ``{m}``, ``{m,}``, ``{m,n}``.  Patterns are ASCII; a negated class covers every other byte.
"""

from __future__ import annotations

from dataclasses import dataclass


class _Reader:
    """Recursive descent to a tree of ("set", bytes), ("cat", ..), ("alt", ..), ("rep", x, m, n)."""

    def __init__(self, text: str):
        self.s, self.i, self.fold = text, 0, False

    def tree(self):
        t = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unread pattern text at {self.i}: {self.s!r}")
        return t

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, x):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i:end].partition(",")
                self.i = end + 1
                x = ("rep", x, int(low), (int(high) if high else None) if comma else int(low))
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            was = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            t = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group: {self.s!r}")
            self.i, self.fold = self.i + 1, was
            return t
        if c == "[":
            return ("set", self.cased(self.klass()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            self.i -= 1
            return ("set", self.cased({self.code()}))
        return ("set", self.cased({ord(c)}))

    def code(self) -> int:
        c = self.s[self.i]
        if c != "\\":
            self.i += 1
            return ord(c)
        n = self.s[self.i + 1]
        if n == "x":
            v = int(self.s[self.i + 2:self.i + 4], 16)
            self.i += 4
            return v
        if n.isalnum():
            raise ValueError(f"unknown escape \\{n}")
        self.i += 2
        return ord(n)

    def klass(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.code()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self.code() + 1))
            else:
                found.add(low)
        self.i += 1
        return frozenset(range(256)) - found if negated else frozenset(found)

    def cased(self, codes) -> frozenset:
        if not self.fold:
            return frozenset(codes)
        return frozenset(x for c in codes for x in (ord(chr(c).lower()), ord(chr(c).upper())) if x < 256)


def parse(pattern: str):
    return _Reader(pattern).tree()


def reverse(tree):
    """The tree of the mirrored language."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(x) for x in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "cat" else parts))


def earliest(tree):
    """The tree without what repeats at its end: its matches end where a match of ``tree`` first can."""
    if tree[0] == "rep":
        return ("rep", tree[1], tree[2], tree[2])
    if tree[0] == "cat" and len(tree) > 1:
        return (*tree[:-1], earliest(tree[-1]))
    return tree


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.free) - 1

    def build(self, t, a: int) -> int:
        """Adds the automaton of ``t`` from state ``a``; returns its last state."""
        if t[0] == "set":
            b = self.state()
            self.moves[a].append((t[1], b))
            return b
        if t[0] == "cat":
            for x in t[1:]:
                a = self.build(x, a)
            return a
        if t[0] == "alt":
            b = self.state()
            for x in t[1:]:
                s = self.state()
                self.free[a].append(s)
                self.free[self.build(x, s)].append(b)
            return b
        _, x, low, high = t
        for _ in range(low):
            a = self.build(x, a)
        if high is None:
            s, b = self.state(), self.state()
            self.free[a].append(s)
            e = self.build(x, s)
            self.free[e].append(s)
            self.free[a].append(b)
            self.free[e].append(b)
            return b
        b = self.state()
        self.free[a].append(b)
        for _ in range(high - low):
            a = self.build(x, a)
            self.free[a].append(b)
        return b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` is a bit mask of
    rules.  States are numbered so that those from ``first_accept`` on accept; state numbers in
    ``table`` and ``start`` are times 256.  ``dead`` is a state that never accepts again, or -1."""

    table: list
    accepts: list
    start: int
    first_accept: int
    dead: int


def compile_rules(trees, anywhere: bool = False) -> Dfa:
    """Subset construction and minimisation of one automaton for all ``trees``.

    ``anywhere``: a match may begin at every byte, so one pass over a text meets the end of
    every match of every rule.
    """
    nfa = _Nfa()
    start = nfa.state()
    last: dict[int, int] = {}
    for k, t in enumerate(trees):
        s = nfa.state()
        nfa.free[start].append(s)
        last[nfa.build(t, s)] = k
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))
    # Bytes that no rule tells apart are one symbol.
    sets = list({m for row in nfa.moves for m, _ in row})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    symbol_of = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    symbols = [symbol_of[sig] for sig in signature]
    example = {s: b for b, s in enumerate(symbols)}
    ids = {nfa.closure([start]): 0}
    order = list(ids)
    rows: list[list[int]] = []
    for subset in order:
        row = []
        for s in range(len(symbol_of)):
            nxt = nfa.closure({n for q in subset for chars, n in nfa.moves[q] if example[s] in chars})
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    accepts = [sum(1 << last[q] for q in subset if q in last) for subset in order]
    # Refine the partition by accepted rules until no symbol tells two states of a block apart.
    block = {m: i for i, m in enumerate(dict.fromkeys(accepts))}
    part = [block[m] for m in accepts]
    while True:
        keys = [(part[q], *(part[n] for n in rows[q])) for q in range(len(rows))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        refined = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = refined
    groups = sorted(set(part), key=lambda g: (accepts[part.index(g)] != 0, g))
    number = {g: i for i, g in enumerate(groups)}
    offset = [i * 256 for i in range(len(groups))]  # one object per state keeps the table small
    table, masks, dead = [], [], -1
    for i, g in enumerate(groups):
        q = part.index(g)
        nxt = [number[part[rows[q][s]]] for s in range(len(symbol_of))]
        table += [offset[nxt[symbols[b]]] for b in range(256)]
        masks.append(accepts[q])
        if not accepts[q] and set(nxt) == {i}:
            dead = i * 256
    first = next((i for i, m in enumerate(masks) if m), len(masks))
    return Dfa(table, masks, number[part[0]] * 256, first * 256, dead)
