"""Regular expressions compiled to one deterministic automaton over bytes.

Each rule is parsed into a nondeterministic automaton; subset construction keeps
its threads ordered by start, so a rule's matches are the leftmost, longest,
non-overlapping ones.  The product of all rules is minimised and stored as one
flat transition array over byte classes; a negative entry means that some rule's
match has just ended.  A small reversed automaton of that rule then finds where
the match began.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

import numpy as np

_END = 256  # symbol after the last byte


@dataclass(frozen=True)
class Rule:
    """``pattern``: an ASCII regex without look-around or back-references; ``any_case``: ASCII letters match in either case."""

    kind: str
    pattern: str
    any_case: bool = False


class _Nfa:
    def __init__(self, rule: Rule, reverse: bool = False):
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []
        self.any_case, self.reverse = rule.any_case, reverse
        self.start = self._node()
        self.accept = self._build(list(sre_parse.parse(rule.pattern)), self.start)

    def _node(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1

    def _chars(self, codes) -> frozenset:
        codes = set(codes)
        if self.any_case:
            codes |= {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        if max(codes, default=0) > 127:
            raise ValueError("rules are ASCII")
        return frozenset(codes)

    def _one(self, op, arg) -> frozenset:
        if op is sre.LITERAL:
            return self._chars([arg])
        if op is sre.IN:
            codes: set[int] = set()
            for o, a in arg:
                if o is sre.LITERAL:
                    codes.add(a)
                elif o is sre.RANGE:
                    codes.update(range(a[0], a[1] + 1))
                else:
                    raise ValueError(f"{o} is not supported")
            return self._chars(codes)
        raise ValueError(f"{op} is not supported")

    def _build(self, items, at: int) -> int:
        for op, arg in reversed(items) if self.reverse else items:
            if op in (sre.LITERAL, sre.IN):
                to = self._node()
                self.on[at].append((self._one(op, arg), to))
                at = to
            elif op is sre.SUBPATTERN:
                at = self._build(list(arg[3]), at)
            elif op is sre.BRANCH:
                out = self._node()
                for branch in arg[1]:
                    start = self._node()
                    self.eps[at].append(start)
                    self.eps[self._build(list(branch), start)].append(out)
                at = out
            elif op is sre.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self._build(list(body), at)
                if most is sre.MAXREPEAT:
                    loop = self._node()
                    self.eps[at].append(loop)
                    self.eps[self._build(list(body), loop)].append(loop)
                    at = loop
                else:
                    out = self._node()
                    self.eps[at].append(out)
                    for _ in range(most - least):
                        at = self._build(list(body), at)
                        self.eps[at].append(out)
                    at = out
            else:
                raise ValueError(f"{op} is not supported")
        return at

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def step(self, nodes, byte: int) -> frozenset:
        return self.closure({to for n in nodes for chars, to in self.on[n] if byte in chars})

    def sets(self):
        return {chars for on in self.on for chars, _ in on}


class _Search:
    """One rule's leftmost-longest search; states are (threads ordered by start, matched)."""

    def __init__(self, rule: Rule):
        self.nfa = _Nfa(rule)
        self.first = self.nfa.closure({self.nfa.start})
        if self.nfa.accept in self.first:
            raise ValueError(f"{rule.kind}: an empty match is not supported")
        self.kind = rule.kind

    initial = ((), False)

    def _advance(self, state, byte):
        threads, matched = state
        out, seen = [], set()
        for t in (*threads, *(() if matched else (self.first,))):
            n = self.nfa.step(t, byte) - seen
            if n:
                seen |= n
                out.append(n)
                if self.nfa.accept in n:
                    return tuple(out), True
        return tuple(out), matched

    def step(self, state, byte):
        """(next state, whether a match ended before this byte)."""
        threads, matched = state
        if byte == _END:
            return self.initial, matched
        nxt = self._advance(state, byte)
        if matched and not any(self.nfa.accept in t for t in nxt[0]):
            if nxt[0] and any(self.nfa.accept not in t for t in nxt[0]):
                raise ValueError(f"{self.kind}: a match of this rule may have to give bytes back")
            return self._advance(self.initial, byte), True
        return nxt, False


class Automaton:
    """Flat transition array of the minimised product of all rules."""

    def __init__(self, rules: list[Rule], most: int = 50_000):
        self.kinds = [r.kind for r in rules]
        search = [_Search(r) for r in rules]
        sets = sorted({tuple(sorted(s)) for x in search for s in x.nfa.sets()})
        signature: dict[tuple, int] = {}
        self.classes = bytearray(256)
        members: list[int] = []
        for b in range(256):
            key = tuple(b in s for s in map(frozenset, sets))
            if key not in signature:
                signature[key] = len(signature)
                members.append(b)
            self.classes[b] = signature[key]
        self.classes = bytes(self.classes)
        symbols = [*members, _END]
        self.end = len(members)
        self.width = len(symbols)
        cache: list[dict] = [{} for _ in rules]

        def step(i, state, byte):
            got = cache[i].get((state, byte))
            if got is None:
                got = cache[i][state, byte] = search[i].step(state, byte)
            return got

        start = tuple(x.initial for x in search)
        number, order, table, events = {start: 0}, [start], [], []
        for state in order:
            row, said = [], []
            for byte in symbols:
                parts = [step(i, s, byte) for i, s in enumerate(state)]
                nxt = tuple(p[0] for p in parts)
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                    if len(order) > most:
                        raise ValueError("too many states; use fewer counted repetitions")
                row.append(number[nxt])
                said.append(sum(1 << i for i, p in enumerate(parts) if p[1]))
            table.append(row)
            events.append(said)
        self.built = len(order)
        self._minimise(np.array(table), np.array(events))
        self.reverse = [_Nfa(r, reverse=True) for r in rules]
        self._back: list[dict] = [{} for _ in rules]

    def _minimise(self, table: np.ndarray, events: np.ndarray) -> None:
        """Moore's partition refinement, states first told apart by the matches they report."""
        block = np.unique(events, axis=0, return_inverse=True)[1].ravel()
        while True:
            new = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        rep = np.unique(block, return_index=True)[1]
        self.states = len(rep)
        self.start = int(block[0]) * self.width
        self.table: list[int] = []
        self.events: list[tuple[int, tuple[int, ...]]] = []
        known: dict[tuple[int, int], int] = {}
        for r in rep:
            for to, said in zip(block[table[r]] * self.width, events[r]):
                if said:
                    key = (int(to), int(said))
                    if key not in known:
                        known[key] = len(self.events)
                        self.events.append((int(to), tuple(i for i in range(len(self.kinds)) if said >> i & 1)))
                    self.table.append(-1 - known[key])
                else:
                    self.table.append(int(to))

    def _begin(self, rule: int, data: bytes, end: int, floor: int) -> int:
        """Smallest start of a match of ``rule`` that ends at ``end``."""
        nfa, memo = self.reverse[rule], self._back[rule]
        state, at, best = nfa.closure({nfa.start}), end, -1
        while state and at > floor:
            at -= 1
            nxt = memo.get((state, data[at]))
            if nxt is None:
                nxt = memo[state, data[at]] = nfa.step(state, data[at])
            state = nxt
            if nfa.accept in state:
                best = at
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """All (rule, start, end) in byte offsets, in one pass over ``data``."""
        table, s, found = self.table, self.start, []
        last = [0] * len(self.kinds)
        at = -1
        for at, c in enumerate(data.translate(self.classes)):
            s = table[s + c]
            if s < 0:
                s, rules = self.events[-1 - s]
                for r in rules:
                    found.append((r, self._begin(r, data, at, last[r]), at))
                    last[r] = at
        s = table[s + self.end]
        if s < 0:
            for r in self.events[-1 - s][1]:
                found.append((r, self._begin(r, data, at + 1, last[r]), at + 1))
        return found
