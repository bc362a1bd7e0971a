"""Cheapest repairs of a whole sequence from a table of all its spans.

The table holds for each span and each symbol, and each beginning of a rule, the cheapest repair that makes the span derive
from it. It is filled from short spans to long ones, those of one length at once: a beginning of a rule and the symbol behind
it meet at every inner position; within a span the rest follows from rules of one part and from parts that are put in as a
whole. Its work depends on the length of the sequence and not on how many edits it takes, so no cost is left open.

A cost and the slot of the first edit share one number, the cost in front: the least number is, of equally cheap repairs, the
one that begins first. A position has a slot for edits at it and behind that one for each way its group may be repaired
within, in the order of their paths.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

import numpy as np

if TYPE_CHECKING:
    from graphloom.llm.syntax.chart import Grammar

#: Bytes the table of a sequence may take; longer sequences are searched layer by layer, to the same result.
BYTES = 300_000_000


class Solved(NamedTuple):
    """The cheapest repair of a sequence under a symbol."""

    cost: int
    rank: int  # of its path among those of the same sequence under other symbols, from 1
    at: int  # position of the first edit
    within: str | tuple | None  # the symbol under which the group there is repaired, or the path within it; None if the edit is at the position itself


class Table:
    """A grammar's rules in two parts each, and what follows within a span."""

    def __init__(self, g: Grammar) -> None:
        self.terminals = sorted(s for s in set(g.symbol) if s and s[0] == "'")
        self.node: dict[object, int] = {s: k for k, s in enumerate((*self.terminals, *g.rules))}
        self.inserted = g.insertions
        self.far = max(g.insertions.values(), default=0) + 10**9
        #: tokens of the shortest text of each symbol, in front of a token and at the end of the sequence
        self.empty, self.empty_at_end = self._empty(g, {}), self._empty(g, {"'ENDMARK": 0})
        pairs: list[tuple[int, int, int]] = []
        edges: set[tuple[int, int, bool, int, int]] = set()  # target, source, whether what is put in comes behind it, its tokens, those at the end
        for name, alternatives in g.rules.items():
            for rhs in alternatives:
                state, none = self.node[rhs[0]] if rhs else self.node[name], self.empty[rhs[0]] if rhs else 0
                for k, s in enumerate(rhs[1:], 2):
                    beginning = tuple(rhs[:k])
                    if beginning not in self.node:
                        self.node[beginning] = len(self.node)
                        pairs.append((state, self.node[s], self.node[beginning]))
                    new = self.node[beginning]
                    edges.add((new, self.node[s], False, none, none))
                    edges.add((new, state, True, self.empty[s], self.empty_at_end[s]))
                    state, none = new, none + self.empty[s]
                if state != self.node[name]:
                    edges.add((self.node[name], state, False, 0, 0))
        self.left, self.right, self.made = (np.array([p[k] for p in pairs], dtype=np.intp) for k in range(3))
        kept = sorted(e for e in edges if min(e[3:]) < 10**9 and e[0] != e[1])
        self.target, self.source = (np.array([e[k] for e in kept], dtype=np.intp) for k in range(2))
        self.behind = np.array([e[2] for e in kept], dtype=bool)
        self.weights = np.array([e[3:] for e in kept], dtype=np.int64).reshape(-1, 2)
        self.targets, self.first = np.unique(self.target, return_index=True)
        self.dearest = max((w for w in (*self.empty.values(), *self.empty_at_end.values()) if w < 10**9), default=0)
        self.replaced = np.array([self.inserted[s] == 1 for s in self.terminals])
        self.row = {s: k for k, s in enumerate(self.terminals)}

    def _empty(self, g: Grammar, known: dict[str, int]) -> dict[str, int]:
        out = {s: known.get(s, self.inserted[s]) for s in self.terminals} | dict.fromkeys(g.rules, self.far)
        grown = True
        while grown:
            grown = False
            for name, alternatives in g.rules.items():
                n = min((sum(out[s] for s in rhs) for rhs in alternatives), default=self.far)
                if n < out[name]:
                    out[name], grown = n, True
        return out

    def fits(self, n: int) -> bool:
        """Whether the table of a sequence of ``n`` tokens may be held."""
        return 4 * n * (n + 1) * max(1, len(self.left)) <= BYTES

    def solve(self, tokens: list[tuple[str | None, int, dict[str, Solved]]], starts: list[str]) -> dict[str, Solved]:
        """The cheapest repairs of a sequence under each of ``starts``. Tokens: kind (None of groups), size, repairs of a group by terminal."""
        n = len(tokens)
        if not starts or not n:
            return self._ranked({s: (self.empty_at_end[s], 0, None) for s in starts})
        stride = 1 + max(max((r.rank for r in t[2].values()), default=0) for t in tokens)
        one = 1 << ((n + 1) * stride).bit_length()  # one edit
        sizes = np.cumsum([0, *(t[1] for t in tokens)], dtype=np.int64)
        small = (int(sizes[-1]) + 2 * self.dearest + sum(max((r.cost for r in t[2].values()), default=0) for t in tokens)) * one < 1 << 28
        kind, far = (np.int32, 1 << 29) if small else (np.int64, 1 << 61)
        sizes = (sizes * one).astype(kind)
        slots = (np.arange(n + 1) * stride).astype(kind)
        mask = kind(-one)  # leaves the cost
        row, terminals = self.row, len(self.terminals)
        read = np.full((terminals, n), far, kind)
        for k, (name, _, repairs) in enumerate(tokens):
            if name is not None:
                read[self.replaced, k] = one + k * stride
                if "'" + name in row:
                    read[row["'" + name], k] = 0
            for s, r in repairs.items():
                read[row[s], k] = r.cost * one + k * stride + r.rank if r.cost else 0
        ends = row.get("'ENDMARK")
        if ends is not None:
            read[ends] = far
        behind = self.behind[:, None]
        weights = np.where(self.weights < 10**9, self.weights * one, far).astype(kind)
        keep = np.where(self.behind | (self.weights[:, 0] == 0), kind(-1), mask)[:, None].astype(kind)
        lefts = [np.empty((n - i, len(self.left)), kind) for i in range(n)]
        rights = [np.empty((j, len(self.left)), kind) for j in range(n + 1)]
        whole: list[list[int]] = []  # of the spans that begin the sequence, the starts' numbers
        asked = np.array([self.node[s] for s in starts], dtype=np.intp)
        source, targets, first = self.source, self.targets, self.first
        for length in range(1, n + 1):
            spans = n - length + 1
            x = np.full((len(self.node), spans), far, kind)
            x[:terminals] = read[:, length - 1 :]
            if length > 1:  # all but the last token goes
                x[:terminals] = np.minimum((x[:terminals] & mask) + (sizes[length - 1 : n] - sizes[:spans] + slots[:spans]), far)
                for i in range(spans):
                    a, b = lefts[i][: length - 1], rights[i + length][i + 1 : i + length]
                    x[self.made, i] = np.minimum((a + np.where(a > 0, b & mask, b)).min(axis=0, initial=far), far)
            if ends is not None:
                x[ends, -1] = sizes[n] - sizes[n - length] + slots[n - length]
            # what an edge adds, to something without edit and to something with
            more = np.repeat(weights[:, :1], spans, axis=1)
            more[:, -1] = weights[:, 1]
            bare = more + (more > 0) * np.where(behind, slots[length:], slots[:spans])
            more = np.where(behind, more, bare)
            while len(targets):
                got = x[source]
                got = (got & keep) + np.where(got == 0, bare, more)
                best, old = np.minimum.reduceat(got, first, axis=0), x[targets]
                if not (best < old).any():
                    break
                x[targets] = np.minimum(best, old)
            for i in range(spans):
                lefts[i][length - 1] = x[self.left, i]
                rights[i + length][i] = x[self.right, i]
            whole.append(x[asked, 0].tolist())
        out = {}
        for k, s in enumerate(starts):
            total = min(self.empty[s], far // one) * one + int(sizes[n])
            for j, numbers in enumerate(whole, 1):
                gone = int(sizes[n] - sizes[j])
                total = min(total, numbers[k] + gone + (int(slots[j]) if gone and not numbers[k] else 0))
            cost, slot = divmod(total, one)
            at, rank = divmod(slot, stride)
            out[s] = (cost, at, next(t for t, r in tokens[at][2].items() if r.rank == rank and r.cost)[3:-1] if rank else None, slot)
        return self._ranked(out)

    @staticmethod
    def _ranked(found: dict[str, tuple]) -> dict[str, Solved]:
        ranks = {slot: k for k, slot in enumerate(sorted({f[-1] or 0 for f in found.values() if f[0]}), 1)}
        return {s: Solved(f[0], ranks[f[-1] or 0] if f[0] else 0, f[1], f[2]) for s, f in found.items()}
