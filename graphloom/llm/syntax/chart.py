"""Chart parsing at minimum edit cost over nested groups of tokens.

A text is a sequence of token kinds in which each bracketed part is one token, a :class:`Group`. A group's content is a
constituent of its own: it is parsed once for each start symbol it is asked for, and equal contents share one entry of the
chart whichever file they stand in. The cost of a sequence under a symbol is the least number of insertions, deletions
and replacements of tokens that makes it derivable, where a bracketed part is kept and repaired within, or goes or comes as a
whole with all its tokens: :meth:`Grammar.accepts` is the layer of cost nothing of that chart, :meth:`Grammar.repair` the
layers above it, one after the other until one holds a repair. What is asked for in the end, :meth:`Grammar.cheapest`, is exact and has
no bound: it takes the table of all spans (:mod:`graphloom.llm.syntax.table`), and the layers where a sequence is too long for that.

Nesting may be of any depth: groups know their height, and deep ones are decided from the inside out.
"""

from __future__ import annotations

import re
from itertools import count

from graphloom.llm.syntax.table import Solved, Table

#: Entries a worker keeps before the shared chart is started anew, between two files; results do not depend on it.
KEPT = 300_000
#: Levels of nesting decided by one recursion.
LEVELS = 100
#: Tokens of a group whose repairs are sought without asking whether they matter.
WIDE = 64

_numbers = count()
_known: dict[tuple, int] = {}


class Group:
    """A bracketed part. Equal parts have one number, whichever file they stand in; ``offsets`` are those of this one's content."""

    __slots__ = ("open", "content", "at", "offsets", "number", "height", "size", "widest")

    def __init__(self, open_: str, content: tuple, at: int, offsets: tuple = ()) -> None:
        self.open, self.content, self.at, self.offsets = open_, content, at, offsets
        inner = [t for t in content if t.__class__ is Group]
        key = (open_, *(t.number if t.__class__ is Group else t for t in content)) if inner else (open_, *content)
        number = _known.get(key)
        self.number = _known.setdefault(key, next(_numbers)) if number is None else number
        self.height = 1 + max((t.height for t in inner), default=0)
        self.size = 2 + len(content) - len(inner) + sum(t.size for t in inner)
        self.widest = max(len(content), max((t.widest for t in inner), default=0))

    def __hash__(self) -> int:
        return self.number

    def __eq__(self, other: object) -> bool:
        return other.__class__ is Group and self.number == other.number


class Exhausted(Exception):
    """The search for a repair took more chart items than it was given."""


FAR = 10**9
#: The path of a repair without edit, behind all others.
NOWHERE = (FAR,)

_EBNF = re.compile(r"\s*(?:'([^']+)'|\"([^\"]+)\"|([A-Z][A-Z_]*)\b|([(\[{`]<\w+>)|(\w+)|([()|*+?]))")


class Grammar:
    """Context-free grammar from EBNF: ``name := alternatives``; 'x' and NAME are kinds, ``(<args>)`` style terminals ``(<args>`` are
    groups whose content derives from ``args``. ENDMARK matches the end of a sequence. ``lists``: symbols that are repetitions
    of another one, parsed element by element; elements end with ``ends``, and after a block unless ``continues`` has what follows."""

    def __init__(self, text: str, lists: dict[str, str] | None = None, continues: frozenset[str] = frozenset(), ends: str = ";") -> None:
        self.lists = lists or {}
        self.continues = continues
        self.ends = ends
        self.rules: dict[str, list[list[str]]] = {}
        self._aux = 0
        for line in re.split(r"\n(?=\s*\w+ :=)", text.strip()):
            name, _, body = line.partition(":=")
            self._tokens = self._lex(body)
            self.rules.setdefault(name.strip(), []).extend(self._alternatives(name.strip()))
        self._number()
        self._memo: dict[tuple, int] = {}
        self._inner: dict[tuple[str, int], bool] = {}
        self._costs: dict[tuple[str, int], tuple] = {}
        self._solved: dict[int, dict[str, Solved]] = {}
        self._table: Table | None = None
        self.left_items = 0

    # --- grammar text ---

    @staticmethod
    def _lex(body: str) -> list[tuple[str, str]]:
        out, at = [], 0
        body = body.rstrip()
        while at < len(body):
            m = _EBNF.match(body, at)
            if not m:
                raise ValueError(f"grammar: {body[at:at + 30]!r}")
            at = m.end()
            quoted, quoted2, kind, group, name, op = m.groups()
            if quoted or quoted2:
                out.append(("t", quoted or quoted2))
            elif kind:
                out.append(("t", kind))
            elif group:
                out.append(("t", group))
            elif name:
                out.append(("n", name))
            else:
                out.append(("o", op))
        return out[::-1]

    def _alternatives(self, owner: str) -> list[list[str]]:
        out = [[]]
        while self._tokens:
            what, v = self._tokens[-1]
            if (what, v) == ("o", ")"):
                break
            self._tokens.pop()
            if (what, v) == ("o", "|"):
                out.append([])
                continue
            if (what, v) == ("o", "("):
                inner = self._alternatives(owner)
                self._tokens.pop()
                symbol = self._new(inner)
            else:
                symbol = ("'" + v) if what == "t" else v
            if self._tokens and self._tokens[-1][0] == "o" and self._tokens[-1][1] in "*+?":
                op = self._tokens.pop()[1]
                if op == "?":
                    symbol = self._new([[], [symbol]])
                else:
                    aux = self._new([])
                    self.rules[aux] = [[] if op == "*" else [symbol], [aux, symbol]]
                    symbol = aux
            out[-1].append(symbol)
        return out

    def _new(self, alternatives: list[list[str]]) -> str:
        self._aux += 1
        name = f"_{self._aux}"
        self.rules[name] = alternatives
        return name

    # --- tables ---

    def _number(self) -> None:
        self.symbol: list[str] = []  # symbol after the dot of each dotted rule, '' at its end
        self.left: list[str] = []
        self.starts: dict[str, list[int]] = {}
        for name, alternatives in self.rules.items():
            for rhs in alternatives:
                self.starts.setdefault(name, []).append(len(self.symbol))
                for s in [*rhs, ""]:
                    self.symbol.append(s)
                    self.left.append(name)
        for s in set(self.symbol):
            if s and s[0] != "'" and s not in self.rules:
                raise ValueError(f"grammar: no rule for {s}")
        self.nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for name, alternatives in self.rules.items():
                if name not in self.nullable and any(all(s in self.nullable for s in rhs) for rhs in alternatives):
                    self.nullable.add(name)
                    grown = True
        self.first: dict[str, set[str]] = {n: set() for n in self.rules}
        grown = True
        while grown:
            grown = False
            for name, alternatives in self.rules.items():
                before = len(self.first[name])
                for rhs in alternatives:
                    self.first[name] |= self._first_of(rhs)[0]
                grown |= len(self.first[name]) > before
        #: for each dotted start the classes of tokens it can begin with, None if it may be empty
        self.begin: dict[int, set[str] | None] = {}
        for name, alternatives in self.rules.items():
            for d, rhs in zip(self.starts[name], alternatives):
                f, empty = self._first_of(rhs)
                self.begin[d] = None if empty else f
        self.predicts: dict[tuple[str, str], list[int]] = {}
        #: tokens of the shortest text of each symbol, and symbols a group may be asked for by its bracket
        self.least: dict[str, int] = {}
        grown = True
        while grown:
            grown = False
            for name, alternatives in self.rules.items():
                n = min((sum(self._inserted(s) if s[0] == "'" else self.least.get(s, FAR) for s in rhs) for rhs in alternatives), default=FAR)
                if n < self.least.get(name, FAR):
                    self.least[name], grown = n, True
        self.insertions = {s: self._inserted(s) for s in set(self.symbol) if s and s[0] == "'"}
        self.asked: dict[str, list[str]] = {}
        for s in sorted({s for s in self.symbol if len(s) > 3 and s[2] == "<" and s[1] in "([{`"}):
            self.asked.setdefault(s[1], []).append(s[1:])

    def _inserted(self, terminal: str) -> int:
        """Tokens that inserting a terminal takes."""
        if len(terminal) > 3 and terminal[2] == "<" and terminal[1] in "([{`":
            return 2 + self.least.get(terminal[3:-1], FAR)
        return FAR if terminal in ("'NEVER", "'ENDMARK") else 1

    def _first_of(self, rhs: list[str]) -> tuple[set[str], bool]:
        out: set[str] = set()
        for s in rhs:
            if s[0] == "'":
                out.add(s[1:2] if len(s) > 2 and s[2] == "<" and s[1] in "([{`" else s[1:])
                return out, False
            out |= self.first[s]
            if s not in self.nullable:
                return out, False
        return out, True

    # --- cost nothing ---

    def _matches(self, terminal: str, token: object) -> bool:
        if token.__class__ is Group:
            if len(terminal) < 3 or terminal[1] != "<" or terminal[0] != token.open:
                return False
            key = (terminal, token.number)
            known = self._inner.get(key)
            if known is None:
                known = self._inner[key] = self.accepts(terminal[2:-1], token.content)
            return known
        return terminal == token

    def begin_file(self, seq: tuple) -> None:
        """Forget what was kept if it is much, and decide deep groups from the inside out."""
        if len(self._memo) + len(self._inner) + len(self._costs) + len(self._solved) + len(_known) > KEPT:
            _known.clear()  # numbers are never given twice
            self._memo.clear()
            self._inner.clear()
            self._costs.clear()
            self._solved.clear()
        deep = [t for t in seq if t.__class__ is Group and t.height > LEVELS]
        order = []
        while deep:
            g = deep.pop()
            if g.height % LEVELS == 0:
                order.append(g)
            deep.extend(t for t in g.content if t.__class__ is Group and t.height >= LEVELS)
        for g in sorted(order, key=lambda g: g.height):
            for terminal in self.asked.get(g.open, ()):
                self._matches(terminal, g)

    def accepts(self, start: str, seq: tuple) -> bool:
        """Whether the content derives from ``start`` without an edit."""
        return self.farthest(start, seq) < 0

    def farthest(self, start: str, seq: tuple, last: bool = True) -> int:
        """-1 if ``seq`` derives from ``start``, else how far it is the beginning of something that does. ``last``: nothing follows it."""
        key = (start, seq, last)
        known = self._memo.get(key)
        if known is None:
            known = self._memo[key] = self._by_element(start, seq, last)
        return known

    def _by_element(self, start: str, seq: tuple, last: bool) -> int:
        element = self.lists.get(start)
        if element is None:
            return self._earley(start, seq, last)
        at = 0
        for part in self.elements(seq):
            if self.farthest(element, part, at + len(part) == len(seq)) >= 0:
                return self._earley(start, seq, last)  # the cut may have been wrong: only the whole sequence decides
            at += len(part)
        return -1

    def elements(self, seq: tuple) -> list[tuple]:
        """Likely elements of a list."""
        out, now, n = [], [], len(seq)
        for i, t in enumerate(seq):
            now.append(t)
            nxt = seq[i + 1] if i + 1 < n else None
            if t == self.ends:
                cut = not (t == "NEWLINE" and (nxt.__class__ is Group or (now[0] == "@" and not any(x.__class__ is Group and x.open == "{" for x in now))))
            else:
                cut = t.__class__ is Group and t.open == "{" and (nxt is None or (not nxt.__class__ is Group and nxt not in self.continues))
            if cut:
                out.append(tuple(now))
                now = []
        if now:
            out.append(tuple(now))
        return out

    def _earley(self, start: str, seq: tuple, last: bool = True) -> int:
        symbol, left, nullable = self.symbol, self.left, self.nullable
        n = len(seq)
        waits: list[dict[str, list[tuple[int, int]]]] = []
        current = {(d, 0) for d in self.starts[start]}
        for i in range(n + 1):
            token = seq[i] if i < n else None
            cls = token.open if token.__class__ is Group else token if token is not None else "ENDMARK" if last else ""
            waiting: dict[str, list[tuple[int, int]]] = {}
            waits.append(waiting)
            nxt: set[tuple[int, int]] = set()
            agenda = list(current)
            done = False
            matched: dict[str, bool] = {}
            while agenda:
                item = agenda.pop()
                d, origin = item
                s = symbol[d]
                if not s:
                    name = left[d]
                    if i == n and origin == 0 and name == start:
                        done = True
                    for e, o in waits[origin].get(name, ()):
                        new = (e + 1, o)
                        if new not in current:
                            current.add(new)
                            agenda.append(new)
                elif s[0] == "'":
                    if token is not None:
                        ok = matched.get(s)
                        if ok is None:
                            ok = matched[s] = self._matches(s[1:], token)
                        if ok:
                            nxt.add((d + 1, origin))
                    elif last and s == "'ENDMARK" and (d + 1, origin) not in current:
                        current.add((d + 1, origin))
                        agenda.append((d + 1, origin))
                else:
                    w = waiting.get(s)
                    if w is None:
                        w = waiting[s] = []
                        for p in self._predicted(s, cls):
                            new = (p, i)
                            if new not in current:
                                current.add(new)
                                agenda.append(new)
                    w.append(item)
                    if s in nullable:
                        new = (d + 1, origin)
                        if new not in current:
                            current.add(new)
                            agenda.append(new)
            if i == n:
                return -1 if done else n
            if not nxt:
                return i
            current = nxt
        return n

    # --- edits ---

    def cost_within(self, symbol: str, group: Group, limit: int) -> tuple[int, tuple] | None:
        """(edits, path of the first one) that make the content of a group derive from ``symbol``, None if it takes more than ``limit``."""
        solved = self._solved.get(group.number)
        if solved is not None:
            return (solved[symbol].cost, self._path(solved[symbol], group.content, {})) if solved[symbol].cost <= limit else None
        key = (symbol, group.number)
        found, tried = self._costs.get(key, (None, -1))
        if found is None and tried < limit:
            found = (0, NOWHERE) if self._matches(f"{group.open}<{symbol}>", group) else self.repair(symbol, group.content, limit) if limit else None
            self._costs[key] = (found, limit)
        return found if found is not None and found[0] <= limit else None

    def repair(self, start: str, seq: tuple, limit: int = 1, last: bool = True) -> tuple[int, tuple] | None:
        """(cost, path of the first edit) of the cheapest repair up to ``limit`` edits, None if it takes more.

        A path leads through groups: its last number is a position in the content the others lead to. ``last``: nothing follows ``seq``."""
        symbol, left, inserted = self.symbol, self.left, self.insertions
        n = len(seq)
        far = (limit + 1, ())
        waits: list[dict[str, dict[tuple[int, int], tuple[int, tuple]]]] = []
        #: by position, the fewest edits in front of a symbol that is asked for there; an item costs those and its own
        before: list[dict[str, int]] = [{start: 0}]
        current: dict[tuple[int, int], tuple[int, tuple]] = {(d, 0): (0, NOWHERE) for d in self.starts[start]}
        left_items = self.left_items
        for i in range(n + 1):
            token = seq[i] if i < n else None
            group = token.__class__ is Group
            size = token.size if group else 1
            cls = token.open if group else token if token is not None else "ENDMARK" if last else ""
            waiting: dict[str, dict[tuple[int, int], tuple[int, tuple]]] = {}
            waits.append(waiting)
            if i:
                before.append({})
            here_before = before[i]
            empty: dict[str, tuple[int, tuple]] = {}  # symbols derived here from nothing but insertions
            nxt: dict[tuple[int, int], tuple[int, tuple]] = {}
            # in the order of all edits so far, so that nothing is met again at a lower cost
            agenda: list[list[tuple[tuple[int, int], tuple[int, tuple]]]] = [[] for _ in range(limit + 1)]
            for item, cost in current.items():
                agenda[cost[0] + before[item[1]][left[item[0]]]].append((item, cost))
            for whole in range(limit + 1):
                todo = agenda[whole]
                while todo:
                    item, cost = todo.pop()
                    if current.get(item) != cost:
                        continue  # met again at a lower cost
                    left_items -= 1
                    if left_items < 0:
                        raise Exhausted
                    d, origin = item
                    s = symbol[d]
                    if not s:
                        name = left[d]
                        if origin == i and cost < empty.get(name, far):
                            empty[name] = cost
                        if token is not None and not origin and name == start and whole + size <= limit:  # all that follows is deleted
                            total = (cost[0] + size, min(cost[1], (i,)))
                            if total < nxt.get(item, far):
                                nxt[item] = total
                        for (e, o), c in list(waits[origin].get(name, {}).items()):
                            new, total = (e + 1, o), (c[0] + cost[0], min(c[1], cost[1]))
                            w = total[0] + before[o][left[e]]
                            if w <= limit and total < current.get(new, far):
                                current[new] = total
                                agenda[w].append((new, total))
                    elif s[0] == "'":
                        n_inserted = inserted[s]
                        if s == "'ENDMARK":
                            new = (d + 1, origin)
                            if token is None and last and cost < current.get(new, far):
                                current[new] = cost
                                todo.append((new, cost))
                        elif whole + n_inserted <= limit:
                            new, total = (d + 1, origin), (cost[0] + n_inserted, min(cost[1], (i,)))
                            if total < current.get(new, far):
                                current[new] = total
                                agenda[whole + n_inserted].append((new, total))
                        if token is None:
                            continue
                        if whole + size <= limit:  # deleted
                            total = (cost[0] + size, min(cost[1], (i,)))
                            if total < nxt.get(item, far):
                                nxt[item] = total
                        total = far
                        if not group:
                            if s[1:] == token:
                                total = cost  # read
                            elif n_inserted == 1 and whole < limit:
                                total = (cost[0] + 1, min(cost[1], (i,)))  # replaced
                        elif len(s) > 3 and s[2] == "<" and s[1] == token.open:
                            self.left_items = left_items
                            inner = self.cost_within(s[3:-1], token, limit - whole)
                            left_items = self.left_items
                            if inner is not None:
                                total = (cost[0] + inner[0], min(cost[1], (i, *inner[1])) if inner[0] else cost[1])
                        if total < nxt.get((d + 1, origin), far):
                            nxt[(d + 1, origin)] = total
                    else:
                        if s not in here_before:
                            here_before[s] = whole
                            waiting[s] = {}
                            # without an edit to spare only what begins with the token can go on
                            for p in self.starts[s] if whole < limit else self._predicted(s, cls):
                                new = (p, i)
                                if (0, NOWHERE) < current.get(new, far):
                                    current[new] = (0, NOWHERE)
                                    todo.append((new, (0, NOWHERE)))
                        w = waiting.setdefault(s, {})
                        if cost < w.get(item, far):
                            w[item] = cost
                            if s in empty and whole + empty[s][0] <= limit:
                                new, total = (d + 1, origin), (cost[0] + empty[s][0], min(cost[1], empty[s][1]))
                                if total < current.get(new, far):
                                    current[new] = total
                                    agenda[whole + empty[s][0]].append((new, total))
                            elif s in self.nullable and whole == limit:
                                new = (d + 1, origin)
                                if cost < current.get(new, far):
                                    current[new] = cost
                                    todo.append((new, cost))
            if i == n:
                self.left_items = left_items
                ends = [c for (d, o), c in current.items() if o == 0 and left[d] == start and not symbol[d]]
                return min(ends) if ends else None
            current = nxt
            if not current:
                break
        self.left_items = left_items
        return None

    def _predicted(self, s: str, cls: str) -> list[int]:
        """Dotted rules of a symbol that may begin with a token of a class, or be empty."""
        ps = self.predicts.get((s, cls))
        if ps is None:
            ps = self.predicts[(s, cls)] = [p for p in self.starts[s] if self.begin[p] is None or cls in self.begin[p]]
        return ps

    def _path(self, r: Solved, seq: tuple, solved: dict[int, dict[str, Solved]]) -> tuple:
        """The path of the first edit of a repair of ``seq``."""
        path = []
        while r.cost:
            path.append(r.at)
            if r.within is None:
                return tuple(path)
            if r.within.__class__ is tuple:
                return (*path, *r.within)
            group = seq[r.at]
            r, seq = (solved.get(group.number) or self._solved[group.number])[r.within], group.content
        return NOWHERE

    def _row(self, seq: tuple, solved: dict[int, dict[str, Solved]]) -> list[tuple[str | None, int, dict[str, Solved]]]:
        out = []
        for t in seq:
            if t.__class__ is Group:
                known = self._solved.get(t.number)
                known = solved[t.number] if known is None else known
                out.append((None, t.size, {f"'{t.open}<{s}>": r for s, r in known.items()}))
            else:
                out.append((t, 1, {}))
        return out

    def _below(self, seq: tuple) -> list[Group]:
        """The different groups below a sequence, from the inside out."""
        todo, found = [t for t in seq if t.__class__ is Group], {}
        while todo:
            t = todo.pop()
            if t.number not in found and t.number not in self._solved:
                found[t.number] = t
                todo.extend(x for x in t.content if x.__class__ is Group)
        return sorted(found.values(), key=lambda t: t.height)

    def _bounded(self, t: Group, symbols: list[str], limit: int) -> tuple[dict[str, Solved], dict[str, Solved]]:
        """Repairs of a group from below and from above where only those of up to ``limit`` edits are sought."""
        known = {s: r for s in symbols if (r := self.cost_within(s, t, limit)) is not None}
        ranks = {path: k for k, path in enumerate(sorted({path for cost, path in known.values() if cost}), 2)}
        high = {s: Solved(cost, ranks[path], path[0], path[1:] or None) if cost else Solved(0, 0, 0, None) for s, (cost, path) in known.items()}
        return {s: high.get(s) or Solved(limit + 1, 1, 0, ()) for s in symbols}, high

    def _tabled(self, table: Table, start: str, seq: tuple) -> tuple[int, tuple]:
        """(cost, path of the first edit). Long groups that derive from what they may be asked for, and groups too long for a table, are
        first given bounds: where those leave the result open they are narrowed, until both give the same."""
        limit = 0
        while True:
            low: dict[int, dict[str, Solved]] = {}
            high: dict[int, dict[str, Solved]] = {}
            for t in self._below(seq):
                symbols = [s[2:-1] for s in self.asked.get(t.open, ())]
                n = len(t.content)
                if not table.fits(n) or (not limit and n > WIDE and any(self.cost_within(s, t, 0) for s in symbols)):
                    low[t.number], high[t.number] = self._bounded(t, symbols, limit)
                elif any(x.number in low for x in t.content if x.__class__ is Group):
                    low[t.number], high[t.number] = (table.solve(self._row(t.content, b), symbols) for b in (low, high))
                else:
                    self._solved[t.number] = table.solve(self._row(t.content, {}), symbols)
            r = table.solve(self._row(seq, high), [start])[start]
            found = r.cost, self._path(r, seq, high)
            if not low:
                return found
            r = table.solve(self._row(seq, low), [start])[start]
            if found == (r.cost, self._path(r, seq, low)):
                return found
            limit += max(1, limit // 2)

    def cheapest(self, start: str, seq: tuple, items: int | None = None) -> tuple[int, tuple, bool]:
        """(cost, path of the first edit, whether it is exact) of the cheapest repair. Only a search that is given a number of chart
        ``items`` may end with a bound from below instead."""
        self.left_items = FAR * FAR if items is None else items
        if items is None:
            table = self._table = self._table or Table(self)
            if table.fits(len(seq)):
                return *self._tabled(table, start, seq), True
            for t in self._below(seq):
                if t.widest <= WIDE:
                    self._solved[t.number] = table.solve(self._row(t.content, {}), [s[2:-1] for s in self.asked.get(t.open, ())])
        found, refuted, limit = None, 0, 1
        while found is None:
            try:
                found = self.repair(start, seq, limit)
            except Exhausted:
                return refuted + 1, (0,), False
            if found is None:
                refuted, limit = limit, limit + max(1, limit // 2)  # whatever the limit, what is found is the cheapest
        return *found, True
