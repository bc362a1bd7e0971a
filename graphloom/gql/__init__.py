"""FIND / IMPACT / CALLS / TRACE: a compact query language compiled to DataFrame plans.

``FIND [kind] [WHERE filter] [RETURN a, b] [ORDER BY a [ASC|DESC], ...] [LIMIT n]``; filters compare columns (= != < > <= >= MATCHES)
with AND, OR, parentheses and NOT at the head of a filter or group; logic is SQL's, with three values. MATCHES is a
case-insensitive LIKE %s%. ``IMPACT name``, ``CALLS name [--inbound]``, ``TRACE a b``: names in any form resolve_name takes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import storage, traverse

DEFAULT = ("id", "kind", "name", "qualified_name", "file_path", "language")
#: Longest path TRACE follows.
TRACE_DEPTH = 10

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(-?\d+)\b|(--inbound|[A-Za-z_][\w.:/<>-]*)|(!=|<=|>=|[=<>(),*]))")


class GqlError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GqlError(f"unexpected {text[at:at + 10]!r}")
        s, n, w, o = m.groups()
        out.append(("str", s[1:-1]) if s is not None else ("num", int(n)) if n is not None else ("word", w) if w else ("op", o))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str) -> None:
        self.toks, self.k = _tokens(text), 0

    def word(self, *words: str) -> bool:
        if self.k < len(self.toks) and self.toks[self.k][0] == "word" and str(self.toks[self.k][1]).upper() in words:
            self.k += 1
            return True
        return False

    def op(self, o: str) -> bool:
        if self.k < len(self.toks) and self.toks[self.k] == ("op", o):
            self.k += 1
            return True
        return False

    def next(self, *kinds: str) -> object:
        if self.k >= len(self.toks) or self.toks[self.k][0] not in kinds:
            raise GqlError(f"expected {' or '.join(kinds)}")
        self.k += 1
        return self.toks[self.k - 1][1]

    def filter(self, types: dict[str, str], used: set[str]) -> Column:
        if self.word("NOT"):
            return ~self._or(types, used)
        return self._or(types, used)

    def _or(self, types: dict[str, str], used: set[str]) -> Column:
        c = self._and(types, used)
        while self.word("OR"):
            c = c | self._and(types, used)
        return c

    def _and(self, types: dict[str, str], used: set[str]) -> Column:
        c = self._atom(types, used)
        while self.word("AND"):
            c = c & self._atom(types, used)
        return c

    def _atom(self, types: dict[str, str], used: set[str]) -> Column:
        if self.op("("):
            c = self.filter(types, used)
            if not self.op(")"):
                raise GqlError("expected )")
            return c
        name = str(self.next("word"))
        if name not in types:
            raise GqlError(f"no column {name}")
        used.add(name)
        if self.word("MATCHES"):
            return F.ilike(F.col(name), F.lit(f"%{self.next('str', 'word')}%"))
        for o in ("!=", "<=", ">=", "=", "<", ">"):
            if self.op(o):
                v = F.lit(self.next("str", "num", "word")).cast(types[name])
                c = F.col(name)
                return {"=": c == v, "!=": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[o]
        raise GqlError("expected a comparison")


def _one(graph: PropertyGraph, name: str) -> str:
    row = storage.resolve_name(graph, name).first()
    if row is None:
        raise GqlError(f"no symbol {name}")
    return row[0]


def query(graph: PropertyGraph, text: str) -> DataFrame:
    r = _Reader(text)
    if r.word("FIND"):
        return _find(graph, r)
    verb = str(r.next("word")).upper()
    if verb not in ("IMPACT", "CALLS", "TRACE"):
        raise GqlError(f"unknown verb {verb}")
    name = str(r.next("word", "str"))
    links = graph.edges().filter("target is not null").select("source", "target", "kind")
    nodes = graph.nodes("name", "kind", "file_path").withColumnRenamed("kind", "node_kind")
    if verb == "TRACE":
        a, b = _one(graph, name), _one(graph, str(r.next("word", "str")))
        return traverse.paths_between(graph.links(), a, b, TRACE_DEPTH).orderBy("length", "path")
    inbound = verb == "IMPACT" or r.word("--INBOUND")
    here, there = ("target", "source") if inbound else ("source", "target")
    found = links.filter(F.col(here) == _one(graph, name)).select(F.col(there).alias("id"), F.col("kind").alias("edge_kind"))
    return found.join(nodes, "id").select("id", "name", F.col("node_kind").alias("kind"), "file_path", "edge_kind")


def _find(graph: PropertyGraph, r: _Reader) -> DataFrame:
    kind = None
    if not r.op("*") and r.k < len(r.toks) and r.toks[r.k][0] == "word" and str(r.toks[r.k][1]).upper() not in ("WHERE", "RETURN", "ORDER", "LIMIT"):
        kind = str(r.next("word"))
    used: set[str] = set()
    test = r.filter(graph.node_types, used) if r.word("WHERE") else None
    cols = list(DEFAULT)
    if r.word("RETURN"):
        cols = [str(r.next("word"))]
        while r.op(","):
            cols.append(str(r.next("word")))
    order = []
    if r.word("ORDER"):
        if not r.word("BY"):
            raise GqlError("expected BY")
        while True:
            c = str(r.next("word"))
            used.add(c)
            desc = r.word("DESC")
            if not desc:
                r.word("ASC")
            order.append(F.col(c).desc() if desc else F.col(c).asc())  # nulls first ascending, last descending
            if not r.op(","):
                break
    limit = int(r.next("num")) if r.word("LIMIT") else None
    if r.k < len(r.toks):
        raise GqlError(f"unexpected {r.toks[r.k][1]}")
    for c in [*cols, *used]:
        if c not in graph.node_types:
            raise GqlError(f"no column {c}")
    df = graph.nodes("kind", *cols, *sorted(used))
    if kind:
        df = df.filter(F.col("kind") == kind.lower())
    if test is not None:
        df = df.filter(test)
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*cols)
