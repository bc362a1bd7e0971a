"""Tree to DataFrame.

Variables are bound flat, one column ``var__property`` per property the query mentions, so that scans read just these and
filters reach them; only a variable returned whole is packed into a struct.

Semantics: booleans are two-valued (a null operand is false, NOT null is true); comparisons with null are false; ORDER BY
puts nulls last ascending and first descending; DISTINCT applies to what is returned; a global aggregate over no rows gives no
row; paths follow the pattern from node to node, labels and inline properties hold on every node; ``<-`` binds the source.
Patterns must be connected: a cross product of two patterns is refused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cypher.syntax import Call, Case, CypherError, Exists, Item, Lit, NodeP, Op, Param, Parser, Prop, RelP, Single, Var, walk
from graphloom.cluster import cut
from graphloom.graph import PropertyGraph

#: Levels of a variable-length path that stay one plan.
UNROLLED = 3

_FUNCTIONS: dict[str, Callable[..., Column]] = {}
_AGGREGATES: dict[str, Callable[[Column], Column]] = {}
BUILTIN_AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
#: Names type() gives, by Spark type.
TYPE_NAMES = {"string": "str", "int": "int", "bigint": "int", "double": "float", "float": "float", "boolean": "bool", "void": "NoneType", "smallint": "int", "tinyint": "int"}


def register_function(name: str, build: Callable[..., Column]) -> None:
    """A scalar function over columns; a name may be registered once."""
    if name.lower() in _FUNCTIONS or name.lower() in BUILTIN_FUNCTIONS:
        raise ValueError(f"function {name} exists")
    _FUNCTIONS[name.lower()] = build


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """An aggregate: a builder of an aggregating column; a name may be registered once."""
    if name.lower() in _AGGREGATES or name.lower() in BUILTIN_AGGREGATES:
        raise ValueError(f"aggregate {name} exists")
    _AGGREGATES[name.lower()] = build


@dataclass
class Value:
    col: Column
    type: str = "any"


def truthy(v: Value) -> Column:
    if v.type == "boolean":
        return F.coalesce(v.col, F.lit(False))
    if v.type in ("string",):
        return F.coalesce(v.col != "", F.lit(False))
    if v.type.startswith("array"):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if v.type in TYPE_NAMES:
        return F.coalesce(v.col != 0, F.lit(False))
    return v.col.isNotNull()


BUILTIN_FUNCTIONS = ("toupper", "tolower", "tostring", "coalesce", "type")


class Binder:
    def __init__(self, graph: PropertyGraph, params: dict | None) -> None:
        self.graph, self.params = graph, params or {}
        self.vars: dict[str, str] = {}  # name -> node, edge or value
        self.types: dict[str, str] = {}  # types of value variables
        self.wanted: dict[str, set[str]] = defaultdict(set)
        self.fresh = 0

    # --- what is read of each variable ---

    def note(self, e: object) -> None:
        if e is None:
            return
        for x in walk(e):
            if isinstance(x, Prop) and isinstance(x.of, Var):
                self.wanted[x.of.name].add(x.name)
            elif isinstance(x, Exists):
                for p in x.pattern:
                    self.note_pattern(p)

    def note_whole(self, e: object) -> None:
        """A variable that is returned, counted or compared as a whole."""
        inside = {id(x.of) for x in walk(e) if isinstance(x, Prop)}
        for x in walk(e):
            if isinstance(x, Var) and id(x) not in inside:
                self.wanted[x.name].add("*")

    def note_pattern(self, pattern: list) -> None:
        for p in pattern:
            for v in p.props.values():
                self.note(v)
            if p.var:
                self.wanted[p.var].update(p.props)

    # --- patterns ---

    def name_of(self, p: NodeP | RelP) -> str:
        if p.var is None:
            self.fresh += 1
            p.var = f"_{self.fresh}"
        return p.var

    def node_props(self, p: NodeP) -> list[str]:
        want = set(self.wanted[p.var]) | set(p.props) | ({"kind"} if p.labels else set())
        if "*" in want:
            want |= set(self.graph.node_types)
        return sorted(c for c in want if c in self.graph.node_types and c != "id")

    def node_scan(self, p: NodeP) -> DataFrame:
        v = self.name_of(p)
        props = self.node_props(p)
        df = self.graph.nodes(*props)
        df = df.select(*[F.col(c).alias(f"{v}__{c}") for c in ["id", *props]])
        self.vars[v] = "node"
        return df.filter(self.node_test(p))

    def node_test(self, p: NodeP) -> Column:
        tests = [F.col(f"{p.var}__kind") == x.lower() for x in p.labels]
        return self.tests(p, tests)

    def tests(self, p: NodeP | RelP, tests: list[Column]) -> Column:
        for k, e in p.props.items():
            tests.append(truthy(self.compare("=", self.value(Prop(Var(p.var), k)), self.value(e))))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def edge_scan(self, r: RelP) -> DataFrame:
        v = self.name_of(r)
        want = set(self.wanted[v]) | set(r.props)
        if "*" in want:
            want |= set(self.graph.edge_types) - {"seen_at"}
        props = sorted(c for c in want if c in self.graph.edge_types and c not in ("source", "target", "kind"))
        self.vars[v] = "edge"
        e = self.graph.edges(*props, kinds=[k.lower() for k in r.kinds] or None).filter("target is not null")
        out = e.select(*[F.col(c).alias(f"{v}__{c}") for c in ["source", "target", "kind", *props]])
        a, b = F.col(f"{v}__source"), F.col(f"{v}__target")
        forward = out.withColumns({f"{v}__from": a, f"{v}__to": b})
        backward = out.withColumns({f"{v}__from": b, f"{v}__to": a})
        if r.direction == "out":
            out = forward
        elif r.direction == "in":
            out = backward
        else:
            out = forward.unionByName(backward.filter(a != b))
        return out.filter(self.tests(r, []))

    def hops(self, r: RelP) -> DataFrame:
        """from, to of paths of low to high edges that meet no node twice; without a bound all of them, which end as no node is met twice."""
        v = self.name_of(r)
        self.vars[v] = "value"
        self.types[v] = "array<string>"
        one = self.edge_scan(RelP(f"{v}h", r.kinds, r.direction, r.props)).select(F.col(f"{v}h__from").alias("_a"), F.col(f"{v}h__to").alias("_b")).filter("_a <> _b").distinct()
        self.vars.pop(f"{v}h", None)
        out, walk_ = [], one.select(F.col("_a").alias(f"{v}__from"), F.col("_b").alias(f"{v}__to"), F.array("_a", "_b").alias(v))
        for n in count(1):
            if n > UNROLLED:
                if n == UNROLLED + 1:
                    one = cut(one)
                walk_ = cut(walk_)
            if n >= (r.low or 1):
                out.append(walk_)
            if n == r.high or (n > UNROLLED and walk_.isEmpty()):
                break
            if r.high is None or n < r.high:
                walk_ = walk_.join(one, F.col(f"{v}__to") == F.col("_a")).filter(~F.array_contains(F.col(v), F.col("_b")))
                walk_ = walk_.select(f"{v}__from", F.col("_b").alias(f"{v}__to"), F.concat(v, F.array("_b")).alias(v))
        return reduce(lambda a, b: a.unionByName(b), out or [walk_.limit(0)])

    def expand(self, df: DataFrame, pattern: list) -> DataFrame:
        """Follow a pattern whose first node is bound in ``df``."""
        here = pattern[0].var
        for r, n in zip(pattern[1::2], pattern[2::2]):
            edges = self.hops(r) if r.low is not None else self.edge_scan(r)
            rv = r.var
            df = df.join(edges, F.col(f"{here}__id") == F.col(f"{rv}__from"))
            nv = self.name_of(n)
            if nv in self.vars:  # closes a cycle
                df = df.filter(F.col(f"{rv}__to") == F.col(f"{nv}__id")).filter(self.node_test(n))
            else:
                nodes = self.node_scan(n)
                df = df.join(nodes, F.col(f"{rv}__to") == F.col(f"{nv}__id"))
            here = nv
        return df

    def turned(self, pattern: list) -> list:
        """The pattern read from its last node."""
        flip = {"out": "in", "in": "out", "both": "both"}
        return [RelP(p.var, p.kinds, flip[p.direction], p.props, p.low, p.high) if isinstance(p, RelP) else p for p in reversed(pattern)]

    def match(self, df: DataFrame | None, patterns: list[list]) -> DataFrame:
        for n, pattern in enumerate(patterns):
            if pattern[0].var in self.vars and df is not None:
                pass
            elif pattern[-1].var in self.vars and df is not None and len(pattern) > 1:
                pattern = self.turned(pattern)
            elif df is not None:
                raise CypherError("patterns must share a variable with what is matched before them")
            else:
                # start at the end that says more about its node; joins are symmetric, scans are not
                if len(pattern) > 1 and (len(pattern[-1].props), bool(pattern[-1].labels)) > (len(pattern[0].props), bool(pattern[0].labels)) and all(p.low is None for p in pattern[1::2]):
                    pattern = self.turned(pattern)
                df = self.node_scan(pattern[0])
            if n and pattern[0].labels:
                df = df.filter(self.node_test(pattern[0]))
            df = self.expand(df, pattern)
        return df

    def optional(self, df: DataFrame, patterns: list[list], where: object | None) -> DataFrame:
        for pattern in patterns:
            if pattern[0].var not in self.vars:
                if pattern[-1].var not in self.vars:
                    raise CypherError("OPTIONAL MATCH must start or end at a bound variable")
                pattern = self.turned(pattern)
            start = pattern[0].var
            inner = Binder(self.graph, self.params)
            inner.wanted, inner.fresh = self.wanted, self.fresh + 1000
            first = NodeP(start, pattern[0].labels, pattern[0].props)
            own = inner.expand(inner.node_scan(first), [first, *pattern[1:]])
            for v in inner.vars:
                if v in self.vars and v != start:
                    raise CypherError("an OPTIONAL pattern may share one variable with what is bound")
            if where is not None:
                own = own.filter(truthy(inner.value(where)))
            keep = [c for c in own.columns if not c.startswith(f"{start}__")]
            own = own.select(F.col(f"{start}__id").alias("_start"), *keep)
            df = df.join(own, F.col(f"{start}__id") == F.col("_start"), "left").drop("_start")
            self.vars.update({v: k for v, k in inner.vars.items() if v != start})
            self.types.update(inner.types)
            self.fresh = inner.fresh
        return df

    def exists(self, df: DataFrame, e: Exists, mark: str | None = None) -> DataFrame:
        """Semi or anti join; with ``mark`` a boolean column instead."""
        pattern = e.pattern[0]
        if len(e.pattern) > 1:
            raise CypherError("EXISTS takes one pattern")
        for p in pattern[::2]:
            self.name_of(p)
        if pattern[0].var not in self.vars:
            pattern = self.turned(pattern)
            if pattern[0].var not in self.vars:
                raise CypherError("EXISTS must share a variable with the query")
        shared = [p.var for p in pattern[::2] if p.var in self.vars]
        inner = Binder(self.graph, self.params)
        inner.wanted, inner.fresh = self.wanted, self.fresh + 5000
        first = NodeP(pattern[0].var, pattern[0].labels, pattern[0].props)
        own = inner.expand(inner.node_scan(first), [first, *pattern[1:]])
        if e.where is not None:
            own = own.filter(truthy(inner.value(e.where)))
        keys = own.select(*[F.col(f"{v}__id").alias(f"_x_{v}") for v in dict.fromkeys(shared)])
        on = reduce(lambda a, b: a & b, [F.col(f"{v}__id") == F.col(f"_x_{v}") for v in dict.fromkeys(shared)])
        if mark is None:
            return df.join(keys, on, "left_anti" if e.negated else "left_semi")
        keys = keys.distinct().withColumn("_hit", F.lit(True))
        out = df.join(keys, on, "left")
        hit = F.coalesce("_hit", F.lit(False))
        return out.withColumn(mark, ~hit if e.negated else hit).drop("_hit", *[f"_x_{v}" for v in dict.fromkeys(shared)])

    def where(self, df: DataFrame, e: object | None) -> DataFrame:
        if e is None:
            return df
        if isinstance(e, Op) and e.op == "and":
            return self.where(self.where(df, e.args[0]), e.args[1])
        if isinstance(e, Exists):
            return self.exists(df, e)
        marks: dict[int, str] = {}
        for x in list(walk(e)):
            if isinstance(x, Exists):
                marks[id(x)] = f"_exists_{len(marks)}_{self.fresh}"
                df = self.exists(df, x, marks[id(x)])
        self.marks = marks
        return df.filter(truthy(self.value(e))).drop(*marks.values())

    # --- expressions ---

    def value(self, e: object) -> Value:
        if isinstance(e, Lit):
            kind = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "void"}[type(e.value)]
            return Value(F.lit(e.value), kind)
        if isinstance(e, Param):
            if e.name not in self.params:
                raise CypherError(f"parameter ${e.name} is not given")
            v = self.params[e.name]
            if isinstance(v, (list, tuple)):
                return self.value(Op("list", [Lit(x) for x in v]))
            return self.value(Lit(v))
        if isinstance(e, Var):
            kind = self.vars.get(e.name)
            if kind is None:
                raise CypherError(f"variable {e.name} is not defined")
            if kind == "value":
                return Value(F.col(f"`{e.name}`"), self.types.get(e.name, "any"))
            return Value(F.col(f"{e.name}__id") if kind == "node" else F.concat_ws(">", f"{e.name}__source", f"{e.name}__target", f"{e.name}__kind"), "string")
        if isinstance(e, Prop):
            if isinstance(e.of, Var) and e.of.name in self.vars:
                v, kind = e.of.name, self.vars[e.of.name]
                types = self.graph.node_types if kind == "node" else self.graph.edge_types
                if kind in ("node", "edge"):
                    if e.name in types:
                        return Value(F.col(f"{v}__{e.name}"), types[e.name])
                    return Value(F.lit(None).cast("string"), "void")
                return Value(F.lit(None).cast("string"), "void")
            if isinstance(e.of, Var):
                raise CypherError(f"variable {e.of.name} is not defined")
            return Value(F.lit(None).cast("string"), "void")
        if isinstance(e, Exists):
            mark = getattr(self, "marks", {}).get(id(e))
            if mark is None:
                raise CypherError("EXISTS belongs in WHERE")
            return Value(F.col(mark), "boolean")
        if isinstance(e, Case):
            out = None
            subject = self.value(e.subject) if e.subject is not None else None
            kind = "any"
            for c, r in e.whens:
                test = subject.col.eqNullSafe(self.value(c).col) if subject else truthy(self.value(c))
                v = self.value(r)
                kind = v.type if kind in ("any", "void") else kind
                out = F.when(test, v.col) if out is None else out.when(test, v.col)
            if e.otherwise is not None:
                v = self.value(e.otherwise)
                kind = v.type if kind in ("any", "void") else kind
                out = out.otherwise(v.col)
            return Value(out, kind)
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Op):
            return self.op(e)
        raise CypherError(f"cannot evaluate {e}")

    def call(self, e: Call) -> Value:
        args = [self.value(a) for a in e.args]
        if e.name == "toupper":
            return Value(F.upper(args[0].col), "string")
        if e.name == "tolower":
            return Value(F.lower(args[0].col), "string")
        if e.name == "tostring":
            return Value(args[0].col.cast("string"), "string")
        if e.name == "coalesce":
            return Value(F.coalesce(*[a.col for a in args]), next((a.type for a in args if a.type != "void"), "void"))
        if e.name == "type":
            a = e.args[0]
            if isinstance(a, Var) and self.vars.get(a.name) in ("node", "edge"):
                return Value(F.lit("dict"), "string")
            name = TYPE_NAMES.get(args[0].type, "list" if args[0].type.startswith("array") else "dict")
            return Value(F.when(args[0].col.isNotNull(), F.lit(name)), "string")
        if e.name in _FUNCTIONS:
            return Value(_FUNCTIONS[e.name](*[a.col for a in args]))
        raise CypherError(f"no function {e.name}")

    @staticmethod
    def compare(op: str, a: Value, b: Value) -> Value:
        x, y = a.col, b.col
        if a.type == "string" and b.type in ("bigint", "int", "double") or b.type == "string" and a.type in ("bigint", "int", "double"):
            same = F.lit(False)  # a text never equals a number
            return Value(F.coalesce(~same & x.isNotNull() & y.isNotNull(), F.lit(False)) if op == "<>" else same, "boolean")
        c = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return Value(F.coalesce(c, F.lit(False)), "boolean")

    def op(self, e: Op) -> Value:
        o = e.op
        if o == "list":
            vals = [self.value(a) for a in e.args]
            kind = next((v.type for v in vals if v.type != "void"), "string")
            return Value(F.array(*[v.col for v in vals]) if vals else F.array().cast("array<string>"), f"array<{kind}>")
        if o == "in":
            left = self.value(e.args[0])
            right = e.args[1]
            if isinstance(right, Op) and right.op == "list":
                tests = [self.compare("=", left, self.value(x)).col for x in right.args]
                return Value(reduce(lambda a, b: a | b, tests, F.lit(False)), "boolean")
            return Value(F.coalesce(F.array_contains(self.value(right).col, left.col), F.lit(False)), "boolean")
        args = [self.value(a) for a in e.args]
        if o in ("and", "or", "xor"):
            a, b = truthy(args[0]), truthy(args[1])
            return Value(a & b if o == "and" else a | b if o == "or" else a != b, "boolean")
        if o == "not":
            return Value(~truthy(args[0]), "boolean")
        if o in ("=", "<>", "<", ">", "<=", ">="):
            return self.compare(o, *args)
        x = args[0]
        if o == "isnull":
            return Value(x.col.isNull(), "boolean")
        if o == "notnull":
            return Value(x.col.isNotNull(), "boolean")
        if o == "neg":
            return Value(-x.col, x.type)
        y = args[1]
        if o == "=~":
            return Value(F.coalesce(F.rlike(x.col, y.col), F.lit(False)), "boolean")
        if o in ("starts", "ends", "contains"):
            f = {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[o]
            return Value(F.coalesce(f(x.col, y.col), F.lit(False)), "boolean")
        if o == "+":
            if x.type == "string" or y.type == "string":
                return Value(F.concat(x.col.cast("string"), y.col.cast("string")), "string")
            if x.type.startswith("array"):
                return Value(F.concat(x.col, y.col), x.type)
            return Value(x.col + y.col, "double" if "double" in (x.type, y.type) else "bigint")
        if o == "-":
            return Value(x.col - y.col, "double" if "double" in (x.type, y.type) else "bigint")
        if o == "*":
            return Value(x.col * y.col, "double" if "double" in (x.type, y.type) else "bigint")
        if o == "/":
            return Value(x.col.cast("double") / y.col, "double")
        if o == "%":  # sign of the divisor
            return Value(x.col - F.floor(x.col / y.col) * y.col, x.type)
        if o == "^":
            return Value(F.pow(x.col, y.col), "double")
        raise CypherError(f"no operator {o}")

    # --- results ---

    def is_aggregate(self, e: object) -> bool:
        return isinstance(e, Call) and (e.name in BUILTIN_AGGREGATES or e.name in _AGGREGATES)

    def aggregate(self, e: Call) -> Column:
        if e.star or not e.args:
            return F.count(F.lit(1))
        v = self.value(e.args[0])
        c = v.col
        if e.name == "count":
            return F.countDistinct(c) if e.distinct else F.count(c)
        if e.name == "sum":
            return F.coalesce(F.sum_distinct(c) if e.distinct else F.sum(c), F.lit(0))
        if e.name == "avg":
            return F.avg(c)
        if e.name == "min":
            return F.min(c)
        if e.name == "max":
            return F.max(c)
        if e.name == "collect":  # keeps nulls, sorted for one defined result
            held = F.collect_set(F.struct(c.alias("v"))) if e.distinct else F.collect_list(F.struct(c.alias("v")))
            return F.transform(F.sort_array(held), lambda x: x["v"])
        return _AGGREGATES[e.name](c)

    @staticmethod
    def derived(e: object) -> str:
        if isinstance(e, Prop) and isinstance(e.of, Var):
            return f"{e.of.name}.{e.name}"
        if isinstance(e, Var):
            return e.name
        if isinstance(e, Call):
            return f"{e.name}(...)"
        return "expr"

    def whole(self, v: str) -> Column:
        """A node or edge packed into a struct, null where an optional match found none."""
        kind = self.vars[v]
        if kind == "value":
            return F.col(f"`{v}`")
        names = [c for c in (self.graph.node_types if kind == "node" else ["source", "target", "kind", *[c for c in self.graph.edge_types if c not in ("source", "target", "kind", "seen_at")]])]
        key = F.col(f"{v}__id" if kind == "node" else f"{v}__source")
        return F.when(key.isNotNull(), F.struct(*[F.col(f"{v}__{c}").alias(c) for c in names]))

    def item(self, it: Item) -> Column:
        if isinstance(it.expr, Var) and self.vars.get(it.expr.name) in ("node", "edge"):
            return self.whole(it.expr.name)
        return self.value(it.expr).col

    def run(self, q: Single) -> DataFrame:
        for pattern in [*q.match, *[p for ps, _ in q.optional for p in ps]]:
            self.note_pattern(pattern)
        plain = [it.expr for it in [*q.items, *(q.with_ or [])]]
        for e in [q.where, q.with_where, *plain, *[w for _, w in q.optional], *[o for o, _ in q.order], q.unwind[0] if q.unwind else None]:
            self.note(e)
        for e in plain:
            if isinstance(e, Var):
                self.note_whole(e)
        if q.star:
            for pattern in [*q.match, *[p for ps, _ in q.optional for p in ps]]:
                for p in pattern:
                    if p.var:
                        self.wanted[p.var].add("*")
        df = self.match(None, q.match) if q.match else None
        if df is not None:
            df = self.where(df, q.where)
            for patterns, w in q.optional:
                df = self.optional(df, patterns, w)
        if q.unwind:
            e, name = q.unwind
            if df is None:
                df = self.graph._nodes.sparkSession.range(1).drop("id")
            v = self.value(e)
            df = df.withColumn(name, F.explode(v.col)) if v.type.startswith("array") else df.limit(0).withColumn(name, F.lit(None).cast("string"))
            self.vars[name] = "value"
            self.types[name] = v.type[6:-1] if v.type.startswith("array<") else "any"
        if df is None:
            df = self.graph._nodes.sparkSession.range(1).drop("id")
        if q.with_ is not None:
            df = self.project_with(df, q)
        return self.result(df, q)

    def project_with(self, df: DataFrame, q: Single) -> DataFrame:
        cols, vars_, types = [], {}, {}
        aggs = [it for it in q.with_ if self.is_aggregate(it.expr)]
        for it in q.with_:
            name = it.alias or self.derived(it.expr)
            if isinstance(it.expr, Var) and self.vars.get(it.expr.name) in ("node", "edge"):
                old = f"{it.expr.name}__"
                cols += [F.col(c).alias(f"{name}__{c[len(old):]}") for c in df.columns if c.startswith(old)]
                vars_[name] = self.vars[it.expr.name]
            elif not self.is_aggregate(it.expr):
                v = self.value(it.expr)
                cols.append(v.col.alias(name))
                vars_[name], types[name] = "value", v.type
        if aggs:
            df = df.groupBy(*cols).agg(*[self.aggregate(it.expr).alias(it.alias or self.derived(it.expr)) for it in aggs])
            for it in aggs:
                name = it.alias or self.derived(it.expr)
                vars_[name], types[name] = "value", dict(df.dtypes)[name]
        else:
            df = df.select(*cols)
        if q.with_distinct:
            df = df.distinct()
        self.vars, self.types = vars_, types
        return df.filter(truthy(self.value(q.with_where))) if q.with_where is not None else df

    def result(self, df: DataFrame, q: Single) -> DataFrame:
        if q.star:
            q.items = [Item(Var(v), v) for v in self.vars if not v.startswith("_")]
        names = [it.alias or self.derived(it.expr) for it in q.items]
        aggs = {n: it for n, it in zip(names, q.items) if self.is_aggregate(it.expr)}
        order = []
        if aggs:
            keys = {n: it for n, it in zip(names, q.items) if n not in aggs}
            made = [self.aggregate(it.expr).alias(n) for n, it in aggs.items()]
            out = df.groupBy(*[self.item(it).alias(n) for n, it in keys.items()]).agg(*made, *([] if keys else [F.count(F.lit(1)).alias("_rows")]))
            if not keys:
                out = out.filter("_rows > 0").drop("_rows")
            out = out.select(*[F.col(f"`{n}`") for n in [*keys, *aggs]])
            hidden: list[str] = []
        else:
            wanted, hidden = [self.item(it).alias(n) for n, it in zip(names, q.items)], []
            if not q.distinct:  # ORDER BY may use what is not returned
                for k, (e, _) in enumerate(q.order):
                    if not self.returned(e, names, q.items):
                        wanted.append(self.value(e).col.alias(f"_order_{k}"))
                        hidden.append(f"_order_{k}")
            out = df.select(*wanted)
            if q.distinct:
                out = out.distinct()
        for k, (e, desc) in enumerate(q.order):
            name = self.returned(e, names, q.items) or (f"_order_{k}" if f"_order_{k}" in hidden else None)
            if name is None:
                raise CypherError("ORDER BY needs a returned column here")
            c = F.col(f"`{name}`")
            order.append(c.desc_nulls_first() if desc else c.asc_nulls_last())
        if order:
            out = out.orderBy(*order)
        if q.skip is not None:
            out = out.offset(self.number(q.skip))
        if q.limit is not None:
            out = out.limit(self.number(q.limit))
        return out.drop(*hidden) if hidden else out

    def number(self, e: object) -> int:
        v = e.value if isinstance(e, Lit) else self.params.get(e.name) if isinstance(e, Param) else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError("SKIP and LIMIT take a number")
        return v

    @staticmethod
    def returned(e: object, names: list[str], items: list[Item]) -> str | None:
        if isinstance(e, Var) and e.name in names:
            return e.name
        return next((n for n, it in zip(names, items) if it.expr == e), None)


def query(graph: PropertyGraph, text: str, params: dict | None = None) -> DataFrame:
    """Compile ``text`` over ``graph``. UNION matches columns by name; a side without a column has nulls in it."""
    parts, alls = Parser(text).statement()
    out = Binder(graph, params).run(parts[-1])
    for q, keep in zip(reversed(parts[:-1]), reversed(alls)):  # the chain nests to the right
        out = Binder(graph, params).run(q).unionByName(out, allowMissingColumns=True)
        out = out if keep else out.distinct()
    return out


__all__ = ["CypherError", "Call", "query", "register_aggregate", "register_function"]
