"""Source texts to nodes and edges of the graph: one pass, each file on its own.

Python is read by its own parser; JavaScript, TypeScript, Java and Go by one brace-aware reader of definitions, imports and
calls. A file that does not parse gives its file node only. Ids are those of the graph (``schema.node_id``); targets within a
file are ids, all others are left as text behind ``target_text`` for the resolver.

Defined results: null paths are dropped; null or empty contents give the file node; a definition repeated in a file keeps the first."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import small
from graphloom.sources.files import language

NODE_OUT = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, decorators string, body string, body_hash string"
EDGE_OUT = "source string, target string, target_text string, kind string, source_loc string, provenance string"


def symbol_id(path: str, qualified: str) -> str:
    return hashlib.sha256(f"{path}:{qualified}".encode()).hexdigest()[:32]


@dataclass
class Def:
    kind: str
    name: str
    qualified: str
    start: int
    end: int
    signature: str = ""
    doc: str | None = None
    decorators: list[str] = field(default_factory=list)
    parent: str = ""  # qualified name of what contains it


@dataclass
class Ref:
    source: str  # qualified name
    kind: str
    name: str
    line: int


def _name(e: ast.expr) -> str:
    return ast.unparse(e) if isinstance(e, (ast.Name, ast.Attribute)) else ""


def python_symbols(path: str, text: str) -> tuple[list[Def], list[Ref]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    defs, refs = [], []

    def visit(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                qualified = f"{owner}.{child.name}" if owner != path else f"{path}::{child.name}"
                sign = f"class {child.name}" if is_class else f"{'async ' if isinstance(child, ast.AsyncFunctionDef) else ''}def {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                defs.append(Def("class" if is_class else "method" if in_class else "function", child.name, qualified, child.lineno, child.end_lineno or child.lineno, sign, ast.get_docstring(child), [ast.unparse(d) for d in child.decorator_list], owner))
                refs.extend(Ref(qualified, "extends", _name(b), child.lineno) for b in (child.bases if is_class else []) if _name(b))
                visit(child, qualified, is_class)
            else:
                if isinstance(child, ast.Call) and _name(child.func):
                    refs.append(Ref(owner, "calls", _name(child.func), child.lineno))
                elif isinstance(child, ast.Import):
                    refs.extend(Ref(owner, "imports", a.name, child.lineno) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    refs.extend(Ref(owner, "imports", "." * child.level + (f"{child.module}." if child.module else "") + a.name, child.lineno) for a in child.names)
                elif isinstance(child, ast.Raise) and child.exc is not None:
                    e = child.exc.func if isinstance(child.exc, ast.Call) else child.exc
                    if _name(e):
                        refs.append(Ref(owner, "throws", _name(e), child.lineno))
                visit(child, owner, False)

    visit(tree, path, False)
    return defs, refs


_BLANK = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', re.S)
_DEF = {
    "class": re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)(?:[^{;]*?\b(?:extends|implements)\s+([\w.]+))?[^{;]*\{|^type\s+(\w+)\s+(?:struct|interface)\s*\{", re.M),
    "function": re.compile(r"^[ \t]*(?:(?:export|default|async)\s+)*function\s*\*?\s*(\w+)\s*\([^)]*\)[^{;]*\{|^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*\([^{]*\{", re.M),
    "method": re.compile(r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|async|override|synchronized)\s+)*(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^(){};]*\)\s*(?::\s*[^{;=]+)?(?:throws\s+[\w., ]+)?\s*\{", re.M),
}
_NOT_METHOD = frozenset("if for while switch catch function return new else do try synchronized".split())
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALL = frozenset("if for while switch catch function return super this typeof func new".split())
_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?(?:[^'\";\n]*?\bfrom\s+)?['\"]?([\w./@*-]+)['\"]?|^\s*(?:\w+\s+)?\"([\w./-]+)\"\s*$", re.M)


def _end(clean: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(clean, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(clean)


def brace_symbols(path: str, text: str, lang: str) -> tuple[list[Def], list[Ref]]:
    clean = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ends = [m.start() for m in re.finditer("\n", text)]
    line_at = lambda k: bisect_left(ends, k) + 1
    spans: list[tuple[int, int, Def]] = []
    refs: list[Ref] = []
    for m in _DEF["class"].finditer(clean):
        name = m.group(1) or m.group(3)
        d = Def("class", name, f"{path}::{name}", line_at(m.start() + len(m.group()) - len(m.group().lstrip())), 0, " ".join(m.group().rstrip("{ \n").split()), parent=path)
        end = _end(clean, m.end() - 1)
        d.end = line_at(end)
        spans.append((m.start(), end, d))
        if m.group(2):
            refs.append(Ref(d.qualified, "extends", m.group(2), d.start))
    classes = [(a, b, d) for a, b, d in spans]
    for kind in ("function", "method"):
        for m in _DEF[kind].finditer(clean):
            name = (m.group(1) or m.group(3)) if kind == "function" else m.group(1)
            if not name or name in _NOT_METHOD:
                continue
            owner = next((d for a, b, d in reversed(classes) if a < m.start() < b), None)
            receiver = m.group(2) if kind == "function" else None
            if kind == "method" and owner is None:
                continue
            holder = f"{path}::{receiver}" if receiver else owner.qualified if owner else path
            qualified = f"{holder}.{name}" if holder != path else f"{path}::{name}"
            end = _end(clean, m.end() - 1)
            start = line_at(m.start() + len(m.group()) - len(m.group().lstrip()))
            spans.append((m.start(), end, Def("method" if holder != path else "function", name, qualified, start, line_at(end), " ".join(text[m.start() : m.end()].rstrip("{ \n").split()), parent=holder)))
    for a, b, d in spans:
        if d.kind != "class":
            body = clean[clean.find("{", a) : b]
            refs.extend(Ref(d.qualified, "calls", c, d.start) for c in dict.fromkeys(x for x in _CALL.findall(body) if x not in _NOT_CALL))
    if lang == "go" or "import" in text:
        code = text[: spans[0][0]] if spans and lang == "go" else text
        refs.extend(Ref(path, "imports", m.group(1) or m.group(2), line_at(m.start())) for m in _IMPORT.finditer(code) if (m.group(1) or (m.group(2) and lang == "go")))
    return [d for _, _, d in sorted(spans, key=lambda s: s[0])], refs


def symbols(path: str, text: str | None, lang: str | None) -> tuple[list[dict], list[dict]]:
    """Node and edge rows of one file."""
    text = (text or "").replace("\r\n", "\n")
    defs: list[Def] = []
    refs: list[Ref] = []
    try:
        if lang == "python":
            defs, refs = python_symbols(path, text)
        elif lang in ("javascript", "typescript", "java", "go"):
            defs, refs = brace_symbols(path, text, lang)
    except (SyntaxError, ValueError, RecursionError):
        defs, refs = [], []
    lines = text.split("\n")
    me = symbol_id(path, path)
    nodes = [dict(id=me, kind="file", name=path.rsplit("/", 1)[-1], qualified_name=path, file_path=path, language=lang, start_line=1, end_line=len(lines), signature=None, docstring=None, decorators="[]", body=None, body_hash=None)]
    ids = {path: me}
    by_name: dict[str, list[str]] = {}
    kept = []
    for d in defs:
        if d.qualified not in ids:
            ids[d.qualified] = symbol_id(path, d.qualified)
            by_name.setdefault(d.name, []).append(d.qualified)
            kept.append(d)
    edges = []
    for d in kept:
        body = "\n".join(lines[d.start - 1 : d.end])
        nodes.append(dict(id=ids[d.qualified], kind=d.kind, name=d.name, qualified_name=d.qualified, file_path=path, language=lang, start_line=d.start, end_line=d.end, signature=d.signature, docstring=d.doc[:200] if d.doc else None, decorators=json.dumps(d.decorators), body=body, body_hash=hashlib.sha256(body.encode()).hexdigest()))
        edges.append(dict(source=ids.get(d.parent, me), target=ids[d.qualified], target_text=f"{path}:{d.qualified}", kind="contains", source_loc=f"{path}:{d.start}", provenance="parser"))
    for r in dict.fromkeys((r.source, r.kind, r.name, r.line) for r in refs):
        source, kind, name, line = r
        here = by_name.get(name.rsplit(".", 1)[-1], []) if kind != "imports" else []
        target = ids[here[0]] if len(here) == 1 else None
        edges.append(dict(source=ids.get(source, me), target=target, target_text=f"{path}:{here[0]}" if target else f"<external>:{name}", kind=kind, source_loc=f"{path}:{line}", provenance="resolved" if target else "unresolved"))
    return nodes, edges


def _run(which: int, schema: str):
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t, lang in zip(f["path"], f["content"], f["language"]) for r in symbols(p, t, lang)[which]]
            yield pd.DataFrame(rows, columns=names)

    return run


def _texts(sources: DataFrame) -> DataFrame:
    """Each path once with its language. Only paths are shuffled to find those that repeat; of the contents of such a path the largest is taken."""
    rows = sources.filter("path is not null").select("path", "content")
    again = small(rows.select("path").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path"))
    once, many = rows.join(again, "path", "left_anti"), rows.join(again, "path", "left_semi").groupBy("path").agg(F.max("content").alias("content"))
    return once.unionByName(many).select("path", "content", language(F.col("path")).alias("language"))


def extract_nodes(sources: DataFrame) -> DataFrame:
    """Nodes of ``sources`` (path, content); of several contents of a path the largest is taken."""
    return _texts(sources).mapInPandas(_run(0, NODE_OUT), NODE_OUT)


def extract_edges(sources: DataFrame) -> DataFrame:
    return _texts(sources).mapInPandas(_run(1, EDGE_OUT), EDGE_OUT)
