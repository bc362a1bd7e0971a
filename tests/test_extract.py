from pyspark.sql import functions as F

from graphloom.sources import extract, files

PY = '''import os
from a.b import c

class A(Base):
    """Doc of A."""

    @cached
    def f(self, x: int = 1) -> int:
        """Doc of f."""
        return helper(x) + os.path.join("a")

def helper(y):
    raise ValueError(y)
'''
JS = """import { a } from './b';

export class Router extends Base {
  route(x) {
    if (x) { return go(x); } // go2(x)
    return "stop(x)";
  }
}

function go(x) {
  return a.run(x);
}
"""
GO = 'package p\n\nimport (\n\t"fmt"\n)\n\ntype M struct {\n\tx int\n}\n\nfunc (m *M) Get(k int) int {\n\treturn Run(k)\n}\n\nfunc Run(k int) int {\n\tfmt.Println(k)\n\treturn k\n}\n'
JAVA = "package p;\n\nimport java.util.List;\n\npublic class A extends B {\n    private int f(Object o) {\n        return g(o);\n    }\n\n    int g(Object o) {\n        return 1;\n    }\n}\n"


def table(spark):
    rows = [("r/a.py", PY), ("r/b.js", JS), ("r/c.go", GO), ("r/D.java", JAVA), ("r/bad.py", "def f(:"), ("r/none.py", None), ("r/e.txt", "x"), (None, PY), ("r/a.py", PY)]
    return spark.createDataFrame(rows, "path string, content string")


def test_nodes(spark):
    got = {(r.file_path, r.kind, r.qualified_name.replace(r.file_path, "")): r for r in extract.extract_nodes(table(spark)).collect()}
    want = {("r/a.py", "class", "::A"), ("r/a.py", "method", "::A.f"), ("r/a.py", "function", "::helper"), ("r/b.js", "class", "::Router"), ("r/b.js", "method", "::Router.route"), ("r/b.js", "function", "::go"),
            ("r/c.go", "class", "::M"), ("r/c.go", "method", "::M.Get"), ("r/c.go", "function", "::Run"), ("r/D.java", "class", "::A"), ("r/D.java", "method", "::A.f"), ("r/D.java", "method", "::A.g")}
    assert {k for k in got if k[1] != "file"} == want
    assert {k[0] for k in got if k[1] == "file"} == {"r/a.py", "r/b.js", "r/c.go", "r/D.java", "r/bad.py", "r/none.py", "r/e.txt"}
    f = got[("r/a.py", "method", "::A.f")]
    assert (f.start_line, f.end_line, f.docstring, f.decorators) == (8, 10, "Doc of f.", '["cached"]') and f.signature == "def f(self, x: int=1) -> int"
    assert got[("r/b.js", "method", "::Router.route")].start_line == 4 and got[("r/b.js", "method", "::Router.route")].end_line == 7


def test_edges(spark):
    nodes = {r.id: r.qualified_name for r in extract.extract_nodes(table(spark)).collect()}
    got = {(nodes[r.source].split("/")[-1], r.kind, nodes[r.target].split("/")[-1] if r.target else r.target_text) for r in extract.extract_edges(table(spark)).collect()}
    assert {("a.py::A", "contains", "a.py::A.f"), ("a.py::A.f", "calls", "a.py::helper"), ("a.py", "imports", "<external>:os"), ("a.py", "imports", "<external>:a.b.c"), ("a.py::A", "extends", "<external>:Base"), ("a.py::helper", "throws", "<external>:ValueError"),
            ("b.js::Router.route", "calls", "b.js::go"), ("b.js", "imports", "<external>:./b"), ("b.js::Router", "extends", "<external>:Base"), ("c.go::M.Get", "calls", "c.go::Run"), ("c.go", "imports", "<external>:fmt"), ("D.java::A.f", "calls", "D.java::A.g"), ("D.java::A", "extends", "<external>:B")} <= got
    assert not any(n.startswith(("<external>:go2", "<external>:stop")) for _, _, n in got)
    assert extract.extract_edges(table(spark).limit(0)).count() == 0


def test_scan(spark, tmp_path):
    for p, t in (("a.py", "x = 1\n"), ("node_modules/l/i.js", "x"), ("b/c.js", "y"), ("b/keep.log", "k"), ("b/drop.log", "d"), ("build/z.go", "z")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r.content for r in files.scan(spark, str(tmp_path), ["# note", "*.log", "!keep.log", "/build/"]).collect()}
    assert got == {"a.py": "x = 1\n", "b/c.js": "y", "b/keep.log": "k"}
    big = {r.path: r.content for r in files.scan(spark, str(tmp_path), glob="*.py", max_bytes=2).collect()}
    assert big == {"a.py": None}
    assert [r[0] for r in spark.createDataFrame([("a.PY",), ("b",), (None,)], "p string").select(files.language(F.col("p"))).collect()] == ["python", None, None]


def test_imports_are_resolved(spark, rows):
    from graphloom.operators import resolve

    src = [
        ("r/src/pkg/a.py", "import os\nimport pkg.b\nfrom pkg.c import thing, nothing\nfrom . import b\nfrom .c import thing\nfrom ..up import far\nimport pkg.gone\n"), ("r/src/pkg/b.py", "x = 1\n"), ("r/src/pkg/c.py", "def thing():\n    pass\n"), ("r/src/pkg/__init__.py", ""), ("r/src/up.py", "def far():\n    pass\n"),
        ("q/lib/pkg/b.py", "y = 1\n"), ("q/app.py", "import pkg.b\n"), ("r/w/x.ts", "import { y } from './y';\nimport z from '../z.js';\nimport React from 'react';\nimport n from './none';\n"), ("r/w/y/index.ts", "export const y = 1;\n"), ("r/z.js", "export default 1;\n"),
        ("r/j/net/own/A.java", "package net.own;\nimport net.own.B;\nimport java.util.List;\nimport static net.own.B.make;\npublic class A {\n}\n"), ("r/j/net/own/B.java", "package net.own;\npublic class B {\n  static int make() {\n    return 1;\n  }\n}\n"),
        ("r/g/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"own.dev/r/g/kit"\n)\n\nfunc main() {\n}\n'), ("r/g/kit/k.go", "package kit\n"), ("r/g/kit/a.go", "package kit\n"),
    ]
    df = spark.createDataFrame([*src, src[0], (None, "import os")], "path string, content string")
    nodes, edges = extract.extract_nodes(df), extract.extract_edges(df)
    name = {r.id: r.qualified_name for r in nodes.collect()}
    got = sorted(((name[r.source], r.target_text.partition(":")[2], name.get(r.target), r.provenance) for r in resolve.resolve_imports(nodes, edges).collect()), key=lambda x: (x[0], x[1], x[2] or "", x[3]))
    a, b, j = "r/src/pkg/a.py", "r/src/pkg/b.py", "r/j/net/own"
    assert got == sorted([
        (a, "os", None, "external"), (a, "pkg.b", b, "resolved"), (a, "pkg.c.thing", "r/src/pkg/c.py::thing", "resolved"), (a, "pkg.c.nothing", None, "unresolved"), (a, ".b", b, "resolved"), (a, ".c.thing", "r/src/pkg/c.py::thing", "resolved"), (a, "..up.far", "r/src/up.py::far", "resolved"), (a, "pkg.gone", None, "unresolved"),
        ("q/app.py", "pkg.b", "q/lib/pkg/b.py", "resolved"), ("r/w/x.ts", "./y", "r/w/y/index.ts", "resolved"), ("r/w/x.ts", "../z.js", "r/z.js", "resolved"), ("r/w/x.ts", "react", None, "external"), ("r/w/x.ts", "./none", None, "unresolved"),
        (f"{j}/A.java", "net.own.B", f"{j}/B.java", "resolved"), (f"{j}/A.java", "java.util.List", None, "external"), (f"{j}/A.java", "net.own.B.make", f"{j}/B.java::B.make", "resolved"), ("r/g/main.go", "fmt", None, "external"), ("r/g/main.go", "own.dev/r/g/kit", "r/g/kit/a.go", "resolved"),
    ], key=lambda x: (x[0], x[1], x[2] or "", x[3]))
    assert {x[3] for x in got} == {"resolved", "external", "unresolved"} and rows(resolve.resolve_imports(nodes.limit(0), edges.limit(0))) == []
