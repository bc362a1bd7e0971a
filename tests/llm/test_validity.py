import ast
import itertools
import json
import random
import warnings

import pytest

from graphloom.llm import queries, validity
from graphloom.llm.syntax import chart, table
from graphloom.llm.syntax.chart import NOWHERE, Grammar, Group
from graphloom.llm.syntax.check import check, language_of, repair

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a if b else [i for i in c if i]\n", "class A(B, metaclass=C):\n    @p\n    async def f(self):\n        async with a as b, c:\n            await d\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case P(a=1) | None:\n        pass\n", "x = {**a, 'b': 1}; y = {*s}; z = a[1:2, ::3]\nlambda *a, k=1: (yield)\nprint(f'{x!r:>{w}}', end='')\n", "if (n := 1) > 2: pass\nelif y: pass\nelse: pass\n", 's = """<<<<<<< HEAD\n"""\n', "with (open(a) as b, c): pass\n", "def f[T: int](x: T) -> T: ...\ntype A = int\nx: int\n*a, b = c\n"],
    "javascript": ["", "const { a, b: [c = 1, ...d], ...e } = f;\n", "export default class A extends B { #x = 1; static async *g() { yield* h(); } get y() { return this.#x } }", "for (const [k, v] of Object.entries(o)) if (k) continue; else break\n", "let a = b\nlet c = `x ${`y ${z}`}`\nfoo(a?.b?.[c] ?? d, ...e)\n", "x = a / b / c; y = /[/]\\/(?:a)/g.test(s)\n", "import a, { b as c } from 'd';\nexport * from './e';\n", "async () => { await (async x => x)(); }", "label: do { x++ } while (x < 3)\nswitch (x) { case 1: default: }", "const s = '<<<<<<< x';\n// =======\n", "var o = { if: 1, 'b': 2, [c]: 3, get d() { return 1 }, async e() {}, f, ...g }", "try { a() } catch { b() } finally { c() }\nnew A.B(c).d\nthrow new E"],
    "typescript": ["export function f<T extends A = B>(a: T, b?: number, ...c: string[]): a is C { return <any>0 as any }".replace("<any>0 as any", "a as any"), "interface A<T> extends B, C<T> { readonly a?: string; [k: string]: any; f(x: number): void; new (x: T): A<T> }", "type U = { [K in keyof T]?: T[K] } & (A | B)[] | ((x: number) => Promise<Map<string, number[]>>)\n", "class A { accessor x = 1; static accessor y: number = 2; accessor = 3 }", "abstract class A implements B { private readonly x: number = 1; constructor(public y: string) { super() } abstract f(): void; g!: string }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nlet z = a! as unknown as string\n", "import type { A } from './a';\nfunction f(a: string): void;\nfunction f(a: any) {}\n", "type X<T> = T extends (infer U)[] ? U : never;"],
    "java": ["", "package a.b;\nimport static a.B.*;\n@A(x = {1, 2}, y = @B) public final class C<T extends D & E> extends F<T> implements G { int[] a = {1, 2}, b[]; static { x(); } <R> R f(final int... a) throws X { return a -> { return a; }; } }", "interface A { default void f() { for (int i = 0, j = 1; i < 3; i++, j--) {} for (var x : y) z: while (true) break z; } int C = 1; }", "enum E { A(1) { void f() {} }, B; E(int... x) {} }", "record P(int x, @A String y) { P { assert x > 0 : y; } }", "class A { Object f(Object o) { if (o instanceof String s && s.length() > 1) return (Runnable) () -> {}; return switch (o) { case Integer i when i > 1 -> i; case null, default -> { yield new int[][] {{1}, {}}; } }; } }", "class A { void f() { try (var a = b(); c) { List<? super Map<String, int[]>> d = new ArrayList<>(); d.<X>e(A::new, int[]::new); } catch (B | C e) { throw e; } char c = '\\''; long x = 1L >>> 2; x >>= 1; } }".replace(" x >>= 1;", "")],
    "go": ["package a\n", "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\ntype A struct {\n\tB\n\t*c.D\n\tx, y int `json:\"x\"`\n}\n\nfunc (a *A) F(x int, y ...string) (n int, err error) {\n\tif v, ok := m[x]; ok && v != nil {\n\t\treturn 1, nil\n\t} else if x := 1; x > 2 {\n\t}\n\tfor i, s := range y {\n\t\tgo func() { ch <- i }()\n\t\tdefer f(s)\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch t := x.(type) {\n\tcase int, *A:\n\tdefault:\n\t\tfallthrough\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\treturn\n}\n", "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar f func(int) (string, error) = g[int]\n\nfunc M[K comparable, V int | ~string](m map[K]V) []K { return append([]K(nil), a[1:2]...) }\n"],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "c\\u00e9\\n"}], "d": {}}', "[]", '"x"', " 1 "],
}
BAD = {
    "python": [("def f(:\n    pass\n", "edit"), ("x = (1,\n", "truncation"), ("def f():\n<<<<<<< HEAD\n    x = 1\n=======\n    x = 2\n>>>>>>> b\n", "conflict"), ("def f():\nreturn 1\n", "edit"), ("  x = 1\n y = 2\n", "edit"), ("x = 'a\n", "edit"), ("import { a } from 'b';\nfunction f() { return 1; }\nconst x = 2;\n", "mismatch"), ("a\x00b = 1\n", "edit")],
    "javascript": [("const a = = 1;", "edit"), ("function f() {\n  return 1;\n", "truncation"), ("import os\n\ndef f():\n    return 1\n", "mismatch"), ("<!DOCTYPE html>\n<p>x</p>\n", "mismatch"), ("const s = 'open;\n", "edit"), ("f(1))", "edit"), ("export function f(a: any): number { return 1; }", "mismatch"), ("let x = {\n<<<<<<< a\n  y: 1\n=======\n  y: 2\n>>>>>>> b\n}", "conflict")],
    "typescript": [("const a: = 1;", "edit"), ("interface A { x: number", "truncation")],
    "java": [("class A { int f() { return 1 } }", "edit"), ("class A { void f() { }", "truncation"), ("class A { int = 1; }", "edit"), ("package a\n\nfunc f() int { return 1 }\n", "mismatch"), ("package a\n\nfunc f(x any) int { y := 1; return y }\n\nfunc g() {}\n", "mismatch")],
    "go": [("package a\n\nfunc f() { x := }\n", "edit"), ("", "truncation"), ("func f() {}\n", "edit"), ("package a\n\nvar = := 1\n", "edit")],
    "json": [("{'a': 1}", "edit"), ('{"a": 1,}', "edit"), ('{"a": [1', "truncation"), ("", "truncation"), ('{"a" 1}', "edit"), ("NaN", "edit"), ('// x\n{"a": 1}', "edit"), ('{"a": 01}', "edit")],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(language, text):
    assert check(text, language).cost == 0


@pytest.mark.parametrize("language, text, cause", [(k, t, c) for k, ts in BAD.items() for t, c in ts])
def test_bad(language, text, cause):
    found = check(text, language)
    assert found.cost > 0 and found.cause == cause


@pytest.mark.parametrize("language, text", [
    *[(k, f"const a = `x ${{{t}}} y`;\nlet b = 1\n") for k in ("javascript", "typescript") for t in ("a +", "a b", "", "a)", "f(`${b c}`)", "const c")],
    ("typescript", "type A = `x${B C}`;\n"), *[("python", f"x = 1\ny = {t}\n") for t in ('f"{a b}"', 'f"{x"', 'f"{}"', 'f"a}b"', 'f"{a!z}"', 'f"{a:{b c}}"', "rf'''{\na +}'''", 'f"{f(}"', 'f"{lambda x: 1}"')],
])
def test_faults_within_substitutions(language, text):
    assert check(text, language).cost > 0


@pytest.mark.parametrize("language, text", [
    *[(k, f"const a = `x ${{{t}}} y`\nlet b = c / `${{d}}` / 2\n") for k in ("javascript", "typescript") for t in ("a", "a, b", "{ a: { b: '}' } }.a", "s.replace(/}`/g, '')", "f(`${`${a}` + b}`)", "() => {\n  let a = 1\n  return a\n}", "a /* } */ // `\n", "(await b)?.[c] ?? `}`")],
    ("typescript", "type A<K extends string> = `x${Capitalize<K & string>}${'a' | 'b'}`;\n"), ("javascript", "tag`a${b}c`.d`\\${ \\` $ {`\n"),
    *[("python", f"x = {t}\n") for t in ('f"{a!r:>{w}}{{}}" "b" f"{c}"', "f'{a[\"b\"]:%Y-%m-%d}'", 'f"{x["a"]}"', "rf'\\{a}\\''", 'f"\\N{DASH} {a = !r:>5} {b=}"', "f'''{\n  a  # c\n}\n{{x}}'''", 'f"{(lambda x: 1)(2)} {(y := 1)} {x:=5} {a != b} {*a, b} {yield}"', "f'{a:{b}.{c!s}}' % f'{ {1: 2}[1] }'", 'f"""a "b" {c + f"{d}"} """')],
])
def test_sound_substitutions(language, text):
    """Judged by the grammar itself, without the word of an exact parser."""
    assert repair(text, language).cost == 0


def test_repair_is_cheapest():
    g = Grammar("s := 'a' 'b'* 'c'\n")
    g.left_items = 10**6
    assert g.accepts("s", ("a", "b", "b", "c")) and not g.accepts("s", ("a", "b"))
    assert g.repair("s", ("a", "b", "c"))[0] == 0
    assert g.repair("s", ("a", "b")) == (1, (1,))  # of equally cheap repairs the one that begins first: b replaced, not c inserted
    assert g.repair("s", ("b", "c")) == (1, (0,)) and g.repair("s", ("a", "x", "c")) == (1, (1,))
    assert g.repair("s", ()) is None and g.repair("s", (), 2) == (2, (0,))


@pytest.mark.parametrize("text", ["s := 'a' 'b'* 'c'", "s := 'a' s 'b' | 'c'", "s := ('a' | 'b' 'c')* 'd'?", "s := t (',' t)*\nt := 'a' | 'b' ';' | u\nu := 'c' u | 'd'"])
def test_cost_equals_brute_force(text):
    """The edit distance to the nearest of all texts of the language that could be it."""
    g = Grammar(text + "\n")
    kinds = sorted({s[1:] for s in g.symbol if s and s[0] == "'"}) + ["z"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        return row[-1]

    texts = [t for n in range(8) for t in itertools.product(kinds[:-1], repeat=n) if g.accepts("s", t)] if len(kinds) < 6 else [t for n in range(6) for t in itertools.product(kinds[:-1], repeat=n) if g.accepts("s", t)]
    r = random.Random(2)
    for _ in range(120):
        seq = tuple(r.choice(kinds) for _ in range(r.randrange(0, 5)))
        want = min(distance(seq, t) for t in texts)
        cost, path, exact = g.cheapest("s", seq, 10**6)
        assert exact and cost == want, (seq, cost, want)
        assert (path == NOWHERE) == (not want)


def test_repair_goes_into_groups():
    g = Grammar("s := 'f' (<args> ';'\nargs := ('x' (',' 'x')*)?\n")
    call = lambda *c: ("f", Group("(", c, 1, tuple(range(len(c)))), ";")
    cost = lambda seq: g.cheapest("s", seq, 10**6)
    assert cost(call("x", ",", "x"))[0] == 0 and cost(call("x", "x"))[:2] == (1, (1, 0)) and cost(call("x", ",", "y", ","))[0] == 2
    assert cost(("f", ";"))[:2] == (2, (1,))  # both brackets come
    assert cost(("f", Group("[", ("x",), 1, (0,)), ";"))[0] == 5  # all of one part goes, another one comes
    assert cost((*call("x")[:2], Group("(", ("x", "x"), 5, (0, 0)), ";"))[0] == 4
    assert g.cheapest("s", call("x", "x"), 3) == (1, (0,), False)  # a bound where the search may not go on


@pytest.mark.parametrize("language, text, offset", [("java", "class A { int f() { return g(1 2); } int h() { return 3; } }", 32), ("javascript", "let a = 1;\nfunction f() { const y = ; }\nlet b = 3;\n", 30), ("python", "a = 1\ndef f(x):\n    if x\n        return 1\nb = 2\n", 28), ("go", "package a\n\nfunc f() {\n\tx := = 1\n}\n", 29)])
def test_where_it_is_cheapest_to_edit(language, text, offset):
    found = check(text, language)
    assert found.exact and found.cost == 1 and abs(found.offset - offset) <= 6


@pytest.mark.parametrize("language, text", [("javascript", "x = " + "[" * 6_000 + "]" * 6_000 + ";\n"), ("go", "package a\n\nvar x = " + "(" * 6_000 + "1" + ")" * 6_000 + "\n"), ("json", "[" * 50_000 + "]" * 50_000), ("java", "class A { int x = " + "(" * 6_000 + "1" + ")" * 6_000 + "; }"), ("python", "x = " + "(" * 6_000 + "1" + ")" * 6_000 + "\n")])
def test_deep_nesting(spark, language, text):
    """As deep as it is, alone and twice in a table; a fault at the bottom is found."""
    ext = {"javascript": "js", "go": "go", "json": "json", "java": "java", "python": "py"}[language]
    middle = len(text) // 2
    df = spark.createDataFrame([(f"a.{ext}", text), (f"b.{ext}", text), (f"c.{ext}", text[:middle] + " ; = " + text[middle:])], "path string, content string")
    files = spark.createDataFrame([], "path string, language string, indexed_at long, repo string")
    assert {r.path for r in validity.unparsable(df, files).collect()} == {f"c.{ext}"}


def test_exact_parsers_agree():
    """Python and JSON of the test data: no flag differs from that of the language's own parser."""
    pd = pytest.importorskip("pandas")
    import os

    path = "/root/testdata/sf0.01/sources.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    for p, t in pd.read_parquet(path)[["path", "content"]].drop_duplicates().itertuples(index=False):
        language = language_of(p, None)
        if language in ("python", "json"):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(t) if language == "python" else json.loads(t.removeprefix("\ufeff"), parse_constant=lambda x: 1 / 0)
                sound = True
            except (SyntaxError, ValueError, ZeroDivisionError):
                sound = False
            assert (check(t, language).cost == 0) == sound, p


def test_languages():
    assert language_of("a.py", " JS ") == "javascript" and language_of("a/b.Go", None) == "go" and language_of("x.go/none", "??") is None


def test_files(spark, rows):
    src = spark.createDataFrame(
        [("r/a.py", "x = 1\n"), ("r/a.py", "x = 1\n"), ("r/b.py", "x = (\n"), ("r/c.js", "x = 1\n"), ("r/d.js", "const x = 1"), ("r/e.txt", "x = ("), ("r/f.json", None), ("r/g.py", None), (None, "x = ("), ("r/h.py", "x = 1\n"), ("r/h.py", "x = ")],
        "path string, content string",
    )
    files = spark.createDataFrame([("r/d.js", "Python", 2, "q"), ("r/d.js", "js", 1, "q"), ("r/c.js", "py", 1, None), ("r/a.py", None, None, None), (None, "py", 1, "r")], "path string, language string, indexed_at long, repo string")
    assert rows(validity.unparsable(src, files).select("path")) == [("r/b.py",), ("r/d.js",), ("r/f.json",), ("r/h.py",)]
    got = {(r.repo, r.language): (r.files, r.faulty) for r in validity.rates(src, files).collect()}
    assert got[("q", "python")] == (1, 1) and got[("r", "json")] == (1, 1) and got[("r", "python")] == (5, 2)
    assert rows(validity.unparsable(src.limit(0), files.limit(0))) == []


def test_long_file():
    assert check("x = [" + "1, " * 200_000 + "]\n", "python").cost == 0
    assert check("{" * 30 + "}" * 30, "javascript").cost == 0


def _nested(r, depth=0):
    out = []
    for _ in range(r.randrange(0, 6)):
        if depth < 3 and r.random() < 0.4:
            inner = _nested(r, depth + 1)
            out.append(Group(r.choice("(["), inner, 1, tuple(range(len(inner)))))
        else:
            out.append(r.choice("xfg+;,yz"))
    return tuple(out)


@pytest.mark.parametrize("wide, fits", [(64, 99), (0, 99), (2, 3), (1, 1), (0, 2)])
def test_table_bounds_and_layers_agree(monkeypatch, wide, fits):
    """The table of spans, bounds of long groups, and layers for what has no table give the same cost and place."""
    text = "s := st*\nst := e eos\neos := ';' | ENDMARK\ne := 'x' | 'f' (<args> | e '+' e | (<e> | 'g' (<p>\np := 'x'* 'y'\nargs := (e (',' e)*)?\n"
    g, layers, r = Grammar(text), Grammar(text), random.Random(11)
    monkeypatch.setattr(chart, "WIDE", wide)
    monkeypatch.setattr(table, "BYTES", 4 * fits * (fits + 1) * len(table.Table(g).left))
    for _ in range(100):
        seq = _nested(r)
        assert g.cheapest("s", seq) == layers.cheapest("s", seq, 10**9)


@pytest.mark.parametrize("language, text, cost", [
    ("javascript", "f(a b c d e g h i j k);\n" * 3, 15), ("java", "class A { void f() { int x = = 1; g(1 2 3 4 5 6); } }\n" + "class B { int = 1; }\n" * 6, 10),
    ("json", f"[{', '.join('1' * 20)}] [{', '.join('1' * 20)}]", 41), ("python", "def f(x):\n    return x +\n" * 9, 9),
])
def test_every_cost_is_exact(language, text, cost):
    """However many edits it takes; what goes counts with all its tokens. Every second argument becomes a comma."""
    found = check(text, language)
    assert found.exact and found.cost == cost


def test_causes_sum_exact_costs(spark, tmp_path):
    """Texts of another language too."""
    texts = {"a.py": "import { a } from 'b';\nfunction f() { return 1; }\nconst x = 2;\n", "b.py": "def f(x):\n    return x +\n" * 9, "c.js": "f(a b c d e g h i j k);\n" * 3, "d.js": "let a = 1\n"}
    spark.createDataFrame(list(texts.items()), "path string, content string").write.parquet(str(tmp_path / "sources.parquet"))
    spark.createDataFrame([], "path string, language string, indexed_at long, repo string").write.parquet(str(tmp_path / "files.parquet"))
    got = {(r.language, r.cause): (r.files, r.edits, r.exact_files) for r in queries.p5_causes(spark, str(tmp_path)).collect()}
    assert got == {("python", "mismatch"): (1, check(texts["a.py"], "python").cost, 1), ("python", "edit"): (1, 9, 1), ("javascript", "edit"): (1, 15, 1)}
    assert got[("python", "mismatch")][1] > 5
    assert {r.path for r in queries.p5_found(spark, str(tmp_path)).collect()} == {"a.py", "b.py", "c.js"}
