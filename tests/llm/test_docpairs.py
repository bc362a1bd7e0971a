import time
import pytest

from graphloom.llm import docpairs as D

SCHEMA = "id string, kind string, name string, signature string, docstring string, body string, language string, updated_at long"


@pytest.mark.parametrize(
    "doc",
    [
        "Keeps only the newest row of each key.", "/** Not thread-safe; hold the lock. */", "# Raises on a closed store.", "Mutates its argument.", "TODO: split this up later.\n\nRetries 16 times with growing pauses.", "按层遍历入边,超过 500 层后停止。",
        "Liest die Kanten der Reihe nach und bricht bei der ersten Luecke ab.", "Agrupa los enlaces por archivo.", "Deprecated: flush in two passes of 50 only for callers of the old store.", "@param a where to begin\nReturns -1 past the end.", "See also the wiki. Drops links whose source has gone.", "Reviewed by the scheduler before dispatch, blocks until acknowledged.", "Owned by whoever opened the store; closing it twice raises.", "Keeps the author and licence fields of each record.", "Skips rows marked as hack attempts.",
    ],
)
def test_telling(doc):
    assert D.informative(doc, "mergeNode", "int mergeNode(Object a)")


@pytest.mark.parametrize(
    "doc",
    [
        None, "", "   ", "TODO", "/** FIXME add docs */", "Merges the node.", "mergeNode()", "This function merges node.", "@param a\n@return", ":param a:\n:rtype: int\n:return:", "noqa: D103", "// eslint-disable-next-line no-unused-vars", "{@inheritDoc}", "See base class.", "未完成", "待补充",
        "noch zu dokumentieren", "por documentar", "a completer", "Copyright 2024 Some Works. All rights reserved.", "author: dev1, date: 2024-02-11", "Reviewed by dev3.", "Owned by the storage team", "Written by A.Moss on 2024-01-02", "reviewer: dev9", "==========", "x = mergeNode(a)\nreturn x[1]", "Auto-generated method stub", "The function that is used to merge the node. It takes a and returns an int.", "Helper.", "region helpers", "@deprecated",
    ],
)
def test_not_telling(doc):
    assert D.informative(doc, "mergeNode", "int mergeNode(Object a)") == ""


def test_spans_and_join():
    body = "// Far away, another thing entirely.\n\nint x = 1;\n// Drops rows that came late.\n@Override\npublic int f(Object a) {\n  // inner note about rows\n  return 1;\n}"
    assert "Drops rows" in D.documentation(None, body, "java")
    assert D.documentation(None, "// A note on rows and keys.\nint x = 1;\nint f() {\n}", "java") == ""
    assert D.documentation(None, "// A note on rows and keys.\n\nint f() {\n}", "java") == ""
    assert "late rows" in D.documentation(None, 'def f(a,\n      b):\n    """Drops late rows."""\n    return 1', "python")
    assert "late rows" in D.documentation(None, "# Drops late rows.\n@cached\ndef f():\n    return 1", "python")
    assert D.documentation(None, "def f():\n    x = 1\n    # Drops late rows.\n    return x", "python") == ""
    assert D.documentation("kept", "# Other words here.\ndef f(): pass", "python") == "kept"
    assert D.documentation(None, None, None) == "" and D.informative(D.documentation(" ", "# Drops late rows.\ndef f(): pass", "python"), "f", None) == "" and D.documentation(None, "x" * 100_000, None) == ""


def test_nearest_comment_is_joined_over_annotations_only():
    told = "// Drops rows that came late."
    decorated = told + '\n@Route(\n  path = "/a",\n  tags = {"b", "c"}\n)\n@Override\npublic int f(Object a) {\n  return 1;\n}'
    assert "late" in D.documentation(None, decorated, "java")
    assert D.documentation(None, told + "\n@Route(\n  1)\nint x = 1;\npublic int f(Object a) {\n}", "java") == ""
    assert D.documentation(None, told + "\n\n@Override\npublic int f(Object a) {\n}", "java") == ""


def test_whole_files(spark):
    py = '"""About the file, not a function."""\nimport os\n\n# Keeps only the newest row of each key.\n@cached(\n    size=3,\n)\ndef newest(rows):\n    return rows\n\n\nclass A:\n    def close(self, hard=False):\n        """Waits for readers before the file is cut."""\n\n    # def old(): Drops late rows.\n    def bare(self):\n        return 1\n\nX = 1  # no comment of its own\ndef g():\n    pass\n'
    js = "/**\n * Sorts by weight, ties by name.\n */\nexport function order(a, b) {\n  return a - b;\n}\n\n// Drops late rows.\nconst y = 1;\nfunction h() {}\n// TODO\nfunction i() {}\n"
    df = spark.createDataFrame([("a/x.py", py), ("a/x.py", py), ("a/y.js", js.replace("\n", "\r\n")), ("a/z.json", '{"a": 1}'), ("a/n.py", None), (None, py), ("a/e.js", "")], "path string, content string")
    got = sorted((r.path, r.line, r.name, r.description) for r in D.source_pairs(df).collect())
    assert got == [("a/x.py", 8, "newest", "Keeps only the newest row of each key."), ("a/x.py", 13, "close", "Waits for readers before the file is cut."), ("a/x.py", 17, "bare", "def old(): Drops late rows."), ("a/y.js", 4, "order", "Sorts by weight, ties by name.")]
    assert D.source_pairs(df.limit(0)).count() == 0


def test_valid_row_decides(spark, rows):
    told, bare = "Drops links whose source has gone.", "TODO"
    df = spark.createDataFrame(
        [
            ("A", "Function", "f", None, told, None, "python", 1), ("a", "FUNCTION", "f", None, bare, None, "python", 2), ("b", "method", "g", "g()", None, "// " + told + "\nint g() {\n}", "java", 1), ("b", "method", "g", "g()", None, "// " + told + "\nint g() {\n}", "java", 1),
            ("c", "class", "h", None, told, None, None, 3), ("d", "function", None, None, told, None, None, None), (None, "function", "x", None, told, None, None, 1), ("e", None, None, None, None, None, None, None),
        ],
        SCHEMA,
    )
    assert rows(D.documented(df)) == [("b",), ("d",)]
    assert rows(D.pairs(df)) == [("b", "g()", told), ("d", None, told)]
    assert rows(D.documented(df.limit(0))) == []


def test_signature_of_many_lines():
    body = "def f(\n" + "".join(f"    a{i},\n" for i in range(100)) + '):\n    """Drops late rows."""\n    return 1'
    assert "late rows" in D.documentation(None, body, "python")
    assert [(f.start, f.end) for f in D.function_spans(body.split("\n"))] == [(0, 101)]


def test_signatures_that_never_close_take_one_pass():
    lines = ["def f(a,"] * 20_000
    at = time.process_time()
    assert D.function_spans(lines)[0].end == len(lines) - 1 and D.documentation(None, "\n".join(lines), "python") == ""
    assert time.process_time() - at < 5
