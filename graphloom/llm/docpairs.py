"""Functions and methods paired with their documentation.

Method: comment spans and function spans are extracted from a source text independently of each other. An as-of join on
the lines attaches to each function the nearest comment that ends before it, and rejects it where anything but the function's own
annotations, however many lines they take, stands between; a string that opens a body is a comment span inside the function. This
runs over whole files (:func:`source_pairs`), and over the bodies of symbols whose indexer kept no documentation. Documentation is then weighed: what
addresses tools or people, stands in for text, repeats the name or the parameters or is code is set aside, and a pair
is kept only where words remain that tell something new.

Defined results: of several rows of a symbol the one with the highest updated_at holds (a row without one is the oldest);
a null docstring makes the text in body count, a blank one says nothing, a null body has none; rows with a null id are dropped; a symbol
whose kind is neither function nor method in its valid row is no case.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- spans ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    start: int  # first line
    end: int  # last line
    text: str
    name: str = ""


_PY_STRING = re.compile(r"""\s*[rRuUbBfF]{0,2}("{3}|'{3})""")
_FUNCTION = re.compile(
    r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|synchronized|native|virtual|pub|inline)\s+)*"
    r"(?:def\s+(?P<py>\w+)|function\s*\*?\s*(?P<js>[\w$]+)|func\s+(?:\([^)]*\)\s*)?(?P<go>\w+)|fn\s+(?P<rs>\w+)"
    r"|(?!(?:return|else|new|throw|case|await|if|for|while|switch|catch|do|try|yield|delete|typeof)\b)(?:[\w$<>\[\],.?]+\s+)*(?P<cl>[\w$]+)\s*\([^;{}]*\)\s*(?::\s*[^;{}]+?)?(?:throws\s+[\w., ]+)?\s*\{)"
)


def comment_spans(lines: list[str], python: bool) -> list[Span]:
    """Block comments, and runs of line comments, that stand on lines of their own; in Python also the strings that stand as statements."""
    out: list[Span] = []
    i, n = 0, len(lines)
    mark = "#" if python else "//"
    while i < n:
        s = lines[i].strip()
        if s.startswith(mark):
            j = i
            while j + 1 < n and lines[j + 1].strip().startswith(mark):
                j += 1
            out.append(Span(i, j, "\n".join(lines[i : j + 1])))
            i = j + 1
            continue
        if not python and s.startswith("/*"):
            j = i
            while j < n and "*/" not in (lines[j][lines[j].index("/*") + 2 :] if j == i else lines[j]):
                j += 1
            tail = lines[min(j, n - 1)].rpartition("*/")[2].strip()
            if not tail:
                out.append(Span(i, min(j, n - 1), "\n".join(lines[i : j + 1])))
            i = j + 1
            continue
        m = _PY_STRING.match(lines[i]) if python else None
        if m:
            q, j = m.group(1), i
            rest = lines[i][m.end() :]
            while q not in rest and j + 1 < n:
                j += 1
                rest = lines[j]
            out.append(Span(i, j, "\n".join(lines[i : j + 1])))
            i = j + 1
            continue
        i += 1
    return out


def function_spans(lines: list[str]) -> list[Span]:
    """Where definitions start; ``end`` is the line on which the signature ends."""
    n, open_ = len(lines), [0]
    for line in lines:
        open_.append(open_[-1] + line.count("(") - line.count(")"))
    ends, later = [n - 1] * n, []  # from each line the first one at whose end its brackets are closed
    for k in range(n, -1, -1):
        while later and open_[later[-1]] > open_[k]:
            later.pop()
        if k < n and later:
            ends[k] = later[-1] - 1
        later.append(k)
    return [Span(i, ends[i], line, next(g for g in m.groups() if g)) for i, line in enumerate(lines) if (m := _FUNCTION.match(line))]


def attach(functions: list[Span], comments: list[Span], lines: list[str], python: bool) -> list[tuple[Span, str]]:
    """As-of join: each function with the nearest eligible comment before it, in Python rather with the string that opens its body."""
    ends = [c.end for c in comments]
    starts = {c.start: c for c in comments}
    out = []
    for f in functions:
        if python:
            j = f.end + 1
            while j < len(lines) and not lines[j].strip():
                j += 1
            inner = starts.get(j)
            if inner and _PY_STRING.match(lines[j]):
                out.append((f, inner.text))
                continue
        k = bisect_right(ends, f.start - 1) - 1
        while k >= 0 and python and _PY_STRING.match(lines[comments[k].start]):  # a string before a definition documents something else
            if comments[k].end >= f.start - 1 or not _annotations(lines[comments[k].end + 1 : f.start]):
                k = -1
            else:
                k -= 1
        if k >= 0 and _annotations(lines[comments[k].end + 1 : f.start]):
            out.append((f, comments[k].text))
        else:
            out.append((f, ""))
    return out


def _annotations(between: list[str]) -> bool:
    """Whether lines are decorators or annotations of what follows, brackets closed, and nothing else."""
    depth = 0
    for line in between:
        bare = line.strip()
        if depth <= 0 and not bare.startswith("@"):
            return False
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
    return depth <= 0


def documentation(docstring: str | None, body: str | None, language: str | None) -> str:
    """The documentation of one symbol: its docstring, or where there is none what the spans of its body give."""
    if docstring is not None:
        return docstring
    if not body:
        return ""
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    python = (language or "").strip().lower() in ("python", "py") or re.match(r"\s*(?:(?:#|@).*\n\s*)*(?:async\s+)?def\s", body) is not None
    functions = function_spans(lines)
    if not functions:
        return ""
    return attach(functions[:1], comment_spans(lines, python), lines, python)[0][1]


# --- weighing ------------------------------------------------------------------------------------------------------

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+|//+!?|#+!?|--+|;+|[rRuU]?\"{3}|[rRuU]?'{3})|(?:\*+/|\"{3}|'{3})\s*$")
_TAG = re.compile(r"^\s*(?:[@\\:][\w-]+|\{@[\w-]+[^}]*\})")
_TAG_TEXT = re.compile(r"^\s*[@\\:](?:brief|summary|description|desc|details|remarks?|note|deprecated|remark|warning|apiNote|implNote)\b:?\s*")
_SECTION = re.compile(r"^\s*(?:examples?|usage|args?|arguments|parameters|params|returns?|raises|throws|yields|attributes|see also|references)\s*:\s*$", re.I)
_TOOL = re.compile(
    r"\b(?:noqa|nolint|nosonar|noinspection|pylint|flake8|mypy|pyright|ruff|eslint|tslint|jshint|jslint|prettier|istanbul|c8|webpack\w*|clang-format|checkstyle|suppresswarnings"
    r"|swiftlint|rubocop|codacy|sonar|coverage|biome|stylelint)\b|\btype:\s*ignore|\bpragma\b|@?ts-(?:ignore|nocheck|expect-error)|\bfmt:\s*(?:on|off)|\b(?:end)?region\b|go:(?:generate|build|embed)|\+build|isort:|yapf:|-\*-",
    re.I,
)
_PERSON = re.compile(
    r"^\W*(?:todo|fixme|xxx|hack)\b|\b(?:TODO|FIXME|XXX)\b|\bauthors?\s*:|^\W*authors?\b|\bcopyright\b|\(c\)\s*\d{4}|all rights reserved|\bredistribution and use\b|\bredistribution in source\b|\blicen[sc]ed under\b|\bspdx\b"
    r"|^\W*(?:created|written|owned|maintained|reviewed|approved) by\W+(?:the\W+)?[\w.@-]+(?:\W+(?:team|group|squad|guild|on\b.*|in \d{4}.*))?\W*$|^\W*(?:reviewers?|maintainers?|owners?|contact)\s*:|^\W*created on\b"
    r"|\bdate\s*:|\bsince\s*:|\bversion\s*:|@\w+",
    re.I,
)
_POINTER = re.compile(r"^\W*(?:see|refer to|cf\.?|same as|as (?:in|above)|inherit\w*|inherited from|overrides?|overridden|copied from|siehe|ver|voir|véase)\b[^.]{0,60}\.?\W*$", re.I)
_CODE = re.compile(r"^\s*(?:[\w.\[\]]+\s*(?:[+\-*/]?=|:=)\s*\S.*|(?:return|import|from|print|raise|throw|const|let|var|if|for|while)\b.*[\])};]\s*$|(?:return|const|let|var)\s+[\w.\[\]()]+\s*|[\w.]+\([^)]*\)\s*[;{]?|[{}();\]\[]+|>>>.*|\.\.\..*)$")
_CONTRACT = re.compile(r"^\W*(?:it |this \w+ |the \w+ )?(?:takes|accepts|receives|expects)\s+\w+(?:(?:,| and|, and)\s+\w+)*?(?:,?\s+and)?\s+(?:returns|gives|yields)\s+(?:an? |the )?\w+\W*$", re.I)
_RULE = re.compile(r"^[\W_]*$")
_SENTENCE = re.compile(r"(?<=[.!?。!?;;])\s+|(?<=[。!?])|\n\s*\n")
_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}'-]*|-?\d+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")

# Words that say nothing about what a symbol does, whichever symbol it is.
FILLER = frozenset(
    """a an the this that these those it its is are was be been being to of for from in on at by with and or as into which who what whose
    function functions func method methods fn procedure routine helper helpers utility util utils class module object instance member constructor getter setter
    simple simply basic generic general common main new old some any given used uses use using useful called calls call does do done did will can may just only also here there
    return returns returned returning takes take taken accepts accept receives receive gets get sets set provides provide performs perform implements implement handles handle executes execute runs run
    value values result results param params parameter parameters arg args argument_list input_value output_value int integer string str bool boolean float double void none null nil nothing number list dict array any
    internal private public protected static abstract deprecated override overridden default async note
    logic code stuff thing things implementation impl work body test wrapper base default""".split()
)
# Words of texts that stand in for documentation, in several languages.
STAND_IN = frozenset(
    """todo tbd tba fixme xxx wip na n/a none nil empty blank undocumented missing placeholder stub auto auto-generated autogenerated generated pending unfinished incomplete draft lorem ipsum
    add added insert write fill put enter please describe description descriptions doc docs document documented documentation documenting comment comments docstring javadoc jsdoc text here goes later soon needed need needs required details detail explain explanation
    no not yet to be this the a an of for method function
    noch zu zur dokumentieren dokumentation dokumentiert fehlt fehlende beschreibung beschreiben hier folgt spaeter später offen ergänzen ergaenzen nicht
    a à completer compléter completar documenter documentation faire décrire decrire description manquante venir rédiger
    por documentar documentacion documentación pendiente falta descripcion descripción completar hacer describir sin de aqui aquí aún aun
    da documentare completare fare descrizione mancante documentar descrever descrição fazer falta ausente""".split()
)
# Characters of such texts in Chinese and Japanese.
STAND_IN_CJK = re.compile(r"未完成|待补充|待完善|待实现|待添加|待定|暂无\w*|无描述|无|此处\w*说明|说明|描述|文档|注释|占位\w*|请\w*补充|未実装|後で\w*|説明|ドキュメント|なし|要追加|未記入|미완성|추가 예정|설명 없음")


def _stem(w: str) -> str:
    """A word without its common English endings; both sides of a comparison go through it, so it need not be a word."""
    w = w.lower()
    for suffixes in (("ing", "ed", "s"), ("e", "y", "ie")):
        for suffix in suffixes:
            if len(w) - len(suffix) >= 3 and w.endswith(suffix):
                w = w[: -len(suffix)]
                break
    w = w[:-1] if len(w) > 3 and w[-1] in "eyi" else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_parts(*texts: str | None) -> set[str]:
    """Stems of the words within identifiers."""
    out = set()
    for t in texts:
        for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", t or ""):
            out.update(_stem(p) for p in _CAMEL.findall(w))
    return out


def _sentences(doc: str) -> list[str]:
    """Sentences of prose: without comment marks, tags, sections of examples and parameters, rules and code."""
    kept: list[str] = []
    skip = tag = False
    for raw in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw
        for _ in range(3):
            line = _MARKS.sub("", line, count=1)
        bare = line.strip()
        if not bare or _RULE.match(bare):
            skip = tag = False
            kept.append("")
            continue
        if _SECTION.match(bare):
            skip = True
            continue
        m = _TAG_TEXT.match(bare)
        if m:
            bare, tag = bare[m.end() :], False
        elif _TAG.match(bare):
            tag = True
            continue
        elif tag and raw[:1].isspace() and len(raw) - len(raw.lstrip()) > 3 and not kept[-1:]:
            continue
        if skip or _CODE.match(bare):
            continue
        kept.append(bare)
    paragraphs = "\n".join(kept)
    return [s.replace("\n", " ").strip() for s in _SENTENCE.split(paragraphs) if s and s.strip()]


def first_line(body: str | None) -> str:
    """The definition line of a body."""
    for line in (body or "").split("\n"):
        if _FUNCTION.match(line):
            return line
    return ""


def informative(doc: str | None, name: str | None, signature: str | None) -> str:
    """The sentences of ``doc`` that tell something the name and signature do not; '' if there are none."""
    if not doc or not doc.strip():
        return ""
    known = name_parts(name, signature)
    told: list[str] = []
    for s in _sentences(doc):
        if _TOOL.search(s) or _PERSON.search(s) or _POINTER.match(s) or _CONTRACT.match(s):
            continue
        words = [w.lower().strip("'-") for w in _WORD.findall(s)]
        words = [w for w in words if w]
        han = STAND_IN_CJK.sub("", s)
        if len(_CJK.findall(han)) >= 4:
            told.append(s)
            continue
        if words and all(w in STAND_IN for w in words):
            continue
        new = {w for w in words if w not in FILLER and _stem(w) not in known and (len(w) > 1 or w.isdigit())}
        if len(new) >= 2 and not new <= STAND_IN:
            told.append(s)
    return " ".join(told)


def source_pairs(sources: DataFrame) -> DataFrame:
    """path, line (from 1), name, signature, description of each function or method in source files whose documentation tells something."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["content"]):
                lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                python = path.lower().endswith((".py", ".pyi"))
                inside = {k for c in comment_spans(lines, python) for k in range(c.start, c.end + 1)}
                functions = [s for s in function_spans(lines) if s.start not in inside]
                for s, doc in attach(functions, comment_spans(lines, python), lines, python):
                    signature = " ".join(" ".join(lines[s.start : s.end + 1]).rstrip("{: ").split())
                    told = informative(doc, s.name, signature)
                    if told:
                        out.append((path, s.start + 1, s.name, signature, told))
            yield pd.DataFrame(out, columns=["path", "line", "name", "signature", "description"])

    rows = sources.filter("path is not null and content is not null").filter(~F.lower("path").endswith(".json")).select("path", "content")
    return rows.mapInPandas(run, "path string, line int, name string, signature string, description string").distinct()


# --- operator ------------------------------------------------------------------------------------------------------


def describe(nodes: DataFrame) -> DataFrame:
    """id, updated_at, is_function, signature, body, description of every row of ``nodes``; evaluated where the row is read, before any shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [informative(documentation(d, b, lang), n, s or first_line(b)) if k else "" for k, d, b, lang, n, s in zip(f["is_function"], f["docstring"], f["body"], f["language"], f["name"], f["signature"])]
            yield f[["id", "updated_at", "is_function", "signature"]].assign(description=said, code=[s if s else b for s, b in zip(f["signature"], f["body"])])

    is_function = F.coalesce(F.lower(F.trim("kind")).isin("function", "method"), F.lit(False))
    rows = nodes.filter("id is not null").select(
        F.lower(F.btrim("id")).alias("id"), F.coalesce("updated_at", F.lit(-(2**62))).alias("updated_at"), is_function.alias("is_function"), "name", "signature",
        F.when(is_function, F.col("docstring")).alias("docstring"), F.when(is_function & (F.col("docstring").isNull() | F.col("signature").isNull()), F.col("body")).alias("body"), "language",
    )
    return rows.mapInPandas(run, "id string, updated_at long, is_function boolean, signature string, description string, code string")


def documented(nodes: DataFrame) -> DataFrame:
    """id of symbols whose valid row is a function or method with telling documentation."""
    rows = describe(nodes).select("id", F.struct("updated_at", (F.col("is_function") & (F.col("description") != "")).alias("told")).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).filter("r.told").select("id")


def pairs(nodes: DataFrame) -> DataFrame:
    """id, code (signature, or body where there is none), description."""
    rows = describe(nodes).groupBy("id").agg(F.max(F.struct("updated_at", "is_function", "code", "description")).alias("r"))
    return rows.filter("r.is_function and r.description <> ''").select("id", "r.code", "r.description")
