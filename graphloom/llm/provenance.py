"""Generated, minified, vendored files and data stored as code.

Method: attribute files (``.gitattributes``) are parsed, and each path gets its marks by their precedence: a deeper folder's
file overrides a higher one's, within a file a later line an earlier, for each attribute by itself. A path meets only the files
of its own folders, by an equality join on the folder. For paths that no attribute file speaks of, equivalent patterns
are mined from the corpus: a folder name, or a double suffix, counts as a mark where most of the files it covers, in several
repositories, are declared or prove by their content what they are. The content's proof is: a header in the first comment,
numbered repetition, the density of minified code, the share of literals, and code blocks that stand alike in several
repositories. A name alone, however suggestive, proves nothing.

Attributes are read as Git reads them: the first matching attribute of a later line wins, ``-attr`` and ``attr=false`` unset it,
``!attr`` leaves it unspecified, patterns may be quoted, ``*`` stops at a slash and ``**`` does not, ``[..]`` are classes, a
pattern without a slash matches the file's name in any folder below, one that ends with a slash names folders only and so no
file, negative patterns are none, and ``[attr]name`` in a root file defines a macro.

Defined results: null and blank contents are hand-written; repeated rows count once; a path with several contents is a case
if one of them is; JSON files never are; where ``linguist-generated`` is unset a file is no longer held for generated, minified
or data, where ``linguist-vendored`` is unset not for vendored, whatever its content or its patterns say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut, small

#: A mined pattern must cover so many files in so many repositories, and so many of them must prove it.
MIN_FILES, MIN_SHARE = 5, 0.6
#: Attribute files up to which they are broadcast; beyond it they meet the paths in a shuffle.
ATTRIBUTE_FILES = 2_000

# --- attribute files -----------------------------------------------------------------------------------------------


_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"(?=\s|$)|(\S+)')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_STATE = re.compile(r"([-!]?)([A-Za-z0-9_.-]+)(?:=(.*))?\Z", re.S)
#: States of an attribute.
SET, UNSET, UNSPECIFIED = "set", "unset", "unspecified"


def _unquoted(s: str) -> str:
    """A quoted pattern as C would read it; octal escapes are bytes."""
    out = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if len(m[1]) == 3 else _ESCAPES.get(m[1].decode(), m[1].decode()).encode(), s.encode(), flags=re.S)
    return out.decode("utf-8", "replace")


def parse_attributes(text: str, root: bool = True) -> list[tuple[str, str, str]]:
    """(pattern, 'generated' or 'vendored', state) in the order of the file; macros of a ``root`` file are resolved."""
    out: list[tuple[str, str, str]] = []
    macros: dict[str, list[tuple[str, str]]] = {}

    def states(words: str) -> list[tuple[str, str]]:
        found: list[tuple[str, str]] = []
        for w in words.split():
            m = _STATE.match(w)
            if not m:
                continue
            sign, name, value = m.groups()
            state = UNSPECIFIED if sign == "!" else UNSET if sign == "-" or (value or "").lower() in ("false", "0") else SET
            if name in macros and state == SET:
                found.extend(macros[name])
            k = re.fullmatch(r"linguist-(generated|vendored)", name)
            if k:
                found.append((k.group(1), state))
        return found

    for line in text.removeprefix("\ufeff").split("\n"):
        line = line.strip(" \t\r")
        m = _FIELD.match(line)
        if not m or line.startswith("#"):
            continue
        pattern, rest = _unquoted(m[1]) if m[1] is not None else m[2], line[m.end() :]
        if m[1] is None and pattern.startswith("[attr]"):
            if root:
                macros[pattern[6:]] = states(rest)
        elif not pattern.startswith("!"):
            out.extend((pattern, kind, state) for kind, state in states(rest))
    return out


@lru_cache(100_000)
def attribute_regex(pattern: str) -> re.Pattern[str] | None:
    """What a pattern matches of the path below its file's folder; None if that can be no file."""
    if pattern.endswith("/"):
        return None
    body = pattern.removeprefix("/")
    out = "" if "/" in pattern else "(?:.*/)?"
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == n:
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i < n and body[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            m = re.compile(r"\[([!^]?)(\]?(?:\[:[a-z]+:\]|\\.|[^\]\\])*)\]").match(body, i)
            if not m:
                return None  # an open class matches nothing
            inner = re.sub(r"\[:([a-z]+):\]", lambda k: _CLASSES.get(k[1], ""), m[2])
            inner = re.sub(r"(?<!\\)([\[&~|^])", r"\\\1", inner)
            inner = ("\\" + inner) if inner.startswith("]") else inner
            try:
                re.compile(f"[{inner}]")
            except re.error:
                return None
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", m.end()
        elif c == "\\" and i + 1 < n:
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out + r"\Z", re.S)


# Named classes of patterns.
_CLASSES = {"alnum": "A-Za-z0-9", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "space": r"\s", "xdigit": "A-Fa-f0-9", "punct": r"!-/:-@\[-`{-~"}


@lru_cache(10_000)
def rules_of(text: str, root: bool) -> tuple[tuple[re.Pattern[str], str, str], ...]:
    """Compiled lines of an attribute file."""
    return tuple((r, kind, state) for pattern, kind, state in parse_attributes(text, root) if (r := attribute_regex(pattern)) is not None)


def states_by(rules: tuple[tuple[re.Pattern[str], str, str], ...], below: str) -> dict[str, str]:
    """State of each attribute that the lines of one file give to a path below its folder."""
    return {kind: state for r, kind, state in rules if r.match(below)}


def declared(path: str, files: dict[str, str]) -> dict[str, str]:
    """State of each attribute of ``path`` from attribute files (folder -> text): a deeper one overrides a higher one; the highest is the root."""
    marks: dict[str, str] = {}
    parts = path.split("/")
    here = [("/".join(parts[:d]), "/".join(parts[d:])) for d in range(len(parts)) if "/".join(parts[:d]) in files]
    for k, (folder, below) in enumerate(here):
        marks |= states_by(rules_of(files[folder], k == 0), below)
    return marks


# --- content -------------------------------------------------------------------------------------------------------

_HEAD = re.compile(r"\A﻿?(?:\s*(?:(?://|#)[^\n]*(?:\n|\Z)|/\*.*?\*/|<!--.*?-->))+", re.S)
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b(?!\s+(?:method|constructor|catch)\b)|\bauto(?:matically|-)\s*generated\b(?!\s+(?:method|constructor|catch)\b)"
    r"|\b(?:code|file|source|module|class|bindings?|stubs?)\s+(?:is |was |has been )?(?:auto\w*[- ])?generated\s+(?:by|from|with|using)\b|(?:^|[/#*!\s])\s*generated\s+(?:by|from|with|using)\s+(?:the\s+)?\w"
    r"|\bproduced by\b.{0,60}\bdo not (?:edit|modify)|\b(?:manual|any|your)? ?(?:changes|edits|modifications) (?:will|would) be (?:lost|overwritten)",
    re.I | re.M,
)
# starts at the beginning of a run of word or other characters only, so a head of any length is read in one pass
_VENDORED = re.compile(
    r"@(?:license|preserve)\s+[\w.-]+\s+v?\d|(?:\A|(?<=\w)[^\w\n]*\n)\W*!\s*[\w.-]+\s+v?\d+\.\d+|\bbundled (?:copy|version) of\b|\bvendored\b(?: copy)?(?: from| of)\b|\bcopied (?:unchanged|verbatim|from)\b|\bupstream\s*:"
    r"|\breport bugs upstream\b|\bimported from https?://|(?<![\w.-])[\w.-]++ v?\d+\.\d+(?:\.\d+)? - \(c\)|\bthe [\w.-]+ (?:project|authors|contributors), see https?://|\btaken from https?://",
    re.I | re.M,
)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
_NUMBERS = re.compile(r"(?:-?(?:0x[\da-fA-F]+|\d+(?:\.\d+)?)\s*,\s*){8,}(?:-?(?:0x[\da-fA-F]+|\d+(?:\.\d+)?))?")
_LITERAL = re.compile(r"-?\b(?:0x[\da-fA-F]+|\d+(?:\.\d+)?)\b|[\s\[\](){},;:]+")
_COMMENT = re.compile(r"/\*.*?\*/|^\s*(?://|#).*?$", re.S | re.M)
_DEFINES = re.compile(r"\b(?:def|function|func|class\s+\w+\s*\{?\s*\n\s*(?:public|private|protected))\b|=>|\bint\s+\w+\s*\(|\breturn\b")
_NUMBERED = re.compile(r"\b([A-Za-z_]\w*?)_?(\d+)\b(?=\s*(?:\(|=|:))")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_KEYWORDS = frozenset("function return var let const if else for while new this typeof void null true false class export default import from case switch break".split())


def content_class(path: str, text: str | None) -> str:
    """'generated', 'minified', 'vendored', 'data' or '' (nothing proven)."""
    if not text or not text.strip() or path.lower().endswith(".json"):
        return ""
    m = _HEAD.match(text)
    head = m.group(0) if m else ""
    if head:
        if _GENERATED.search(head):
            return "generated"
        if _VENDORED.search(head):
            rest = text[len(head) :]
            return "minified" if _minified(rest) else "vendored"
    code = _COMMENT.sub("", text)
    if not code.strip():
        return ""
    if _minified(code):
        return "minified"
    if _data(code):
        return "data"
    return "generated" if _numbered(code) else ""


def _minified(code: str) -> bool:
    code = _STRING.sub('""', code)
    if len(code) < 200:
        return False
    white = sum(map(code.count, " \t\n\r")) / len(code)
    if white > 0.12:
        return False
    names = [w for w in _IDENT.findall(code) if w not in _KEYWORDS]
    if len(names) < 20 or _NUMBERS.sub("", code).strip().__len__() < 0.5 * len(code):
        return False
    return sum(map(len, names)) / len(names) < 4.5


def _data(code: str) -> bool:
    solid = len(re.sub(r"\s", "", code))
    if solid < 150 or _DEFINES.search(_STRING.sub('""', code)):
        return False
    left = _LITERAL.sub("", _STRING.sub("", code))
    return len(left) < 0.25 * solid


def _numbered(code: str) -> bool:
    """Most lines belong to definitions that count up: x0, x1, x2 ... with one shape."""
    lines = [s for s in code.split("\n") if s.strip()]
    if len(lines) < 6:
        return False
    counted = []
    for s in lines:
        m = _NUMBERED.search(s)
        if m:
            counted.append(int(m.group(2)))
    runs = sum(b == a + 1 for a, b in zip(counted, counted[1:]))
    shapes = {re.sub(r"\d+", "0", _IDENT.sub("i", _STRING.sub("s", s))).strip() for s in lines}
    return runs >= 5 and runs + 1 >= 0.8 * len(counted) and len(shapes) <= max(3, 0.25 * len(lines)) and len(counted) >= 0.3 * len(lines)


_BLOCK = re.compile(r"\n\s*\n")


def blocks(text: str) -> list[str]:
    """Code blocks between blank lines that hold a definition, without white space at line ends."""
    out = []
    for b in _BLOCK.split(text.replace("\r\n", "\n")):
        b = "\n".join(s.rstrip() for s in b.strip("\n").split("\n"))
        if len(b) > 60 and re.search(r"\b(?:def|function|func|int|class)\b[^\n]*\(", b):
            out.append(b)
    return out


# --- operator ------------------------------------------------------------------------------------------------------


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + ".".join(name.split(".")[-2:]) if name.count(".") >= 2 else ""


def _marks(path: str) -> list[str]:
    """Patterns a path falls under: folder names, and its double suffix."""
    out = {f"{d}/" for d in path.split("/")[1:-1]}
    if _suffix(path):
        out.add("*" + _suffix(path))
    return sorted(out)


def classify(sources: DataFrame) -> DataFrame:
    """path, repo, class, marks, blocks (hashes) of each distinct source row, in one pass over the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for f in frames:
            yield pd.DataFrame({
                "path": f["path"],
                "repo": [p.split("/", 1)[0] for p in f["path"]],
                "proof": [content_class(p, t) for p, t in zip(f["path"], f["content"])],
                "marks": [_marks(p) for p in f["path"]],
                "blocks": [[xxhash.xxh3_64_intdigest(b) - 2**63 for b in blocks(t or "")] for t in f["content"]],
                "attributes": [t if p.endswith(".gitattributes") else None for p, t in zip(f["path"], f["content"])],
            })

    rows = sources.filter("path is not null").select("path", "content")
    return rows.mapInPandas(run, "path string, repo string, proof string, marks array<string>, blocks array<long>, attributes string")


def _attributes(files: DataFrame) -> DataFrame:
    """path, generated, vendored (states; null if no file speaks of it): each path meets the attribute files of its own folders."""
    texts = files.filter("attributes is not null").select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.col("attributes"))
    texts = texts.groupBy("folder").agg(F.max("attributes").alias("attributes"))
    # a root file is one that no other stands above
    above = texts.select("folder", F.explode(_folders(F.col("folder"))).alias("over")).join(texts.select(F.col("folder").alias("over")), "over", "left_semi").select("folder").distinct().withColumn("inner", F.lit(True))
    texts = texts.join(above, "folder", "left").select("folder", "attributes", F.col("inner").isNull().alias("root"))
    paths = files.filter("attributes is null").select("path").distinct()
    met = paths.select("path", F.explode(_folders(F.col("path"))).alias("folder")).join(small(texts, ATTRIBUTE_FILES), "folder")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [states_by(rules_of(t, bool(r)), p[len(d) + 1 :] if d else p) for p, d, t, r in zip(f["path"], f["folder"], f["attributes"], f["root"])]
            yield pd.DataFrame({"path": f["path"], "deep": [len(d) for d in f["folder"]], "generated": [x.get("generated") for x in found], "vendored": [x.get("vendored") for x in found]})

    said = met.mapInPandas(run, "path string, deep int, generated string, vendored string")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("deep"))).alias(c)
    return said.groupBy("path").agg(last("generated"), last("vendored")).filter("generated is not null or vendored is not null")


def _folders(path: Column) -> Column:
    """All folders a path lies in, the root folder '' too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def judged(sources: DataFrame) -> DataFrame:
    """path, reason of files nobody wrote by hand; reason: declared, generated, minified, vendored, data or mined."""
    files = cut(classify(sources).filter(~F.lower("path").endswith(".json")))
    code = files.filter("attributes is null")
    # blocks that stand in several repositories; a block counts once a repository, combined where it is read
    block = code.select("path", "repo", F.explode(F.array_distinct("blocks")).alias("block"))
    known = code.filter("proof = 'vendored'").select(F.explode("blocks").alias("block")).distinct().withColumn("from_header", F.lit(True))
    shared = block.groupBy("block").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("block", F.lit(True).alias("shared"))
    per_file = (
        block.join(shared, "block", "left").join(known, "block", "left").groupBy("path")
        .agg(F.avg(F.coalesce("shared", F.lit(False)).cast("int")).alias("share"), F.avg(F.coalesce("from_header", F.lit(False)).cast("int")).alias("known"))
        .filter("share >= 0.5 or known >= 0.5").select("path", F.lit("vendored").alias("copied"))
    )
    proven = code.join(per_file, "path", "left").select("path", "repo", "marks", F.when(F.col("proof") != "", F.col("proof")).otherwise(F.col("copied")).alias("proof"))
    proven = proven.groupBy("path", "repo", "marks").agg(F.max("proof").alias("proof")).join(cut(_attributes(files)), "path", "left")
    # what is declared stands, what is cleared is no proof; each attribute clears its own kind only
    of_kind = F.when(F.col("proof") == "vendored", F.col("vendored")).otherwise(F.col("generated"))
    declared_ = (F.col("generated").eqNullSafe(SET)) | (F.col("vendored").eqNullSafe(SET))
    reason = F.when(declared_, "declared").when(of_kind.eqNullSafe(UNSET), None).otherwise(F.col("proof"))
    proven = cut(proven.withColumn("reason", reason))
    stats = proven.select("repo", "reason", F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("n"), F.count("reason").alias("k"), F.min("repo").alias("a"), F.max("repo").alias("b"))
    mined = stats.filter((F.col("n") >= MIN_FILES) & (F.col("a") != F.col("b")) & (F.col("k") / F.col("n") >= MIN_SHARE)).select("mark")
    silent = F.coalesce("generated", F.lit(UNSPECIFIED)).eqNullSafe(UNSPECIFIED) & F.coalesce("vendored", F.lit(UNSPECIFIED)).eqNullSafe(UNSPECIFIED)
    open_ = proven.filter(F.col("reason").isNull() & silent).select("path", F.explode("marks").alias("mark")).join(mined, "mark", "left_semi").select("path", F.lit("mined").alias("reason")).distinct()
    return proven.filter("reason is not null").select("path", "reason").unionByName(open_)
