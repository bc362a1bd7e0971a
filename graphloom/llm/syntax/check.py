"""Minimum-cost syntax repair of a file: its cost, where it edits, and what that says about the file."""

from __future__ import annotations

from dataclasses import dataclass

from graphloom.llm.syntax import lexers
from graphloom.llm.syntax.chart import Grammar, Group
from graphloom.llm.syntax.grammars import grammar

# Spellings of languages and their file extensions.
LANGUAGES = {
    "python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "ecmascript": "javascript", "node": "javascript",
    "typescript": "typescript", "ts": "typescript", "java": "java", "go": "go", "golang": "go", "json": "json",
}
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "json": "json"}


@dataclass(frozen=True)
class Repair:
    cost: int  # edits
    offset: int | None  # of the first edit
    cause: str  # '', truncation, conflict, mismatch, edit
    exact: bool = True  # else it costs at least so much


def language_of(path: str, declared: str | None) -> str | None:
    """The declared language in any spelling, else the one of the extension."""
    known = LANGUAGES.get((declared or "").strip().lower())
    return known or EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")


def _offset(tokens: tuple, offsets: tuple, path: tuple, size: int) -> int:
    """Offset of the token a path leads to."""
    at = size
    for k in path:
        if k >= len(tokens):
            return at
        at = offsets[k]
        if tokens[k].__class__ is Group:
            tokens, offsets = tokens[k].content, tokens[k].offsets
        else:
            break
    return at


def _derives(text: str, language: str) -> tuple[Grammar, lexers.Nested, bool, int]:
    """The grammar, the nested tokens, whether they derive from it, and the edits of what is no token of it."""
    got = lexers.read(text, language)
    g = grammar(language)
    g.begin_file(got.tokens)
    bare = language == "go" and got.tokens[:1] != ("package",)  # the grammar has no place for what must come first
    return g, got, g.accepts("program", got.tokens), got.edits + bare


def repair(text: str, language: str) -> Repair:
    """Cost 0 exactly if the text derives from the language's grammar. Edits are those of brackets without partner, and those of tokens."""
    g, got, sound, before = _derives(text, language)
    if sound and not before:
        return Repair(0, None, "")
    bare = before > got.edits
    # bracket edits come first in the text if the first of them does
    first = [x for x in (got.first_edit, 0 if bare else None) if x is not None]
    cost, exact, mismatch = 0, True, False
    if not sound:
        full = lexers.read(text, language, whole=True)  # what goes counts with all its tokens
        cost, path, exact = g.cheapest("program", full.tokens)
        total = len(g.elements(got.tokens)) if g.lists else 1
        mismatch = (cost + before > 1 or not got.tokens) and not got.markers and _faulty(g, got.tokens) >= 0.5 * total and not _layout_only(g, language, got.tokens) and _other(text, language)
        first.append(_offset(full.tokens, full.offsets, path, len(text)))
    if got.markers:
        cause = "conflict"
    elif mismatch or (not got.tokens and _other(text, language)):
        cause = "mismatch"
    elif got.edits == got.at_end and all("\n" not in text[x:].rstrip() for x in got.faults) and _ends_early(language, got.tokens, got.at_end):
        cause = "truncation"
    else:
        cause = "edit"
    return Repair(max(1, cost + before), min(first, default=None), cause, exact)


def _layout_only(g: Grammar, language: str, tokens: tuple) -> bool:
    """Whether it is Python but for its indentation."""
    if language != "python":
        return False
    flat, todo = [], list(tokens[::-1])
    while todo:
        t = todo.pop()
        if t.__class__ is Group and t.open == "{" and "NEWLINE" in t.content:
            todo.extend(t.content[::-1])
        elif t != "FAULT":
            flat.append(t)
    return g.accepts("program", tuple(flat))


def _faulty(g: Grammar, tokens: tuple) -> int:
    """Elements of the program that do not derive."""
    element = g.lists.get("program")
    parts = g.elements(tokens) if element else [tokens]
    return max(1, sum(g.farthest(element or "program", p, k + 1 == len(parts)) >= 0 for k, p in enumerate(parts)))


def _ends_early(language: str, seq: tuple, left_open: int) -> bool:
    """Whether the text makes sense as far as it goes: nothing is wrong before its end, down the ``left_open`` brackets it leaves open."""
    g = grammar(language)
    if not left_open and g.accepts("program", seq):
        return False
    by_open: dict[str, set[str]] = {}
    for s in g.symbol:
        if len(s) > 3 and s[2] == "<" and s[1] in "([{`":
            by_open.setdefault(s[1], set()).add(s[3:-1])
    starts = {"program"}
    for _ in range(left_open + 1):
        far = [(g._earley(s, seq), s) for s in sorted(starts)]
        if any(f < 0 or f >= len(seq) for f, _ in far):
            return True
        at = max(f for f, _ in far)
        rest = [x for x in seq[at + 1 :] if x not in ("FAULT", "NEWLINE", ";")]
        if seq[at] == "FAULT" and not rest:
            return True
        if rest or not seq[at].__class__ is Group:
            return False
        starts, seq = by_open.get(seq[at].open, set()), seq[at].content
        if not starts or not seq:
            return bool(starts)
    return False


def _other(text: str, language: str) -> bool:
    """Whether the text derives from another language's grammar, or is markup. What begins like JSON is meant as JSON."""
    if text.lstrip()[:1] == "<":
        return True
    if language == "json" and text.lstrip()[:1] in ("{", "[", '"', "/"):
        return False
    for other in ("json", "python", "java", "go", "typescript"):
        if other != language:
            got = lexers.read(text, other)
            if not got.edits and not got.markers and not got.faults and got.tokens and grammar(other).accepts("program", got.tokens):
                return True
    return False


def faulty(text: str | None, language: str) -> bool:
    """Whether repairing the file costs anything, without the search for how much."""
    text = text or ""
    if not text.strip():
        return language in ("go", "json")
    _, _, sound, before = _derives(text, language)
    return not sound or before > 0


def check(text: str | None, language: str) -> Repair:
    """Repair of one file. Null is read as empty, and an empty file is valid but in JSON, which needs a value, and Go, which needs a package."""
    text = text or ""
    if not text.strip():
        return Repair(1, 0, "truncation") if language in ("go", "json") else Repair(0, None, "")
    return repair(text, language)
