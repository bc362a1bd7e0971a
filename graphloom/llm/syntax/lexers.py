"""Token kinds of each language, nested by brackets.

A lexer gives (kind, offset) pairs; what no rule of the language covers (stray characters, open strings, merge markers at the
start of a line) becomes a kind that no grammar knows. ``nest`` folds brackets into groups and counts the edits that
takes: a bracket without partner is one insertion or deletion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graphloom.llm.syntax.chart import Group

CLOSE = {"(": ")", "[": "]", "{": "}", "`": "´"}  # the last pair: a substitution within a string
OPEN = {v: k for k, v in CLOSE.items()}
_MARKER = r"(?P<marker>^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?\r?$|^={7}\r?$)"


@dataclass
class Nested:
    tokens: tuple
    offsets: tuple = ()  # of the tokens
    edits: int = 0  # brackets inserted or deleted
    first_edit: int | None = None  # offset
    at_end: int = 0  # of the edits, those that insert at the end of the text
    markers: int = 0
    faults: list[int] = field(default_factory=list)  # offsets of characters or strings no rule covers


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


# Reserved words and words with a meaning in places, of each language.
JS_KEYWORDS = _words("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield enum await null true false")
JS_CONTEXT = _words("as async from get set of let static type interface namespace module declare abstract accessor readonly public private protected implements keyof is asserts infer unique override satisfies global")
JAVA_KEYWORDS = _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false")
JAVA_CONTEXT = _words("record sealed permits non yield var when module")
GO_KEYWORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
PY_KEYWORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
PY_CONTEXT = _words("match case type _")

_JS = re.compile(
    _MARKER
    + r"""|(?P<ws>[^\S\n]+|﻿)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/|\A\#![^\n]*)|(?P<str>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')|(?P<tpl>`)"""
    r"""|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$]))|(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)"""
    r"""|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\*\*=?|<<=?|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:,;.@()\[\]{}])|(?P<bad>[\s\S])""",
    re.M,
)
_JAVA = re.compile(
    _MARKER
    + r"""|(?P<ws>[^\S\n]+|﻿)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>\"\"\"[\s\S]*?(?<!\\)\"\"\"|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[^\n]))')"""
    r"""|(?P<num>0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?(?![\w$]))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<op>->|::|\.\.\.|==|!=|<=|>=|&&|\|\||<<=?|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:,;.@()\[\]{}])|(?P<bad>[\s\S])""",
    re.M,
)
_GO = re.compile(
    _MARKER
    + r"""|(?P<ws>[^\S\n]+|﻿)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[^\n]))')"""
    r"""|(?P<num>0[xX][\da-fA-F_]+i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w))|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<op>\.\.\.|:=|<-|&\^=?|<<=?|>>=?|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=:,;.()\[\]{}])|(?P<bad>[\s\S])""",
    re.M,
)
_JSON = re.compile(_MARKER + r"""|(?P<ws>[ \t\r]+|\A﻿)|(?P<nl>\n)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<name>[A-Za-z]+)|(?P<op>[,:\[\]{}])|(?P<bad>[\s\S])""", re.M)
_PY = re.compile(
    _MARKER
    + r"""|(?P<ws>[ \t\f]+|\\\r?\n|\A﻿)|(?P<nl>\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<str>(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'))"""
    r"""|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:0[0_]*(?!\d)|[1-9][\d_]*)(?![.\deEjJ\w])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?(?![\w]))|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<op>->|:=|\.\.\.|\*\*=?|//=?|<<=?|>>=?|==|!=|<=|>=|[-+*/%&|^@]=|[-+*/%&|^~<>=:,;.@()\[\]{}])|(?P<bad>[\s\S])""",
    re.M,
)

# Operators that the grammars do not tell apart.
_SAME = {
    "js": {**{o: "BIN" for o in "== != === !== <= >= && || ?? % ** << ^ instanceof".split()}, **{o: "ASSIGN" for o in "+= -= *= /= %= &= |= ^= **= <<= &&= ||= ??=".split()}},
    "java": {**{o: "BIN" for o in "== != <= >= && || % << ^ /".split()}, **{o: "ASSIGN" for o in "+= -= *= /= %= &= |= ^= <<=".split()}},
    "go": {**{o: "BIN" for o in "== != <= >= && || % << >> / < > &^".split()}, **{o: "ASSIGN" for o in "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()}},
    "python": {**{o: "BIN" for o in "== != <= >= << >> // % & ^ < >".split()}, **{o: "ASSIGN" for o in "+= -= *= /= %= &= |= ^= **= //= <<= >>= @=".split()}},
    "json": {},
}
# blanks before a token are read with it
_PATTERN = {base: re.compile(rf"[ \t]*(?:{p.pattern})", p.flags) for base, p in {"js": _JS, "java": _JAVA, "go": _GO, "python": _PY, "json": _JSON}.items()}
_KEYWORDS = {"js": JS_KEYWORDS | JS_CONTEXT, "java": JAVA_KEYWORDS | JAVA_CONTEXT, "go": GO_KEYWORDS, "python": PY_KEYWORDS | PY_CONTEXT, "json": _words("true false null")}
_JS_VALUE_END = frozenset(["NAME", "NUM", "STR", "TPL", "RE", ")", "]", "}", "´", "this", "super", "null", "true", "false", "++", "--"]) | JS_CONTEXT
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_JS_STARTS = JS_KEYWORDS - {"in", "instanceof", "else", "catch", "finally", "extends"}


def tokens(text: str, base: str) -> tuple[list[tuple[str, int]], int, list[int]]:
    """(kind, offset) pairs with line ends as 'NL', the number of merge markers, the offsets of faults."""
    out: list[tuple[str, int]] = []
    faults: list[int] = []
    markers, _ = _lex(text, base, 0, out, faults, False)
    return out, markers, faults


def _lex(text: str, base: str, at: int, out: list[tuple[str, int]], faults: list[int], within: bool) -> tuple[int, int]:
    """Adds to ``out`` and ``faults``; the number of merge markers, and where it ends. ``within`` a substitution that is at the bracket, or
    in Python at the mark, which ends it; -1 if there is none."""
    markers = depth = 0
    same, keywords, pattern = _SAME[base], _KEYWORDS[base], _PATTERN[base]
    n, match = len(text), pattern.match
    last, run = "", -1
    while at < n:
        m = match(text, at)
        kind = m.lastgroup
        at, end = m.span(kind)
        if within and kind in ("op", "bad"):
            w = m.group(kind)
            if not depth and (w == "}" or (base == "python" and (w in (":", ":=", "!") or (w == "=" and _SHOWN.match(text, end))))):
                return markers, at
            depth += (w in CLOSE) - (w in OPEN)
        if kind == "ws" or kind == "comment":
            if kind == "comment" and base == "go" and "\n" in m.group(kind):
                out.append(("NL", at))
        elif kind == "nl":
            if out and out[-1][0] != "NL":
                out.append(("NL", at))
        else:
            inner: list[tuple[str, int]] = []
            if kind == "name":
                w = m.group(kind)
                k = same.get(w) or (w if w in keywords else "NAME")
                if last in (".", "?.") and base != "python":
                    k = "NAME"
            elif kind == "num":
                k = "NUM"
            elif kind == "str":
                k = "STR"
                f = _FSTRING.match(text, at) if base == "python" else None
                if f:
                    bad: list[int] = []
                    marks, stop = _fields(text, f.end(), f.group(2), "r" in f.group(1).lower(), inner, bad)
                    if stop < 0:
                        k, inner = "FAULT", []
                        faults.append(at)
                    else:
                        markers, end = markers + marks, stop
                        faults.extend(bad)
            elif kind == "op":
                w = m.group(kind)
                k = same.get(w, w)
                if base == "js" and w[0] == "/" and last not in _JS_VALUE_END:
                    r = _REGEX.match(text, at)
                    if r:
                        k, end = "RE", r.end()
            elif kind == "tpl":
                k = "TPL"
                bad = []
                marks, end = _template(text, at, inner, bad)
                if end < 0:
                    k, end, inner = "FAULT", at + 1, []
                    faults.append(at)
                else:
                    markers += marks
                    faults.extend(bad)
            elif kind == "marker":
                markers += 1
                k = "MARKER"
            else:
                k = "FAULT"
                if out and out[-1][0] == "FAULT" and at == run:  # a run of such characters is one fault
                    at = run = end
                    continue
                faults.append(at)
                run = end
            out.append((k, at))
            out.extend(inner)
            last = k
        at = end
    return markers, -1 if within else at


def _template(text: str, at: int, out: list[tuple[str, int]], faults: list[int]) -> tuple[int, int]:
    """Merge markers in, and end of, a template literal; -1 if it is open. Each substitution becomes a group of its own."""
    i, n, markers = at + 1, len(text), 0
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return markers, i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            out.append(("`", i))
            marks, i = _lex(text, "js", i + 2, out, faults, True)
            if i < 0:
                return 0, -1
            out.append(("´", i))
            markers, i = markers + marks, i + 1
        else:
            i += 1
    return 0, -1


#: What follows the sign of a substitution that also shows its text.
_SHOWN = re.compile(r"\s*(?:[}:]|!(?!=))")
_CONVERSION = re.compile(r"!\s*[rsa]\s*(?=[:}])")
_FSTRING = re.compile(r"([fFtT][rR]?|[rR][fFtT])(\"{3}|'{3}|\"|')")
_NAMED = re.compile(r"N\{[^{}\n]*\}")


def _fields(text: str, i: int, quote: str, raw: bool, out: list[tuple[str, int]], faults: list[int], spec: bool = False) -> tuple[int, int]:
    """Merge markers in, and end of, a formatted string read from ``i``, or of a format (``spec``), which a bracket ends; -1 if it is open.
    Each replacement field becomes a group of its own, the fields of its format follow it."""
    n, markers = len(text), 0
    while i < n:
        c = text[i]
        if text.startswith(quote, i):
            return (0, -1) if spec else (markers, i + len(quote))
        if c == "\n" and len(quote) == 1:
            return 0, -1
        if c == "\\":
            named = None if raw else _NAMED.match(text, i + 1)
            i = named.end() if named else i + 1 if text[i + 1 : i + 2] in ("{", "}") else i + 2
        elif c == "}":
            if spec:
                return markers, i
            if text[i + 1 : i + 2] != "}":
                faults.append(i)
                out.append(("FAULT", i))
                i -= 1
            i += 2
        elif c == "{" and text[i + 1 : i + 2] == "{" and not spec:
            i += 2
        elif c == "{":
            out.append(("`", i))
            marks, i = _lex(text, "python", i + 1, out, faults, True)
            if i < 0:
                return 0, -1
            out.append(("´", i))
            markers += marks
            if text[i] == "=":
                i = _SHOWN.match(text, i + 1).end() - 1
            if text[i] == "!":
                m = _CONVERSION.match(text, i)
                if not m:
                    return 0, -1
                i = m.end()
            if text[i] == ":":
                marks, i = _fields(text, i + 1, quote, raw, out, faults, True)
                if i < 0:
                    return 0, -1
                markers += marks
            i += 1
        else:
            i += 1
    return 0, -1


class _Level:
    """Tokens of an open bracket with their offsets."""

    __slots__ = ("open", "at", "tokens", "offsets", "whole")

    def __init__(self, open_: str, at: int, whole: bool = False) -> None:
        self.open, self.at, self.tokens, self.offsets, self.whole = open_, at, [], [], whole

    def add(self, token: object, at: int) -> None:
        self.tokens.append(token)
        self.offsets.append(at)

    def close(self) -> tuple[tuple, tuple]:
        tokens, offsets = (self.tokens, self.offsets) if self.whole else _short(self.tokens, self.offsets)
        return tuple(tokens), tuple(offsets)

    def group(self) -> Group:
        return Group(self.open, (c := self.close())[0], self.at, c[1])


def nest(flat: list[tuple[str, int]], size: int, whole: bool = False) -> tuple[tuple, tuple, int, int | None, int]:
    """Groups of the flat tokens and their offsets; edits, offset of the first, and how many insert at the end."""
    stack: list[_Level] = []
    now = _Level("", 0, whole)
    edits, first, at_end = 0, None, 0
    for k, at in flat:
        if k in CLOSE:
            stack.append(now)
            now = _Level(k, at, whole)
        elif k in OPEN:
            if now.open == OPEN[k] or (stack and stack[-1].open == OPEN[k]):
                while True:
                    fits = now.open == OPEN[k]
                    if not fits:  # it was never closed
                        edits, first = edits + 1, at if first is None else first
                    outer = stack.pop()
                    outer.add(now.group(), now.at)
                    now = outer
                    if fits:
                        break
            else:
                edits, first = edits + 1, at if first is None else first
        else:
            now.add(k, at)
    while stack:
        edits, at_end, first = edits + 1, at_end + 1, size if first is None else first
        outer = stack.pop()
        outer.add(now.group(), now.at)
        now = outer
    return (*now.close(), edits, first, at_end)


def _short(seq: list, offsets: list) -> tuple[list, list]:
    """Long runs of literals parted by commas, cut to a few: the grammars take any number. Only whether a text derives may be asked of it."""
    if len(seq) < 12:
        return seq, offsets
    out: list = []
    at: list = []
    for t, o in zip(seq, offsets):
        if t == "," and len(out) >= 7 and out[-1] in ("NUM", "STR") and out[-2] == "," and out[-7:] == [out[-1], ","] * 3 + [out[-1]]:
            del out[-2:], at[-2:]
        elif t.__class__ is Group and len(out) >= 7 and out[-1] == "," and out[-6:] == [t, ","] * 3:
            del out[-1], at[-1]
            continue
        out.append(t)
        at.append(o)
    return out, at


def read(text: str, language: str, whole: bool = False) -> Nested:
    """Nested tokens of a text in the base language (js for TypeScript too), ``whole`` or with long runs cut."""
    base = "js" if language in ("javascript", "typescript") else language
    flat, markers, faults = tokens(text, base)
    if base == "python":
        return _layout(text, flat, markers, faults, whole)
    if base == "js":
        flat = _js_ends(flat)
    elif base == "go":
        flat = _go_ends(flat)
    else:
        flat = [t for t in flat if t[0] != "NL"]
    seq, offsets, edits, first, at_end = nest(flat, len(text), whole)
    return Nested(seq, offsets, edits, first, at_end, markers, faults)


_JS_ENDERS = _JS_VALUE_END | {"return", "break", "continue", "debugger"}


def _js_ends(flat: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Statement ends the language inserts at line breaks, where a value meets something that begins a statement."""
    out: list[tuple[str, int]] = []
    depth: list[str] = []
    for i, (k, at) in enumerate(flat):
        if k == "NL":
            if out and (not depth or depth[-1] == "{") and i + 1 < len(flat) and out[-1][0] in _JS_ENDERS and out[-1][0] != ";":
                nxt = flat[i + 1][0]
                if nxt in ("NAME", "NUM", "STR", "++", "--", "!", "~", "@") or nxt in _JS_STARTS or nxt in JS_CONTEXT:
                    out.append((";", at))
            continue
        if k in CLOSE:
            depth.append(k)
        elif k in OPEN and depth:
            depth.pop()
        out.append((k, at))
    return out


_GO_ENDERS = frozenset(["NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _go_ends(flat: list[tuple[str, int]]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for k, at in [*flat, ("NL", flat[-1][1] if flat else 0)]:
        if k == "NL":
            if out and out[-1][0] in _GO_ENDERS:
                out.append((";", at))
        else:
            out.append((k, at))
    return out


def _layout(text: str, flat: list[tuple[str, int]], markers: int, faults: list[int], whole: bool) -> Nested:
    """Python: logical lines end with NEWLINE, indented lines form '{' groups; an indentation that fits none is a fault."""
    lines: list[tuple[int, list[tuple[str, int]]]] = []  # (column, tokens) of logical lines
    now: list[tuple[str, int]] = []
    depth = 0
    for k, at in flat:
        if k == "NL":
            if depth == 0 and now:
                lines.append((0, now))
                now = []
            continue
        if k in CLOSE:
            depth += 1
        elif k in OPEN:
            depth = max(0, depth - 1)
        now.append((k, at))
    if now:
        lines.append((0, now))
    edits, first, at_end, faulty = 0, None, 0, list(faults)
    stack: list[tuple[int, _Level]] = [(0, _Level("", 0))]
    for n, (_, line) in enumerate(lines):
        at = line[0][1]
        start = text.rfind("\n", 0, at) + 1
        pad = text[start:at]
        if pad.strip(" \t\f﻿"):
            pad = pad[: len(pad) - len(pad.lstrip(" \t\f"))]
        column = len(pad.replace("﻿", "").expandtabs(8))
        seq, offsets, e, f, x = nest(line, len(text), whole)
        edits, at_end = edits + e, at_end + (x if n == len(lines) - 1 else 0)
        first = f if first is None and f is not None else first
        if column > stack[-1][0]:
            stack.append((column, _Level("{", at)))
        while column < stack[-1][0]:
            _, block = stack.pop()
            stack[-1][1].add(Group("{", tuple(block.tokens), block.at, tuple(block.offsets)), block.at)
            if column > stack[-1][0]:
                faulty.append(at)
                stack[-1][1].add("FAULT", at)
                break
        for t, o in zip(seq, offsets):
            stack[-1][1].add(t, o)
        stack[-1][1].add("NEWLINE", lines[n + 1][1][0][1] if n + 1 < len(lines) else len(text))
    while len(stack) > 1:
        _, block = stack.pop()
        stack[-1][1].add(Group("{", tuple(block.tokens), block.at, tuple(block.offsets)), block.at)
    root = stack[0][1]
    return Nested(tuple(root.tokens), tuple(root.offsets), edits, first, at_end, markers, faulty)
