"""Functions over code text, all within the engine's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords kept by the token normaliser.
KEPT_KEYWORDS = tuple("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False".split())
TOKEN = r"""("[^"]*"|'[^']*'|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|[a-zA-Z_]\w*|[^\s\w])"""

# Words and signs that the complexity measures count.
WORD_OR_SIGN = r"([A-Za-z0-9_]+|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|->|=>|::|//|/\*|\*/|\*\*|[^\sA-Za-z0-9_])"
DECISIONS = tuple("if for while loop elsif elif when unless catch except rescue finally assert".split())
DECISIONS_OF = {"go": ("fallthrough", "range"), "rust": ("match",), "php": ("elseif", "foreach"), "ruby": ("ensure",)}
LOOPS = tuple("for while loop repeat foreach".split())
LOOPS_OF = {"ruby": ("each", "times", "upto", "downto"), "go": ("range",)}
CASES_OF = {**{language: ("case",) for language in "go rust java kotlin csharp typescript javascript php".split()}, "python": ("elif",), "ruby": ("when", "elsif")}
OPERATORS = tuple("+ - * / % = == != < > <= >= && || ! & | ^ ~ += -= *= /= -> => :: . , ; : ? ( ) [ ] { } new return throw yield await async".split())
OPERATORS_OF = {
    "python": tuple("** // is in not and or lambda del raise with from import def class pass".split()),
    "rust": tuple("fn let mut pub impl trait enum struct mod use crate self super where dyn ref move unsafe extern".split()),
    "go": tuple("func var type package import defer go chan select interface struct map".split()),
    "kotlin": tuple("fun val var class object interface data sealed when in is as by lateinit lazy".split()),
    "java": tuple("class interface enum extends implements abstract final static public private protected void this super package import".split()),
    "php": tuple("function class interface trait namespace use public private protected static echo print require include clone instanceof".split()),
    "ruby": tuple("def class module end self super yield begin rescue ensure require include extend attr_accessor attr_reader attr_writer".split()),
    **{language: tuple("function class interface type enum extends implements import export const let var from as typeof instanceof void".split()) for language in ("typescript", "javascript")},
}
NO_OPERANDS = tuple("true false null none undefined nil this self super None True False NaN".split())


def ast_tokens(body: Column) -> Column:
    """Tokens of a body without line comments of ``#``: names become I, strings S, numbers N; keywords and signs stay."""
    raw = F.regexp_extract_all(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?m)#.*$", ""), F.lit(TOKEN), 1)

    def one(t: Column) -> Column:
        return F.when(t.rlike("^[\"']"), "S").when(t.rlike(r"^\d"), "N").when(t.isin(*KEPT_KEYWORDS), t).when(t.rlike(r"^[A-Za-z_]"), "I").otherwise(t)

    return F.transform(raw, one)


def words_and_signs(body: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(WORD_OR_SIGN), 1)


def among(t: Column, words: tuple[str, ...], of: dict[str, tuple[str, ...]], language: Column) -> Column:
    """Whether a token is one of ``words`` or of its language's own."""
    return reduce(lambda a, kv: a | (t.isin(*kv[1]) & (language == kv[0])), of.items(), t.isin(*words) if words else F.lit(False))


def among_sql(t: str, words: tuple[str, ...], of: dict[str, tuple[str, ...]], language: str = "lang") -> str:
    """The same as SQL."""
    listed = lambda ws: ", ".join(f"'{w}'" for w in ws)
    own = [f"{language} = '{k}' AND {t} IN ({listed(ws)})" for k, ws in of.items()]
    return "(" + " OR ".join(([f"{t} IN ({listed(words)})"] if words else []) + own) + ")"


def cyclomatic(tokens: Column, language: Column) -> Column:
    """Decisions, logical operators, ``?`` and cases, plus one; what is both a decision and a case of its language counts as both."""
    decisions = F.size(F.filter(tokens, lambda t: among(t, (*DECISIONS, "&&", "||", "?"), DECISIONS_OF, language)))
    return decisions + F.size(F.filter(tokens, lambda t: among(t, (), CASES_OF, language))) + 1


def cognitive(tokens: Column, language: Column) -> Column:
    """Decisions and loops weigh one and the depth they stand in; logical operators one; break and continue the depth."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth"))

    def step(acc: Column, t: Column) -> Column:
        up, down = t.isin("{", "begin", "do"), t.isin("}", "end", "endfunction", "endif")
        depth = F.when(up, acc["depth"] + 1).when(down, F.greatest(acc["depth"] - 1, F.lit(0))).when((t == ":") & (language == "python"), acc["depth"] + 1).otherwise(acc["depth"])
        decides = among(t, DECISIONS, DECISIONS_OF, language)
        loops = among(t, LOOPS, LOOPS_OF, language)
        more = (
            F.when(decides, 1 + depth).otherwise(0) + F.when(loops, 1 + depth).otherwise(0) + F.when(t.isin("&&", "||"), 1).otherwise(0)
            + F.when(t.isin("break", "continue"), depth).otherwise(0)
        )
        return F.struct((acc["score"] + F.when(up | down, 0).otherwise(more)).cast("int").alias("score"), depth.cast("int").alias("depth"))

    return F.aggregate(tokens, start, step, lambda a: a["score"])


def halstead(tokens: Column, language: Column) -> tuple[Column, Column]:
    """(volume, difficulty) from distinct and all operators, those of the language too, and operands."""
    ops = F.filter(tokens, lambda t: among(t, OPERATORS, OPERATORS_OF, language))
    names = F.filter(tokens, lambda t: ~among(t, OPERATORS, OPERATORS_OF, language) & ~t.isin(*NO_OPERANDS) & t.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"))
    n1, n2 = F.size(F.array_distinct(ops)), F.size(F.array_distinct(names))
    all_ = F.size(ops) + F.size(names)
    volume = F.when(n1 + n2 > 0, all_ * F.log2((n1 + n2).cast("double"))).otherwise(0.0)
    difficulty = F.when((n1 > 0) & (n2 > 0), n1 / 2 * (F.size(names) / n2)).otherwise(0.0)
    return volume, difficulty


def risk_level(cyc: Column, cog: Column) -> Column:
    a = F.when(cyc <= 5, 0).when(cyc <= 10, 1).when(cyc <= 20, 2).otherwise(3)
    b = F.when(cog <= 5, 0).when(cog <= 15, 1).when(cog <= 30, 2).otherwise(3)
    return F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.greatest(a, b) + 1)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def matching_share(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures of one length; of different lengths null."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"]))
    return F.when(F.size(a) == F.size(b), same / F.size(a))
