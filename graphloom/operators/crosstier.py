"""Links between tiers: HTTP calls to routes in three steps, and foreign functions by symbol.

A null or missing method, url or symbol matches nothing; the root url matches the root; repeated rows give repeated pairs only
where their ids differ; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut, spread

#: Least similarity of the fuzzy step, exclusive.
FUZZY = 0.7

# How frameworks write a parameter of a path.
_PARAMS = {
    "flask": [(r"<(?:(\w+):)?(\w+)>", "{$2}"), (r"\*(\w+)", "{$1}")],
    "express": [(r":(\w+)", "{$1}"), (r"\*(\w+)", "{$1}")],
    "spring": [(r"\{(\w+):[^}]*\}", "{$1}")],
    "django": [(r"^\^|\$$", ""), (r"\(\?P<(\w+)>[^)]*\)", "{$1}"), (r"<(?:(\w+):)?(\w+)>", "{$2}")],
    "aspnet": [(r"\{(\w+):[^}]*\}", "{$1}")],
    "fastapi": [],
}
_SAME = {"gin": "express", "echo": "express", "rails": "express", "spring_boot": "spring", "django_re_path": "django", "asp_net": "aspnet", "asp.net": "aspnet", "laravel": "fastapi"}
_UNKNOWN = [(r"\(\?P<(\w+)>[^)]*\)", "{$1}"), (r"<(?:(\w+):)?(\w+)>", "{$2}"), (r"\{(\w+):[^}]*\}", "{$1}"), (r"\*(\w+)", "{$1}"), (r":(\w+)", "{$1}")]


def normalize_url(url: Column, framework: Column) -> Column:
    """A path with its parameters as {name}, without host, query and trailing slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]*", ""), r"\?(?!P<).*$", "")
    path = F.when(path == "", "/").otherwise(path)

    def apply(rules: list[tuple[str, str]]) -> Column:
        c = path
        for a, b in rules:
            c = F.regexp_replace(c, a, b)
        return c

    low = F.lower(framework)
    out = None
    for name in [*_PARAMS, *_SAME]:
        v = apply(_PARAMS[_SAME.get(name, name)])
        out = F.when(low == name, v) if out is None else out.when(low == name, v)
    out = out.otherwise(apply(_UNKNOWN))
    return F.when((F.length(out) > 1) & out.endswith("/"), F.regexp_replace(out, "/$", "")).otherwise(out)


def segments(url: Column) -> Column:
    return F.filter(F.split(url, "/"), lambda s: s != "")


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def match_exact(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call_id, route_id, match, confidence of equal method and url. calls: call_id, method, url; routes: route_id, method, url."""
    return calls.join(routes, ["method", "url"]).select("call_id", "route_id", F.lit("exact").alias("match"), F.lit(1.0).alias("confidence"))


def match_template(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Segment by segment, a {parameter} of the route fits any segment. Joined on method, number of segments and the first literal one,
    so a call meets only routes that begin alike; routes that begin with a parameter meet on method and number."""
    c = calls.select("call_id", "method", segments(F.col("url")).alias("cs")).withColumn("k", F.size("cs")).withColumn("lead", F.get("cs", F.lit(0)))
    r = routes.select("route_id", "method", segments(F.col("url")).alias("rs")).withColumn("k", F.size("rs")).withColumn("lead", F.get("rs", F.lit(0)))
    param = F.col("lead").rlike(r"^\{.*\}$")
    fits = F.forall(F.zip_with("cs", "rs", lambda a, b: b.rlike(r"^\{.*\}$") | (a == b)), lambda x: x)
    literal = c.join(r.filter(~F.coalesce(param, F.lit(False))), ["method", "k", "lead"]).filter(fits).select("call_id", "route_id")
    open_ = c.join(r.filter(param).drop("lead"), ["method", "k"]).filter(fits).select("call_id", "route_id")
    root = c.filter("k = 0").join(r.filter("k = 0").drop("lead"), ["method", "k"]).select("call_id", "route_id")
    every = literal.unionByName(open_).unionByName(root).distinct()
    return every.join(match_exact(calls, routes), ["call_id", "route_id"], "left_anti").select("call_id", "route_id", F.lit("template").alias("match"), F.lit(1.0).alias("confidence"))


def match_fuzzy(calls: DataFrame, routes: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """Similarity of letter pairs above the threshold. Distinct urls meet on their rarest pairs only (prefix filter), never all with all."""
    urls = calls.select("method", "url").unionByName(routes.select("method", "url")).filter(F.length("url") > 1).distinct()
    urls = cut(urls.select("method", "url", bigrams(F.col("url")).alias("g")))
    rarity = urls.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    items = urls.select("method", "url", F.size("g").alias("n"), F.explode("g").alias("x")).join(rarity, "x")
    ordered = items.groupBy("method", "url", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("s"))
    keep = (F.col("n") - F.floor(F.lit(threshold) * F.col("n")) + 1).cast("int")
    prefix = cut(ordered.select("method", "url", "n", F.posexplode(F.slice("s", F.lit(1), keep)).alias("pos", "s")).select("method", "url", "n", "pos", F.col("s.x").alias("x")))
    a = prefix.join(calls.select("method", "url").distinct(), ["method", "url"], "left_semi").select("method", F.col("url").alias("cu"), F.col("n").alias("cn"), F.col("pos").alias("cp"), "x")
    b = prefix.join(routes.select("method", "url").distinct(), ["method", "url"], "left_semi").select("method", F.col("url").alias("ru"), F.col("n").alias("rn"), F.col("pos").alias("rp"), "x")
    fits = (F.col("cn") > threshold * F.col("rn")) & (F.col("rn") > threshold * F.col("cn"))
    left = 1 + F.least(F.col("cn") - F.col("cp") - 1, F.col("rn") - F.col("rp") - 1)  # the most they can still share
    met = spread(a, "method", "x").join(b, ["method", "x"]).filter(fits & (left > threshold / (1 + threshold) * (F.col("cn") + F.col("rn")) - 1e-9)).select("method", "cu", "ru").distinct()
    met = met.join(urls.select("method", F.col("url").alias("cu"), F.col("g").alias("cg")), ["method", "cu"]).join(urls.select("method", F.col("url").alias("ru"), F.col("g").alias("rg")), ["method", "ru"])
    near = met.withColumn("i", F.size(F.array_intersect("cg", "rg"))).withColumn("confidence", F.col("i") / (F.size("cg") + F.size("rg") - F.col("i"))).filter(F.col("confidence") > threshold).drop("cg", "rg", "i")
    pairs = near.join(calls.select("call_id", "method", F.col("url").alias("cu")), ["method", "cu"]).join(routes.select("route_id", "method", F.col("url").alias("ru")), ["method", "ru"])
    before = match_exact(calls, routes).select("call_id", "route_id").unionByName(match_template(calls, routes).select("call_id", "route_id"))
    return pairs.join(before, ["call_id", "route_id"], "left_anti").select("call_id", "route_id", F.lit("fuzzy").alias("match"), F.round("confidence", 6).alias("confidence"))


def match_http(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """All three steps; an earlier one keeps a pair from the later."""
    return match_exact(calls, routes).unionByName(match_template(calls, routes)).unionByName(match_fuzzy(calls, routes))


def match_ffi(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """import_id, export_id of equal framework and symbol; each side may match many."""
    return imports.join(exports, ["framework", "symbol"]).select("import_id", "export_id", "framework", "symbol")


def export_callers(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """export_id, symbol, callers; exports nobody uses keep 0. Users are counted before the join, so a hot symbol moves one row."""
    users = imports.groupBy("framework", "symbol").agg(F.count("*").alias("callers"))
    return exports.join(users, ["framework", "symbol"], "left").select("export_id", "symbol", F.coalesce("callers", F.lit(0)).alias("callers"))


def cross_edges(http: DataFrame, ffi: DataFrame) -> DataFrame:
    """source, target, kind of both tables, each way. http: caller, handler; ffi: caller, callee."""
    one = http.select(F.col("caller").alias("source"), F.col("handler").alias("target"), F.lit("http_calls").alias("kind")).unionByName(
        ffi.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("cross_ffi").alias("kind"))
    )
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")).distinct()
