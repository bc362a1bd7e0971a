"""Queries of search, similarity, cross-tier matching, federation, differences and change detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cluster import cut
from graphloom.functions import code
from graphloom.graph import PropertyGraph
from graphloom.operators import analytics, crosstier, diff, resolve, search, similarity, traverse
from graphloom.plans.analytics_queries import _TOKENS_SQL
from graphloom.plans.base import Query, graph_sql
from graphloom.plans.graph_queries import _SEEDS, _removed
from graphloom.sources import extract
from graphloom.sources.tables import table
from graphloom.streaming import watch

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[..., DataFrame], sql: str | None = None, whole: bool = False) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        g = PropertyGraph.load(spark, d)
        return run(g, spark, d) if whole else run(g)

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# --- search ---


def _fts(query: str, keep: str = "") -> list[str]:
    want = search.terms_of(query)
    hits = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS h{i}" for i, w in enumerate(want))
    score = " + ".join(f"ln(1 + (k - d{i} + 0.5) / (d{i} + 0.5)) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(want)))
    return [
        f"tk AS (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(name, ''), coalesce(qualified_name, ''), coalesce(docstring, ''), coalesce(signature, ''))), '[^a-z0-9_]+'), lambda x: x <> '') AS t FROM n)",
        f"hh AS (SELECT *, len(t) AS len, {hits} FROM tk)",
        "st AS (SELECT count(*) AS k, avg(len) AS av, " + ", ".join(f"count(*) FILTER (h{i} > 0) AS d{i}" for i in range(len(want))) + " FROM hh)",
        f"fts AS (SELECT hh.*, {score} AS rank FROM hh, st WHERE " + " AND ".join(f"h{i} > 0" for i in range(len(want))) + ")",
    ]


_Q = "merge rows"
add("search_fts", lambda g: search.search_text(g, _Q).select("id", F.round("rank", 6).alias("rank")), graph_sql("SELECT id, round(rank, 6) AS rank FROM fts", *_fts(_Q)))
add("search_like", lambda g: search.search_like(g, "Cache_"), graph_sql("SELECT id FROM n WHERE coalesce(name ILIKE '%Cache_%', false) OR coalesce(qualified_name ILIKE '%Cache_%', false)"))
add("search_fuzzy", lambda g: search.search_fuzzy(g, "vendRs"), graph_sql("SELECT id, levenshtein(lower(name), 'vendrs') AS distance FROM n WHERE lower(name[1]) = 'v' AND levenshtein(lower(name), 'vendrs') <= 2"))
add("search_cascade", lambda g: search.cascade(g, "flushTabel"), graph_sql(
    "SELECT id, tier FROM a WHERE tier = (SELECT min(tier) FROM a)", *_fts("flushTabel"),
    "a AS (SELECT id, 1 AS tier FROM fts UNION ALL SELECT id, 2 FROM n WHERE coalesce(name ILIKE '%flushTabel%', false) OR coalesce(qualified_name ILIKE '%flushTabel%', false) UNION ALL SELECT id, 3 FROM n WHERE lower(name[1]) = 'f' AND levenshtein(lower(name), 'flushtabel') <= 2)"))
add("search_qualified", lambda g: search.search_qualified(g, "kind:method lang:java path:/web00/ int"), graph_sql("SELECT id FROM fts WHERE kind = 'method' AND lower(language) = 'java' AND contains(file_path, '/web00/')", *_fts("int")))
add("search_substring", lambda g: search.search_substring(g, "Digest"), graph_sql(
    "SELECT id, found_in FROM (SELECT id, CASE WHEN contains(lower(name), 'digest') THEN 'name' WHEN contains(lower(qualified_name), 'digest') THEN 'qualified_name' WHEN contains(lower(docstring), 'digest') THEN 'docstring' END AS found_in FROM n) WHERE found_in IS NOT NULL"))


def _share_sql(text: str, want: list[str]) -> str:
    return "((" + " + ".join(f"contains({text}, '{w}')::INT" for w in want) + f") / {len(want)})"


_W = search.terms_of(_Q)
_L = " ".join(_W)
add("semantic_rank_lite", lambda g: search.rank_lite(g, _Q), graph_sql(
    f"SELECT id, round(0.25 / (1 + exp(5 - rank)) + 0.2 * CASE WHEN contains(qn, '{_L}') THEN {len(_L)} / length(qn) * 0.8 + 0.2 ELSE {_share_sql('qn', _W)} * 0.6 END "
    f"+ 0.2 * CASE WHEN nm = '{_L}' THEN 1 WHEN contains(nm, '{_L}') THEN {len(_L)} / length(nm) * 0.7 + 0.3 ELSE {_share_sql('nm', _W)} * 0.5 END + 0.15 * {_share_sql('dc', _W)} + 0.1 * {_share_sql('pa', _W)} + 0.1 * least(log10(1 + coalesce(k, 0)) / 3, 1.0), 6) AS score FROM c",
    *_fts(_Q),
    "c AS (SELECT fts.id, rank, lower(coalesce(qualified_name, '')) AS qn, lower(coalesce(name, '')) AS nm, lower(concat_ws(' ', coalesce(docstring, ''), coalesce(signature, ''))) AS dc, lower(coalesce(file_path, '')) AS pa, i.k FROM fts LEFT JOIN (SELECT target, count(*) AS k FROM e WHERE target IS NOT NULL GROUP BY 1) i ON i.target = fts.id)"))
add("semantic_rank", lambda g: search.rank_full(g, "rows"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return search.vector_topk(v, v.filter("vec_id % 100 = 0")).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


QUERIES["vector_topk"] = vector_topk
SQL["vector_topk"] = """SELECT query_id, id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, v.vec_id) AS rank FROM
(SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings) v ON v.vec_id <> q.vec_id, LATERAL (SELECT list_cosine_similarity(a, b) AS s)) WHERE rank <= 10"""

# --- similar code ---


def _bodies(g: PropertyGraph) -> DataFrame:
    """Shingles of normalised tokens of every function and method body."""
    f = analytics.functions(g, "body").filter("body is not null").select("id", code.ast_tokens(F.col("body")).alias("t"))
    return f.select("id", similarity.shingles(F.col("t")).alias("items"))  # a column of its own: within the lambda it would be computed for each shingle


def _kept_bodies(g: PropertyGraph) -> DataFrame:
    """The same, of tokens that are found once and kept as texts: a token has no blank, and the shingles are many times as long."""
    f = analytics.functions(g, "body").filter("body is not null").select("id", F.array_join(code.ast_tokens(F.col("body")), " ").alias("text"))
    f = cut(f).select("id", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("t"))
    return f.select("id", similarity.shingles(F.col("t")).alias("items"))


def _names(g: PropertyGraph) -> DataFrame:
    """Words of name and signature, and letter pairs of the name."""
    f = analytics.functions(g, "name", "signature")
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "signature")), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    pairs = F.transform(crosstier.bigrams(F.lower(F.coalesce("name", F.lit("")))), lambda x: F.concat(F.lit("__bigram_"), x))
    return f.select("id", F.array_distinct(F.concat(words, pairs)).alias("items"))


def _clones_sql(items: str, *more: str) -> str:
    return graph_sql(
        "SELECT s.id, coalesce(c.class, s.id) AS class, coalesce(copies, 1) AS copies, coalesce(k, 0) AS links FROM sets s LEFT JOIN grp ON grp.key = s.key LEFT JOIN cls c ON c.rep = grp.rep LEFT JOIN (SELECT a, count(*) AS k FROM pr GROUP BY 1) z ON z.a = grp.rep",
        *more,
        f"sets AS MATERIALIZED (SELECT id, items, CASE WHEN len(items) > 0 THEN array_to_string(list_sort(items), chr(1)) END AS key FROM ({items}))",
        "grp AS MATERIALIZED (SELECT key, min(id) AS rep, count(*) AS copies, min_by(items, id) AS items FROM sets WHERE key IS NOT NULL GROUP BY 1)",
        "its AS MATERIALIZED (SELECT rep, len(items) AS k, unnest(items) AS x FROM grp)",
        "co AS MATERIALIZED (SELECT p.rep AS a, q.rep AS b, count(*) AS i, any_value(p.k) AS ka, any_value(q.k) AS kb FROM its p JOIN its q ON q.x = p.x AND p.rep <> q.rep AND q.k >= 0.8 * p.k - 1e-9 AND p.k >= 0.8 * q.k - 1e-9 GROUP BY 1, 2)",
        "pr AS MATERIALIZED (SELECT a, b FROM co WHERE i / (ka + kb - i) >= 0.8 - 1e-9)",
        "walk AS (SELECT rep AS a, rep AS b FROM grp UNION SELECT w.a, pr.b FROM walk w JOIN pr ON pr.a = w.b)",
        "cls AS (SELECT a AS rep, min(b) AS class FROM walk GROUP BY 1)", recursive=True)


add("clones_minhash", lambda g: similarity.clones(_kept_bodies(g)), _clones_sql(
    "SELECT id, CASE WHEN len(tokens) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(tokens) - 4, 1) + 1), lambda i: array_to_string(tokens[i:i + 4], ' '))) END AS items FROM tok", _TOKENS_SQL))
add("clones_exact_jaccard", lambda g: similarity.clones(_names(g)), _clones_sql(
    "SELECT id, list_distinct(list_concat(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, signature)), '[^a-z0-9]+'), lambda w: length(w) > 1), CASE WHEN length(coalesce(name, '')) < 2 THEN [] ELSE list_transform(range(1, length(name)), lambda i: '__bigram_' || substr(lower(name), i, 2)) END)) AS items FROM n WHERE kind IN ('function', 'method')"))
# signatures over the same draws, products in 128 bits
_HEX = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::HUGEINT"
_PRIME = similarity.PRIME
_SIGNED = (
    _TOKENS_SQL,
    "sets AS MATERIALIZED (SELECT id, CASE WHEN len(tokens) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(tokens) - 4, 1) + 1), lambda i: array_to_string(tokens[i:i + 4], ' '))) END AS items FROM tok)",
    f"co AS MATERIALIZED (SELECT i, greatest({_HEX.format(f"'{similarity.SEED}:' || i || ':a'")} % {_PRIME}, 1) AS a, {_HEX.format(f"'{similarity.SEED}:' || i || ':b'")} % {_PRIME} AS b FROM range({similarity.PERMUTATIONS}) r(i))",
    f"hs AS MATERIALIZED (SELECT x, {_HEX.format('x')} AS h FROM (SELECT DISTINCT unnest(items) AS x FROM sets))",
    f"vals AS MATERIALIZED (SELECT x, list((a * h + b) % {_PRIME} ORDER BY i) AS v FROM hs, co GROUP BY x)",
    "its AS (SELECT id, unnest(items) AS x FROM sets)",
    f"sigs AS MATERIALIZED (SELECT id, list(m ORDER BY i) AS sig FROM (SELECT id, i, min(v[i + 1]) AS m FROM its JOIN vals USING (x), range({similarity.PERMUTATIONS}) r(i) GROUP BY ALL) GROUP BY id UNION ALL SELECT id, list_transform(range({similarity.PERMUTATIONS}), lambda i: {_PRIME}::HUGEINT) FROM sets WHERE len(items) = 0)",
    f"per AS MATERIALIZED (SELECT id, band, array_to_string(sig[band * {similarity.ROWS} + 1:(band + 1) * {similarity.ROWS}], ',') AS bucket FROM sigs, range({similarity.BANDS}) r(band))",
    "star AS (SELECT low AS a, id AS b, count(*) AS shared FROM per JOIN (SELECT band, bucket, min(id) AS low FROM per GROUP BY 1, 2 HAVING count(*) > 1) USING (band, bucket) WHERE id <> low GROUP BY 1, 2)",
)
add("minhash_sig", lambda g: similarity.signatures(_bodies(g)).select("id", F.concat_ws(",", F.transform("sig", lambda x: x.cast("string"))).alias("sig")), graph_sql("SELECT id, array_to_string(sig, ',') AS sig FROM sigs", *_SIGNED))
add("lsh_pairs", lambda g: similarity.band_links(cut(similarity.signatures(_bodies(g)))), graph_sql("SELECT a, b, shared FROM star", *_SIGNED))
add("jaccard_estimate", lambda g: similarity.estimated_links(cut(similarity.signatures(_bodies(g)))), graph_sql(
    f"SELECT a, b, round(len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / {similarity.PERMUTATIONS}.0, 6) AS similarity FROM star JOIN sigs p ON p.id = a JOIN sigs q ON q.id = b", *_SIGNED))

# --- tiers: classes stand for routes, methods for calls to them, in the spelling of several frameworks ---

_AREA = "regexp_extract({p}file_path, '^[^/]+/([a-z]+)', 1)"


def _routes(g: PropertyGraph) -> DataFrame:
    n = g.nodes("kind", "name", "file_path", "start_line").filter("kind = 'class' and name is not null and start_line is not null")
    url = F.concat(F.lit("/"), F.regexp_extract("file_path", "^[^/]+/([a-z]+)", 1), F.lit("/"), F.lower("name"), F.lit("/{id}"))
    return n.select(F.col("id").alias("route_id"), F.when(F.col("start_line") % 2 == 0, "GET").otherwise("POST").alias("method"), url.alias("url"))


def _calls(g: PropertyGraph) -> DataFrame:
    n = g.nodes("kind", "qualified_name", "file_path", "start_line").filter("kind = 'method' and start_line is not null").withColumn("c", F.lower(F.regexp_extract("qualified_name", r"::(\w+)\.", 1)))
    tail = F.when(F.col("start_line") % 3 == 0, "/{id}").when(F.col("start_line") % 3 == 1, F.concat(F.lit("/"), F.col("start_line").cast("string"))).otherwise("s/{id}")
    url = F.concat(F.lit("/"), F.regexp_extract("file_path", "^[^/]+/([a-z]+)", 1), F.lit("/"), F.col("c"), tail)
    return n.filter("c <> ''").select(F.col("id").alias("call_id"), F.when(F.col("start_line") % 2 == 0, "GET").otherwise("POST").alias("method"), url.alias("url"))


_TIERS = [
    rf"routes AS (SELECT id AS route_id, CASE WHEN start_line % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || {_AREA.format(p='')} || '/' || lower(name) || '/{{id}}' AS url FROM n WHERE kind = 'class' AND name IS NOT NULL AND start_line IS NOT NULL)",
    rf"calls AS (SELECT id AS call_id, CASE WHEN start_line % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || {_AREA.format(p='')} || '/' || c || CASE start_line % 3 WHEN 0 THEN '/{{id}}' WHEN 1 THEN '/' || start_line ELSE 's/{{id}}' END AS url FROM (SELECT *, lower(regexp_extract(qualified_name, '::(\w+)\.', 1)) AS c FROM n WHERE kind = 'method' AND start_line IS NOT NULL) WHERE c <> '')",
    "exact AS (SELECT call_id, route_id, 'exact' AS match, 1.0 AS confidence FROM calls JOIN routes USING (method, url))",
    "tmpl AS (SELECT call_id, route_id, 'template' AS match, 1.0 AS confidence FROM (SELECT *, string_split(url, '/') AS s FROM calls) c JOIN (SELECT route_id, method, string_split(url, '/') AS r FROM routes) x ON x.method = c.method AND len(s) = len(r) AND s[2] = r[2] AND s[3] = r[3] WHERE (call_id, route_id) NOT IN (SELECT (call_id, route_id) FROM exact))",
    "big AS (SELECT url, list_distinct(list_transform(range(1, length(url)), lambda i: substr(url, i, 2))) AS g FROM (SELECT url FROM calls UNION SELECT url FROM routes))",
    "fuzzy AS (SELECT call_id, route_id, 'fuzzy' AS match, round(j, 6) AS confidence FROM (SELECT call_id, route_id, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS j FROM calls c JOIN routes r ON r.method = c.method JOIN big a ON a.url = c.url JOIN big b ON b.url = r.url) WHERE j > 0.7 AND (call_id, route_id) NOT IN (SELECT (call_id, route_id) FROM exact UNION ALL SELECT (call_id, route_id) FROM tmpl))",
]
add("http_match_exact", lambda g: crosstier.match_exact(_calls(g), _routes(g)), graph_sql("SELECT * FROM exact", *_TIERS))
add("http_match_template", lambda g: crosstier.match_template(_calls(g), _routes(g)), graph_sql("SELECT * FROM tmpl", *_TIERS))
add("http_match_fuzzy", lambda g: crosstier.match_fuzzy(_calls(g), _routes(g)), graph_sql("SELECT * FROM fuzzy", *_TIERS))
_MATCHED = "matched AS (SELECT * FROM exact UNION ALL SELECT * FROM tmpl)"


def _known(g: PropertyGraph) -> DataFrame:
    c, r = _calls(g), _routes(g)
    return crosstier.match_exact(c, r).unionByName(crosstier.match_template(c, r))


add("routes_overview", lambda g: _routes(g).join(_known(g), "route_id", "left_anti"), graph_sql("SELECT route_id, method, url FROM routes WHERE route_id NOT IN (SELECT route_id FROM matched)", *_TIERS, _MATCHED))
add("trace_request", lambda g: _routes(g).filter("upper(method) = upper('get')").join(_known(g), "route_id").groupBy("route_id", "url").agg(F.count("*").alias("callers")), graph_sql(
    "SELECT r.route_id, url, count(*) AS callers FROM routes r JOIN matched USING (route_id) WHERE method = 'GET' GROUP BY ALL", *_TIERS, _MATCHED))


def _urls(g: PropertyGraph) -> DataFrame:
    """Each class's route as five frameworks would write it."""
    n = g.nodes("kind", "name", "file_path").filter("kind = 'class' and name is not null")
    base = F.concat(F.lit("/"), F.regexp_extract("file_path", "^[^/]+/([a-z]+)", 1), F.lit("/"), F.lower("name"))
    forms = [("flask", F.concat(base, F.lit("/<int:id>/"))), ("express", F.concat(base, F.lit("/:id"))), ("spring", F.concat(base, F.lit("/{id:[0-9]+}"))), ("django", F.concat(F.lit("^"), base, F.lit("/(?P<id>[0-9]+)/$"))), ("other", F.concat(F.lit("http://host:80"), base, F.lit("/:id?x=1")))]
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("framework"), u.alias("raw")) for f, u in forms]))
    return n.select("id", every.alias("r")).select("id", "r.framework", crosstier.normalize_url(F.col("r.raw"), F.col("r.framework")).alias("url"))


add("url_normalize", _urls, graph_sql(f"SELECT id, unnest(['flask', 'express', 'spring', 'django', 'other']) AS framework, '/' || {_AREA.format(p='')} || '/' || lower(name) || '/{{id}}' AS url FROM n WHERE kind = 'class' AND name IS NOT NULL"))


def _ffi(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Go functions as exports, Python functions of the same name, spelled its way, as imports."""
    n = g.nodes("kind", "name", "language").filter("kind = 'function' and name is not null")
    lang = F.lower("language")
    imports = n.filter(lang.isin("python", "py")).select(F.col("id").alias("import_id"), F.lit("cgo").alias("framework"), F.lower(F.regexp_replace("name", "_", "")).alias("symbol"))
    return imports, n.filter(lang == "go").select(F.col("id").alias("export_id"), F.lit("cgo").alias("framework"), F.lower("name").alias("symbol"))


_FFI = [
    "imp AS (SELECT id AS import_id, 'cgo' AS framework, lower(replace(name, '_', '')) AS symbol FROM n WHERE kind = 'function' AND name IS NOT NULL AND lower(language) IN ('python', 'py'))",
    "ex AS (SELECT id AS export_id, 'cgo' AS framework, lower(name) AS symbol FROM n WHERE kind = 'function' AND name IS NOT NULL AND lower(language) = 'go')",
]
add("ffi_match", lambda g: crosstier.match_ffi(*_ffi(g)), graph_sql("SELECT import_id, export_id, framework, symbol FROM imp JOIN ex USING (framework, symbol)", *_FFI))
add("ffi_exports_caller_count", lambda g: crosstier.export_callers(*_ffi(g)), graph_sql("SELECT export_id, symbol, (SELECT count(*) FROM imp WHERE imp.symbol = ex.symbol) AS callers FROM ex", *_FFI))
add("exports_overview", lambda g: crosstier.export_callers(*_ffi(g)).filter("callers = 0").select("export_id", "symbol"), graph_sql("SELECT export_id, symbol FROM ex WHERE symbol NOT IN (SELECT symbol FROM imp)", *_FFI))


def _cross(g: PropertyGraph, known: Callable[[PropertyGraph], DataFrame] = _known) -> DataFrame:
    http = known(g).select(F.col("call_id").alias("caller"), F.col("route_id").alias("handler"))
    ffi = crosstier.match_ffi(*_ffi(g)).select(F.col("import_id").alias("caller"), F.col("export_id").alias("callee"))
    return crosstier.cross_edges(http, ffi)


_CROSS = "cross_ AS (SELECT call_id AS a, route_id AS b, 'http_calls' AS kind FROM matched UNION SELECT import_id, export_id, 'cross_ffi' FROM imp JOIN ex USING (framework, symbol)), both_ AS (SELECT a, b, kind FROM cross_ UNION SELECT b, a, kind FROM cross_)"
add("cross_lang_edges", _cross, graph_sql("SELECT a AS source, b AS target, kind FROM both_", *_TIERS, _MATCHED, *_FFI, _CROSS))


def _annotated(g: PropertyGraph, s: SparkSession, d: str, known: Callable[[PropertyGraph], DataFrame] = _known) -> DataFrame:
    """What each removed symbol reaches within two steps over calls and tier links: the smallest shortest path, and how many of its steps cross tiers."""
    cross = cut(_cross(g, known))
    calls = g.links("calls")
    links = calls.unionByName(cross.select("source", "target")).distinct()
    seeds = _removed(g, s, d)
    near = traverse.bfs(links, seeds, "out", 2)
    p = traverse.shortest_paths(links, near.select(F.col("seed").alias("source"), F.col("id").alias("target")), 2)
    steps = p.select("source", "target", "length", "path", F.posexplode(F.split("path", ">")).alias("at", "a")).withColumn("b", F.get(F.split("path", ">"), F.col("at") + 1)).filter("b is not null")
    plain = calls.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1).alias("plain")).distinct()
    steps = steps.join(plain, ["a", "b"], "left")
    return steps.groupBy("source", "target", "length", "path").agg(F.count(F.when(F.col("plain").isNull(), 1)).alias("crossings"))


add("shortest_path_annotated", _annotated, graph_sql(
    "SELECT source, target, length, path, (length - (SELECT count(*) FROM range(1, length + 1) t(i) WHERE (string_split(path, '>')[i], string_split(path, '>')[i + 1]) IN (SELECT (a, b) FROM plain)))::BIGINT AS crossings FROM (SELECT seed AS source, id AS target, min(depth) AS length, min_by(path, depth || path) AS path FROM walk GROUP BY ALL HAVING min(depth) > 0)",
    *_TIERS, _MATCHED, *_FFI, _CROSS, _SEEDS, "plain AS (SELECT DISTINCT source AS a, target AS b FROM l WHERE kind = 'calls')", "hop AS (SELECT a, b FROM plain UNION SELECT a, b FROM both_)",
    "walk AS (SELECT id AS seed, id, 0 AS depth, id AS path FROM seeds UNION SELECT w.seed, h.b, w.depth + 1, w.path || '>' || h.b FROM walk w JOIN hop h ON h.a = w.id WHERE w.depth < 2)", links=True, recursive=True), whole=True)


def _all_known(g: PropertyGraph) -> DataFrame:
    return cut(crosstier.match_http(_calls(g), _routes(g)))


# the same over all three steps of matching
_FULL = {name: SQL[name].replace(_MATCHED, "matched AS (SELECT * FROM exact UNION ALL SELECT * FROM tmpl UNION ALL SELECT * FROM fuzzy)") for name in ("routes_overview", "trace_request", "cross_lang_edges", "shortest_path_annotated")}
add("routes_overview_full", lambda g: _routes(g).join(_all_known(g), "route_id", "left_anti"), _FULL["routes_overview"])
add("trace_request_full", lambda g: _routes(g).filter("upper(method) = upper('get')").join(_all_known(g), "route_id").groupBy("route_id", "url").agg(F.count("*").alias("callers")), _FULL["trace_request"])
add("cross_lang_edges_full", lambda g: _cross(g, _all_known), _FULL["cross_lang_edges"])
add("shortest_path_annotated_full", lambda g, s, d: _annotated(g, s, d, _all_known), _FULL["shortest_path_annotated"], whole=True)


def _config(g: PropertyGraph, s: SparkSession, d: str) -> DataFrame:
    """constant, key, rule, confidence: constants of sources (NAME = ...) against keys of JSON files. Exact names 0.9, the dotted rest of a
    prefixed name 0.7, a shared whole word with one name inside the other 0.5; joined on the names, the rests and the words."""
    src = table(s, d, "sources").filter("path is not null and content is not null")
    const = src.filter("not path like '%.json'").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:export )?(?:const )?([A-Z][A-Z0-9_]+) = "), 1)).alias("constant")).distinct()
    keys = src.filter("path like '%.json'").select(F.explode(F.regexp_extract_all("content", F.lit(r'"([A-Za-z][\w.]*)"\s*:'), 1)).alias("key")).distinct()
    c = const.withColumn("low", F.lower("constant"))
    k = keys.withColumn("low", F.lower("key"))
    exact = c.join(k, "low").select("constant", "key", F.lit("exact").alias("rule"), F.lit(0.9).alias("confidence"))
    rest = c.withColumn("low", F.regexp_replace(F.regexp_extract("low", r"^[a-z]{2,}_(.+)$", 1), "_", ".")).filter("low <> ''")
    prefix = rest.join(k, "low").select("constant", "key", F.lit("prefix").alias("rule"), F.lit(0.7).alias("confidence"))
    word = lambda df: df.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z]{3,})"), 1))))
    shared = word(c).join(word(k).withColumnRenamed("low", "klow"), "word").filter("low <> klow and (contains(klow, low) or contains(low, klow))")
    return exact.unionByName(prefix).unionByName(shared.select("constant", "key", F.lit("contains").alias("rule"), F.lit(0.5).alias("confidence")).distinct())


add("config_links", _config, r"""WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^(?:export )?(?:const )?([A-Z][A-Z0-9_]+) = ', 1)) AS constant FROM sources WHERE path NOT LIKE '%.json'),
k AS (SELECT DISTINCT unnest(regexp_extract_all(content, '"([A-Za-z][\w.]*)"\s*:', 1)) AS key FROM sources WHERE path LIKE '%.json')
SELECT constant, key, 'exact' AS rule, 0.9 AS confidence FROM c JOIN k ON lower(constant) = lower(key)
UNION ALL SELECT constant, key, 'prefix', 0.7 FROM c JOIN k ON lower(key) = replace(regexp_extract(lower(constant), '^[a-z]{2,}_(.+)$', 1), '_', '.')
UNION ALL SELECT constant, key, 'contains', 0.5 FROM c JOIN k ON lower(constant) <> lower(key) AND (contains(lower(key), lower(constant)) OR contains(lower(constant), lower(key))) AND len(list_intersect(regexp_extract_all(lower(constant), '([a-z]{3,})', 1), regexp_extract_all(lower(key), '([a-z]{3,})', 1))) > 0""", whole=True)


#: Calls that send an event or message under a literal name, and those that wait for one; what only writes to a console sends none.
EMITS = r"""\b(?:emit|emitAsync|publish|dispatch|dispatchEvent|sendMessage|produce)\(\s*(?:new\s+\w*Event\(\s*)?['"]([^'"]+)['"]"""
LISTENS = r"""(?:\.(?:on|once|subscribe|addListener|addEventListener|consume)\(|@(?:EventListener|OnEvent|Subscribe|MessagePattern|KafkaListener)\()\s*['"]([^'"]+)['"]"""


def _channels(g: PropertyGraph) -> DataFrame:
    """id, kind, name: what bodies emit or listen for, and remote stubs they make, by call patterns."""
    f = analytics.functions(g, "body").filter("body is not null")
    found = F.array_union(
        F.transform(F.regexp_extract_all("body", F.lit(EMITS), 1), lambda x: F.struct(F.lit("emits").alias("kind"), x.alias("name"))),
        F.transform(F.regexp_extract_all("body", F.lit(LISTENS), 1), lambda x: F.struct(F.lit("listens_on").alias("kind"), x.alias("name"))),
    )
    return f.select("id", F.explode(found).alias("r")).select("id", "r.kind", "r.name").distinct()


add("channel_edges", _channels, graph_sql(
    f"""SELECT DISTINCT id, 'emits' AS kind, unnest(regexp_extract_all(body, '{EMITS.replace("'", "''")}', 1)) AS name FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL
    UNION SELECT DISTINCT id, 'listens_on', unnest(regexp_extract_all(body, '{LISTENS.replace("'", "''")}', 1)) FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL"""))  # fmt: skip

#: Ways code names a remote service: what serves it, and what calls it, by a stub or by the factory of one.
SERVES = r"\b(\w+)(?:Servicer|ServiceImplBase|ImplBase)\b"
CALLS_BY_STUB, CALLS_BY_FACTORY = r"\b([A-Z]\w*?)(?:BlockingStub|FutureStub|Stub)\s*\(", r"\b(\w+)Grpc\.new\w*Stub\s*\("


def _grpc(g: PropertyGraph) -> DataFrame:
    """id, kind, name: remote services that symbols serve (servicers, service bases) or call (stubs), by how their code names them."""
    n = g.nodes("kind", "name", "body", "signature").filter("kind in ('class', 'function', 'method')")
    text = F.concat_ws(" ", F.coalesce("signature", F.lit("")), F.coalesce("body", F.lit("")))
    named = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    found = F.concat(named(SERVES, "grpc_server"), named(CALLS_BY_STUB, "grpc_client"), named(CALLS_BY_FACTORY, "grpc_client"))
    return n.select("id", F.explode(found).alias("r")).select("id", "r.kind", "r.name").distinct()


add("grpc_edges", _grpc, graph_sql(
    f"""SELECT DISTINCT id, 'grpc_server' AS kind, unnest(regexp_extract_all(t, '{SERVES}', 1)) AS name FROM s UNION SELECT DISTINCT id, 'grpc_client', unnest(regexp_extract_all(t, '{CALLS_BY_STUB}', 1)) FROM s
    UNION SELECT DISTINCT id, 'grpc_client', unnest(regexp_extract_all(t, '{CALLS_BY_FACTORY}', 1)) FROM s""",
    "s AS (SELECT id, coalesce(signature, '') || ' ' || coalesce(body, '') AS t FROM n WHERE kind IN ('class', 'function', 'method'))"))

# --- federation, differences ---

add("fed_search", lambda g: diff.fed_search(g, _Q), graph_sql("SELECT repo, id, place FROM (SELECT split_part(file_path, '/', 1) AS repo, id, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY round(rank, 9) DESC, id) AS place FROM fts WHERE file_path IS NOT NULL) WHERE place <= 200", *_fts(_Q)))
add("fed_find_symbol", diff.fed_symbols, graph_sql("SELECT name, repo, symbols FROM (SELECT name, split_part(file_path, '/', 1) AS repo, count(*) AS symbols, count(*) OVER (PARTITION BY name) AS repos FROM n WHERE name IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2) WHERE repos > 1"))
_DANGLING = r"d AS (SELECT eid, split_part(n.file_path, '/', 1) AS repo, regexp_extract(e.target_text, '([A-Za-z_]\w*)\W*$', 1) AS name FROM e JOIN n ON n.id = e.source WHERE trim(e.target_text) <> '' AND (target IS NULL OR target NOT IN (SELECT id FROM n)))"
add("fed_calls", diff.fed_calls, graph_sql("SELECT d.repo, x.repo AS target_repo, count(*) AS \"references\" FROM d JOIN (SELECT DISTINCT name, split_part(file_path, '/', 1) AS repo FROM n WHERE name IS NOT NULL AND file_path IS NOT NULL) x ON x.name = d.name WHERE d.name <> '' AND d.repo <> x.repo GROUP BY 1, 2", _DANGLING))
add("fed_impact", lambda g, s, d: diff.fed_impact(g, _removed(g, s, d)), graph_sql(
    "SELECT e.target AS seed, split_part(a.file_path, '/', 1) AS repo, count(*) AS edges FROM e JOIN seeds ON seeds.id = e.target JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) GROUP BY 1, 2", _SEEDS), whole=True)
add("fed_unresolved", diff.fed_unresolved, graph_sql("SELECT repo, count(*) AS \"references\" FROM d GROUP BY 1", _DANGLING))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """First against last snapshot: symbols by qualified name and signature, links by their ends and kind."""
    n, e = table(spark, d, "node_snapshots"), table(spark, d, "edge_snapshots").withColumn("kind", F.lower("kind"))
    a = diff.snapshot_diff(n.filter("snap = 1"), n.filter("snap = 4"), ["qualified_name"], "signature").select(F.lit("node").alias("entity"), F.col("qualified_name").alias("item"), "change")
    key = ["source_name", "target_name", "kind"]
    b = diff.snapshot_diff(e.filter("snap = 1"), e.filter("snap = 4"), key).select(F.lit("edge").alias("entity"), F.concat_ws(">", *key).alias("item"), "change")
    return a.unionByName(b)


QUERIES["snapshot_diff"] = snapshot_diff
SQL["snapshot_diff"] = """WITH a AS (SELECT qualified_name AS k, max(coalesce(signature, '')) AS v FROM node_snapshots WHERE snap = 1 GROUP BY 1), b AS (SELECT qualified_name AS k, max(coalesce(signature, '')) AS v FROM node_snapshots WHERE snap = 4 GROUP BY 1),
x AS (SELECT DISTINCT source_name || '>' || target_name || '>' || lower(kind) AS k FROM edge_snapshots WHERE snap = 1), y AS (SELECT DISTINCT source_name || '>' || target_name || '>' || lower(kind) AS k FROM edge_snapshots WHERE snap = 4)
SELECT 'node' AS entity, coalesce(a.k, b.k) AS item, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v
UNION ALL SELECT 'edge', coalesce(x.k, y.k), CASE WHEN x.k IS NULL THEN 'added' ELSE 'removed' END FROM x FULL JOIN y ON x.k = y.k WHERE x.k IS NULL OR y.k IS NULL"""

# --- change detection: the listing as it was seen by the start of December 2025, and now ---


def _seen(spark: SparkSession, d: str, until: str | None) -> DataFrame:
    rows = table(spark, d, "file_listing").filter("path is not null")
    if until:
        rows = rows.filter(F.col("listed_at") < F.lit(until).cast("timestamp_ntz"))
    return rows.groupBy("path").agg(F.max_by("modified_at", F.struct("listed_at", "modified_at")).alias("modified_at"))


def poll_changes(spark: SparkSession, d: str) -> DataFrame:
    return watch.poll_changes(_seen(spark, d, "2025-12-01 00:00:00"), _seen(spark, d, None))


def debounce(spark: SparkSession, d: str) -> DataFrame:
    """Each listing row is an event: created if nothing was listed for its path before, else modified or unchanged; the last one stays."""
    from pyspark.sql import Window

    rows = table(spark, d, "file_listing").filter("path is not null").select("path", "listed_at", "modified_at").distinct()
    w = Window.partitionBy("path").orderBy("listed_at", "modified_at")
    kind = F.when(F.lag("listed_at").over(w).isNull(), "created").when(F.lag("modified_at").over(w) != F.col("modified_at"), "modified").otherwise("unchanged")
    return watch.debounce(rows.select("path", kind.alias("kind"), F.struct("listed_at", "modified_at").alias("seq")))


QUERIES |= {"poll_changes": poll_changes, "debounce": debounce}
SQL["poll_changes"] = """WITH a AS (SELECT path, arg_max(modified_at, (listed_at, modified_at)) AS m FROM file_listing WHERE listed_at < TIMESTAMP '2025-12-01' GROUP BY 1), b AS (SELECT path, arg_max(modified_at, (listed_at, modified_at)) AS m FROM file_listing GROUP BY 1)
SELECT path, kind FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'removed' WHEN a.m IS DISTINCT FROM b.m THEN 'modified' END AS kind FROM a FULL JOIN b ON a.path = b.path) WHERE kind IS NOT NULL"""
SQL["debounce"] = """WITH r AS (SELECT DISTINCT path, listed_at, modified_at FROM file_listing), s AS (SELECT path, listed_at, modified_at, lag(listed_at) OVER w AS pl, lag(modified_at) OVER w AS pm, row_number() OVER (PARTITION BY path ORDER BY listed_at DESC, modified_at DESC) AS rn FROM r WINDOW w AS (PARTITION BY path ORDER BY listed_at, modified_at))
SELECT path, CASE WHEN pl IS NULL THEN 'created' WHEN pm <> modified_at THEN 'modified' ELSE 'unchanged' END AS kind FROM s WHERE rn = 1"""


def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the source texts themselves."""
    return extract.extract_nodes(table(spark, d, "sources")).select("id", "kind", "qualified_name", "start_line", "end_line", "signature", "docstring")


def extract_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_edges(table(spark, d, "sources")).select("source", "target", "target_text", "kind", "source_loc", "provenance")


def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of all source files, resolved among them by the module rules of each language."""
    sources = table(spark, d, "sources")
    return resolve.resolve_imports(cut(extract.extract_nodes(sources).select("id", "kind", "name", "file_path", "language")), extract.extract_edges(sources))


QUERIES |= {"extract_nodes": extract_nodes, "extract_edges": extract_edges, "resolve_imports": resolve_imports}
