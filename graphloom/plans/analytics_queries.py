"""Queries of the structural analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import code
from graphloom.graph import PropertyGraph
from graphloom.operators import analytics, increment, traverse
from graphloom.plans.base import Query, graph_sql
from graphloom.plans.graph_queries import _SEEDS, _hop, _removed
from graphloom.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[..., DataFrame], sql: str | None = None, whole: bool = False) -> None:
    """``whole``: the query takes (graph, spark, folder) for tables beside the graph."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        g = PropertyGraph.load(spark, d)
        return run(g, spark, d) if whole else run(g)

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _in(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TEST = f"coalesce(regexp_matches({{}}, '{analytics.TEST_FILE}'), false)"
_HOOKS, _INITS = _in(analytics.HOOK_NAMES), _in(analytics.INIT_NAMES)
_ENTRY = f"""entry AS (SELECT id, file_path, entry_type, CASE entry_type WHEN 'test' THEN conf ELSE CASE WHEN entry_type IN ('cli', 'route_handler') THEN 0.8 ELSE 0.9 END END AS confidence FROM (
  SELECT id, file_path, CASE
    WHEN contains(coalesce(qualified_name, ''), '__main__') OR name = 'main' THEN 'main'
    WHEN starts_with(coalesce(name, ''), 'test_') OR regexp_matches(lower(coalesce(file_path, '')), 'test|spec') OR contains(coalesce(decorators, ''), 'Test') THEN 'test'
    WHEN regexp_matches(lower(coalesce(decorators, '')), '{analytics.CLI_DECORATORS}') THEN 'cli'
    WHEN regexp_matches(lower(coalesce(decorators, '')), '{analytics.ROUTE_DECORATORS}') THEN 'route_handler'
    WHEN name IN ({_INITS}) THEN 'init' WHEN name IN ({_HOOKS}) THEN 'hook' END AS entry_type,
    CASE WHEN starts_with(coalesce(name, ''), 'test_') THEN 0.9 WHEN regexp_matches(lower(coalesce(file_path, '')), 'test|spec') THEN 0.7 ELSE 0.8 END AS conf
  FROM n WHERE kind IN ('function', 'method')) WHERE entry_type IS NOT NULL)"""

add("entry_points", lambda g: analytics.one_entry_a_file(analytics.entry_points(g)), graph_sql("SELECT file_path, entry_type, min(id) AS id, min_by(confidence, id) AS confidence FROM entry GROUP BY 1, 2", _ENTRY))
add("dead_code_degree", analytics.dead_by_degree, graph_sql(
    "SELECT n.id, n.name, 0 AS in_degree, coalesce(o.k, 0) AS out_degree FROM n LEFT JOIN (SELECT source, count(*) AS k FROM e WHERE kind IN ('calls', 'references') GROUP BY 1) o ON o.source = n.id "
    "WHERE kind IN ('function', 'method') AND id NOT IN (SELECT target FROM e WHERE kind IN ('calls', 'references') AND target IS NOT NULL) AND id NOT IN (SELECT id FROM entry)", _ENTRY))  # fmt: skip
_DEAD = """dead AS (SELECT id, name, kind, file_path FROM n WHERE id NOT IN (SELECT target FROM e WHERE kind IN ('calls', 'references') AND target IS NOT NULL) AND NOT (
  contains(coalesce(file_path, ''), 'test') OR ends_with(coalesce(file_path, ''), '__init__.py') OR lower(coalesce(name, '')) = 'main' OR contains(lower(coalesce(name, '')), 'main') AND coalesce(kind = 'function', false)
  OR starts_with(lower(coalesce(name, '')), 'handle_') OR ends_with(lower(coalesce(name, '')), '_handler') OR ends_with(lower(coalesce(name, '')), '_route') OR ends_with(lower(coalesce(name, '')), '_endpoint')
  OR lower(coalesce(name, '')) IN ('startup', 'shutdown', 'init') OR coalesce(is_exported, 0) = 1 OR starts_with(coalesce(name, ''), '__') AND ends_with(coalesce(name, ''), '__')
  OR starts_with(coalesce(name, ''), 'test_') OR ends_with(coalesce(name, ''), '_test')))"""
add("dead_code_rules", analytics.dead_by_rules, graph_sql("SELECT * FROM dead", _DEAD))
add("dead_code_reachability", analytics.dead_by_reach, graph_sql(
    "SELECT d.id, CASE WHEN od > 0 THEN 'unreachable' WHEN ind > 0 THEN 'unreachable_from_entry' ELSE 'no_callers' END AS reason FROM d WHERE id NOT IN (SELECT id FROM reach)",
    _ENTRY,
    f"f AS (SELECT id FROM n WHERE kind IN ('function', 'method') AND NOT {TEST.format('file_path')})",
    "c AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls' AND target IS NOT NULL)",
    "d AS (SELECT f.id, coalesce(i.k, 0) AS ind, coalesce(o.k, 0) AS od FROM f LEFT JOIN (SELECT target, count(*) AS k FROM c GROUP BY 1) i ON i.target = f.id LEFT JOIN (SELECT source, count(*) AS k FROM c GROUP BY 1) o ON o.source = f.id)",
    "s0 AS (SELECT id FROM entry WHERE id IN (SELECT id FROM f))",
    "s1 AS (SELECT id FROM s0 UNION SELECT id FROM d WHERE ind = 0 AND od > 0 AND (SELECT count(*) FROM s0) < greatest(5, (SELECT count(*) FROM f) / 100))",
    "reach AS (SELECT id FROM s1 UNION SELECT c.target FROM reach r JOIN c ON c.source = r.id)", recursive=True))

# --- layers: areas of the code base from the outside in ---

# Fixed values of these queries: the layer of each area.
LAYERS = {"web": 1, "api": 1, "cli": 1, "notify": 2, "billing": 2, "auth": 2, "search": 2, "query": 2, "workers": 2, "planner": 3, "engine": 3, "graph": 3, "ingest": 3, "export": 3, "core": 4, "store": 4, "tools": 4}


def _area_layer():
    area = F.regexp_extract("file_path", "^[^/]+/([a-z]+)", 1)
    return F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])[area]


_LAYER_SQL = "lay AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in LAYERS.items()) + ") AS t(area, layer)), nl AS (SELECT n.id, n.file_path, lay.layer FROM n JOIN lay ON lay.area = regexp_extract(n.file_path, '^[^/]+/([a-z]+)', 1))"
add("layer_violations", lambda g: analytics.layer_violations(g, _area_layer()), graph_sql(
    "SELECT DISTINCT l.source, l.target, a.layer AS source_layer, b.layer AS target_layer FROM l JOIN nl a ON a.id = l.source JOIN nl b ON b.id = l.target WHERE l.kind = 'calls' AND a.file_path <> b.file_path AND a.layer > b.layer", _LAYER_SQL, links=True))


def _prefix_violations(g: PropertyGraph) -> DataFrame:
    """Levels stand on the folders of the graph itself: every package's path, numbered by its area's layer."""
    p = g.nodes("kind", "file_path").filter("kind in ('module', 'package')").select(F.col("file_path").alias("prefix"), _area_layer().alias("level")).filter("level is not null").distinct()
    return analytics.layer_violations_prefix(g, p)


add("layer_violations_prefix", _prefix_violations, graph_sql(
    "SELECT DISTINCT l.source, l.target, a.level AS source_level, b.level AS target_level FROM l JOIN lv a ON a.id = l.source JOIN lv b ON b.id = l.target WHERE l.kind IN ('calls', 'imports') AND a.level < b.level",
    _LAYER_SQL,
    "pre AS (SELECT DISTINCT n.file_path AS prefix, lay.layer AS level FROM n JOIN lay ON lay.area = regexp_extract(n.file_path, '^[^/]+/([a-z]+)', 1) WHERE kind IN ('module', 'package'))",
    "lv AS (SELECT n.id, arg_max(pre.level, length(pre.prefix)) AS level FROM n JOIN pre ON n.file_path = pre.prefix OR starts_with(n.file_path, pre.prefix || '/') GROUP BY 1)", links=True))


def _metrics_sql(unit: str, where: str, units: bool) -> str:
    ca, ce = ("ca", "ce") if units else ("incoming", "outgoing")
    return graph_sql(
        f"SELECT coalesce(m.unit, t.unit) AS unit, coalesce(internal, 0) AS internal, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, round(CASE WHEN coalesce(internal, 0) + coalesce(outgoing, 0) <> 0 THEN coalesce(internal, 0) / (coalesce(internal, 0) + coalesce(outgoing, 0)) ELSE 0 END, 6) AS cohesion, "
        f"coalesce({ca}, 0) + coalesce({ce}, 0) AS coupling, round(CASE WHEN coalesce({ca}, 0) + coalesce({ce}, 0) <> 0 THEN coalesce({ce}, 0) / (coalesce({ca}, 0) + coalesce({ce}, 0)) ELSE 0 END, 6) AS instability FROM m FULL JOIN t ON t.unit = m.unit",
        f"u AS (SELECT id, {unit} AS unit FROM n WHERE file_path IS NOT NULL)",
        f"x AS (SELECT a.unit AS a, b.unit AS b FROM (SELECT DISTINCT source, target FROM l {where}) k JOIN u a ON a.id = k.source JOIN u b ON b.id = k.target)",
        "m AS (SELECT a AS unit, count(*) FILTER (a = b) AS internal, count(*) FILTER (a <> b) AS outgoing, count(DISTINCT b) FILTER (a <> b) AS ce FROM x GROUP BY 1)",
        "t AS (SELECT b AS unit, count(*) AS incoming, count(DISTINCT a) AS ca FROM x WHERE a <> b GROUP BY 1)", links=True)


add("metrics_file", lambda g: analytics.unit_metrics(g, F.col("file_path"), ("calls",), True), _metrics_sql("file_path", "WHERE kind = 'calls'", True))
add("metrics_prefix", lambda g: analytics.unit_metrics(g, F.concat_ws("/", F.slice(F.split("file_path", "/"), 1, 2))), _metrics_sql("array_to_string(string_split(file_path, '/')[1:2], '/')", "", False))
_FT = f"f AS (SELECT id, file_path, name, {TEST.format('file_path')} AS test FROM n WHERE kind IN ('function', 'method') AND file_path IS NOT NULL)"
add("health_scores", analytics.health, graph_sql(
    "SELECT file_path, floor(round(tested / functions * 100 * 0.4 + (functions - dead) / functions * 100 * 0.25 + (100 - dependencies / greatest((SELECT max(dependencies) FROM per), 1) * 100) * 0.2 + (100 - functions / greatest((SELECT max(functions) FROM per), 1) * 100) * 0.15, 6))::BIGINT AS score, functions, tested, dead, dependencies FROM per",
    _FT,
    "c AS (SELECT DISTINCT source, target FROM l WHERE kind = 'calls')",
    "tested AS (SELECT DISTINCT c.target AS id FROM c JOIN f ON f.id = c.source WHERE f.test)",
    f"called AS (SELECT DISTINCT c.target AS id FROM c JOIN n ON n.id = c.source WHERE NOT {TEST.format('n.file_path')})",
    "deps AS (SELECT f.file_path, count(DISTINCT k.target) AS d FROM (SELECT DISTINCT source, target FROM l WHERE kind IN ('calls', 'imports')) k JOIN f ON f.id = k.source AND NOT f.test JOIN n ON n.id = k.target WHERE n.file_path <> f.file_path AND n.file_path NOT LIKE 'tests/%' GROUP BY 1)",
    "per AS MATERIALIZED (SELECT f.file_path, count(*) AS functions, count(tested.id) AS tested, count(*) - count(called.id) AS dead, coalesce(any_value(deps.d), 0) AS dependencies FROM f LEFT JOIN tested ON tested.id = f.id LEFT JOIN called ON called.id = f.id LEFT JOIN deps ON deps.file_path = f.file_path WHERE NOT f.test GROUP BY 1)", links=True))
_STEM = r"regexp_replace(split_part(file_path, '/', -1), '\.[^.]*$', '')"
add("health_scores_links", analytics.health_by_links, graph_sql(
    "SELECT p.file_path, round(0.35 * coalesce(covered, 0) + 0.25 * (1 - least(p.k / 50, 1.0)) + 0.25 * (1 - coalesce(coupling, 0)) + 0.15 * (1 - p.dk / p.k), 6) AS score, coalesce(covered, 0.0) AS covered, round(coalesce(coupling, 0), 6) AS coupling, round(p.dk / p.k, 6) AS dead_ratio "
    "FROM p LEFT JOIN links ON links.file_path = p.file_path LEFT JOIN tested ON tested.stem = p.stem",
    _DEAD,
    f"p AS (SELECT n.file_path, any_value({_STEM.replace('file_path', 'n.file_path')}) AS stem, count(*) AS k, count(dead.id) AS dk FROM n LEFT JOIN dead ON dead.id = n.id WHERE n.file_path IS NOT NULL GROUP BY 1)",
    "tested AS (SELECT DISTINCT unnest([regexp_replace(stem, '^test_|_?[tT]est$', '', 'g'), stem]) AS stem, 1.0 AS covered FROM p WHERE stem LIKE '%test%')",
    "links AS (SELECT a.file_path, avg((a.file_path <> b.file_path)::INT) AS coupling FROM (SELECT DISTINCT source, target FROM l) k JOIN n a ON a.id = k.source JOIN n b ON b.id = k.target WHERE b.file_path IS NOT NULL GROUP BY 1)", links=True))
add("test_coverage", analytics.coverage, graph_sql(
    "SELECT file_path, count(*) AS functions, count(hit.id) AS covered, round(count(hit.id) / count(*) * 100, 4) AS percent FROM f LEFT JOIN hit ON hit.id = f.id WHERE NOT test GROUP BY 1",
    _FT, "hit AS (SELECT DISTINCT l.target AS id FROM l JOIN f ON f.id = l.source WHERE l.kind = 'calls' AND f.test)", links=True))


def _tests_sql(strict: bool) -> str:
    calls, imports = (0.8, 0.5) if strict else (0.5, 0.8)
    return graph_sql(
        "SELECT test_id, source_id, confidence, derivation FROM (SELECT *, row_number() OVER (PARTITION BY test_id, source_id ORDER BY confidence DESC, derivation DESC) AS rn FROM every) WHERE rn = 1",
        _FT,
        rf"t AS (SELECT id AS test_id, regexp_replace(name, '^[tT]est_?|_?[tT]est$', '', 'g') AS about, regexp_replace({_STEM}, '^test_|_test$|Test$', '', 'g') AS file FROM f WHERE test AND name IS NOT NULL)",
        rf"p AS (SELECT id AS source_id, name AS about, {_STEM} AS file FROM f WHERE NOT test AND name IS NOT NULL)",
        f"every AS (SELECT test_id, source_id, 0.9 AS confidence, 'naming' AS derivation FROM t JOIN p ON p.about = t.about {'AND p.file = t.file' if strict else ''} WHERE t.about <> '' "
        f"UNION ALL SELECT DISTINCT t.test_id, p.source_id, {calls}, 'calls' FROM l JOIN t ON t.test_id = l.source JOIN p ON p.source_id = l.target WHERE l.kind = 'calls' "
        f"UNION ALL SELECT DISTINCT t.test_id, p.source_id, {imports}, 'imports' FROM l JOIN t ON t.test_id = l.source JOIN p ON p.source_id = l.target WHERE l.kind = 'imports')", links=True)  # fmt: skip


add("test_edges", lambda g: analytics.test_links(g, True), _tests_sql(True))
add("test_edges_names", lambda g: analytics.test_links(g, False), _tests_sql(False))

add("naming_match", lambda g: analytics.test_links(g, False).filter("derivation = 'naming'").select("test_id", "source_id"), graph_sql(
    "SELECT test_id, source_id FROM t JOIN p ON p.about = t.about WHERE t.about <> ''", _FT,
    r"t AS (SELECT id AS test_id, regexp_replace(name, '^[tT]est_?|_?[tT]est$', '', 'g') AS about FROM f WHERE test AND name IS NOT NULL)", "p AS (SELECT id AS source_id, name AS about FROM f WHERE NOT test AND name IS NOT NULL)"))

# --- change ---

_CALLS = ("calls", "references", "imports")


def _walk(depth: int) -> tuple[str, str]:
    return f"walk AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT w.seed, h.b, w.depth + 1 FROM walk w JOIN hop h ON h.a = w.id WHERE w.depth < {depth})", "bfs AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"


add("impact_prediction", lambda g, s, d: analytics.impact_prediction(g, _removed(g, s, d)), graph_sql(
    "SELECT seed, direct, indirect, files, coalesce(fan, 0) AS fan_out, least((direct + indirect) * 5 + coalesce(fan, 0) * 10 + indirect * 3 + files * 2, 100)::BIGINT AS risk FROM ("
    f"SELECT seed, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect, count(DISTINCT n.file_path) FILTER (NOT {TEST.format('n.file_path')}) AS files FROM bfs JOIN n ON n.id = bfs.id GROUP BY 1) x "
    "LEFT JOIN (SELECT source, count(DISTINCT target) AS fan FROM l WHERE kind IN ('calls', 'references', 'imports') GROUP BY 1) y ON y.source = x.seed",
    _SEEDS, _hop(_CALLS, "in"), *_walk(3), links=True, recursive=True), whole=True)


def _todo(s: SparkSession, d: str) -> DataFrame:
    return increment.paths_to_index(*(table(s, d, t) for t in ("files", "runs", "file_listing"))).select(F.col("path").alias("file_path"))


def _hunks(s: SparkSession, d: str) -> DataFrame:
    """Of each file the next run indexes, its lines 5 to 25."""
    return _todo(s, d).select("file_path", F.lit(5).alias("first"), F.lit(25).alias("last"))


def _todo_sql() -> list[str]:
    from graphloom.plans.general import _INDEX_SQL

    return [_INDEX_SQL.strip().removeprefix("WITH ")]


add("diff_hunk_overlap", lambda g, s, d: analytics.changed_symbols(g, _hunks(s, d)), graph_sql("SELECT id, file_path FROM n WHERE file_path IN (SELECT path FROM todo) AND start_line <= 25 AND end_line >= 5", *_todo_sql()), whole=True)
add("git_diff_impact", lambda g, s, d: analytics.change_impact(g, _todo(s, d)), graph_sql(
    "SELECT file_path, symbols, affected, CASE WHEN affected = 0 THEN 'none' WHEN affected <= 5 THEN 'low' WHEN affected <= 15 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT n.file_path, count(DISTINCT n.id) AS symbols, count(DISTINCT bfs.id) AS affected FROM n LEFT JOIN bfs ON bfs.seed = n.id WHERE n.file_path IN (SELECT path FROM todo) GROUP BY 1)",
    *_todo_sql(), "seeds AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM todo))", _hop(_CALLS, "in"), *_walk(2), links=True, recursive=True), whole=True)


def _review(g: PropertyGraph, s: SparkSession, d: str) -> DataFrame:
    """Changed files with their impact and the gates they fail."""
    gates = analytics.quality_gates(g)
    files = g.nodes("file_path").select(F.col("id").alias("subject"), "file_path")
    failed = gates.join(files, "subject").select("file_path", "gate").unionByName(gates.filter("gate = 'test_coverage'").select(F.col("subject").alias("file_path"), "gate"))
    failed = failed.groupBy("file_path").agg(F.concat_ws(",", F.sort_array(F.collect_set("gate"))).alias("gates"))
    return analytics.change_impact(g, _todo(s, d)).join(failed, "file_path", "left").fillna("", ["gates"])


_BASE = rf"regexp_replace({_STEM}, '^test_|_test$|Test$', '', 'g')"
_GATES = f"""files AS (SELECT DISTINCT file_path, {_BASE} AS base, {TEST.format('file_path')} AS test FROM n WHERE kind = 'file' AND file_path IS NOT NULL),
fc AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM l JOIN n a ON a.id = l.source JOIN n b ON b.id = l.target WHERE l.kind = 'calls' AND a.file_path <> b.file_path),
gates AS (SELECT 'complexity' AS gate, id AS subject FROM n WHERE kind IN ('function', 'method') AND end_line - start_line > 50
  UNION ALL SELECT 'test_coverage', file_path FROM files WHERE NOT test AND base NOT IN (SELECT base FROM files WHERE test)
  UNION ALL SELECT 'dependency_direction', x.a || ' <> ' || x.b FROM fc x JOIN fc y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b)"""
add("quality_gate", analytics.quality_gates, graph_sql("SELECT * FROM gates", _GATES, links=True))
add("review_changes", _review, graph_sql(
    "SELECT x.file_path, symbols, affected, CASE WHEN affected = 0 THEN 'none' WHEN affected <= 5 THEN 'low' WHEN affected <= 15 THEN 'medium' ELSE 'high' END AS risk, coalesce(g.gates, '') AS gates FROM (SELECT n.file_path, count(DISTINCT n.id) AS symbols, count(DISTINCT bfs.id) AS affected FROM n LEFT JOIN bfs ON bfs.seed = n.id WHERE n.file_path IN (SELECT path FROM todo) GROUP BY 1) x "
    "LEFT JOIN (SELECT file_path, string_agg(DISTINCT gate, ',' ORDER BY gate) AS gates FROM (SELECT n.file_path, gate FROM gates JOIN n ON n.id = subject UNION ALL SELECT subject, gate FROM gates WHERE gate = 'test_coverage') GROUP BY 1) g ON g.file_path = x.file_path",
    *_todo_sql(), _GATES, "seeds AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM todo))", _hop(_CALLS, "in"), *_walk(2), links=True, recursive=True), whole=True)


def _refactor(g: PropertyGraph, s: SparkSession, d: str) -> DataFrame:
    """What keeps each removed symbol from going safely: its direct users and whether tests cover them."""
    users = traverse.bfs(g.links(*_CALLS), _removed(g, s, d), "in", 1).join(g.nodes("file_path"), "id")
    per = users.groupBy("seed").agg(F.count("*").alias("users"), F.count(F.when(analytics.is_test(F.col("file_path")), 1)).alias("tests"))
    return per.withColumn("advice", F.when(F.col("tests") > 0, "tests guard the change").otherwise("add tests first"))


add("safe_refactor", _refactor, graph_sql(
    f"SELECT seed, count(*) AS users, count(*) FILTER ({TEST.format('n.file_path')}) AS tests, CASE WHEN count(*) FILTER ({TEST.format('n.file_path')}) > 0 THEN 'tests guard the change' ELSE 'add tests first' END AS advice FROM bfs JOIN n ON n.id = bfs.id GROUP BY 1",
    _SEEDS, _hop(_CALLS, "in"), *_walk(1), links=True, recursive=True), whole=True)

# --- data flow: symbols that read feed symbols that write, along calls ---


def _roles(g: PropertyGraph, depth: int = 2) -> DataFrame:
    src = g.edges(kinds=["reads"]).select(F.col("source").alias("id")).distinct()
    snk = g.edges(kinds=["writes"]).select(F.col("source").alias("id")).distinct()
    return analytics.taint(g.links("calls"), src.join(g.nodes(), "id", "left_semi"), snk, depth)


add("taint_roles", _roles, graph_sql(
    "SELECT seed AS source, id AS sink, depth FROM bfs WHERE id IN (SELECT source FROM e WHERE kind = 'writes')",
    "seeds AS (SELECT DISTINCT source AS id FROM e WHERE kind = 'reads' AND source IN (SELECT id FROM n))", _hop(("calls",), "out"), *_walk(2), links=True, recursive=True))
_ENDS = lambda words: " OR ".join(f"ends_with(qualified_name, '{w}')" for w in words)
# the vocabularies, and what this data calls its sources and sinks
_SRC, _SNK = (*analytics.TAINT_SOURCES, "Snapshot", "snapshot"), (*analytics.TAINT_SINKS, "Report", "report")
add("taint_paths", lambda g: analytics.taint(g.links("reads", "writes", "calls"), analytics.named_like(g, _SRC), analytics.named_like(g, _SNK), 2), graph_sql(
    f"SELECT seed AS source, id AS sink, depth FROM bfs WHERE id IN (SELECT id FROM n WHERE {_ENDS(_SNK)})",
    f"seeds AS (SELECT id FROM n WHERE {_ENDS(_SRC)})", _hop(("reads", "writes", "calls"), "out"), *_walk(2), links=True, recursive=True))
# the same at the depth of the operator, five links
add("taint_roles_full", lambda g: _roles(g, 5), SQL["taint_roles"].replace(_walk(2)[0], _walk(5)[0]))
add("taint_paths_full", lambda g: analytics.taint(g.links("reads", "writes", "calls"), analytics.named_like(g, _SRC), analytics.named_like(g, _SNK), 5), SQL["taint_paths"].replace(_walk(2)[0], _walk(5)[0]))
add("dataflow_closure", lambda g: traverse.closure(g.links("reads", "writes"), 3), graph_sql(
    "SELECT a AS source, b AS target, min(d) AS depth FROM (SELECT a, b, 1 AS d FROM hop UNION ALL SELECT x.a, y.b, 2 FROM hop x JOIN hop y ON y.a = x.b UNION ALL SELECT x.a, z.b, 3 FROM hop x JOIN hop y ON y.a = x.b JOIN hop z ON z.a = y.b) WHERE a <> b GROUP BY ALL HAVING min(d) > 1", _hop(("reads", "writes"), "out"), links=True))
add("dataflow_chains", lambda g: traverse.chains(g.links("reads", "writes"), 3), graph_sql(
    "SELECT a || '>' || b AS path, 2 AS length FROM hop WHERE a IN (SELECT id FROM root) UNION SELECT x.a || '>' || x.b || '>' || y.b, 3 FROM hop x JOIN hop y ON y.a = x.b WHERE x.a IN (SELECT id FROM root) AND x.a <> x.b", _hop(("reads", "writes"), "out"), "root AS (SELECT a AS id FROM hop EXCEPT SELECT b FROM hop)", links=True))

# --- references, files ---

_CLASS = r"""refs AS (SELECT eid, starts_with(target_text, '<external>') AS ext, regexp_extract(target_text, '^[^:]*:(.*)$', 1) AS q, regexp_extract(target_text, '([A-Za-z_]\w*)\W*$', 1) AS nm
  FROM e WHERE trim(target_text) <> '' AND (target IS NULL OR target NOT IN (SELECT id FROM n))),
bq AS (SELECT qualified_name AS q, min(id) AS q_id FROM n GROUP BY 1), bn AS (SELECT name AS nm, min(id) AS n_id FROM n GROUP BY 1 HAVING count(*) = 1),
cls AS (SELECT eid, CASE WHEN ext THEN 'external' WHEN q_id IS NOT NULL THEN 'qualified_name' WHEN n_id IS NOT NULL THEN 'unique_name' ELSE 'unknown' END AS class, CASE WHEN NOT ext THEN coalesce(q_id, n_id) END AS id FROM refs LEFT JOIN bq USING (q) LEFT JOIN bn USING (nm))"""
add("classify_refs", analytics.classify_references, graph_sql("SELECT * FROM cls", _CLASS))
add("resolve_refs", analytics.resolve_references, graph_sql("SELECT eid, id AS target, CASE WHEN id IS NOT NULL THEN 'resolved' WHEN class = 'external' THEN 'external' ELSE 'unresolved' END AS provenance FROM cls", _CLASS))


def invalidation(spark: SparkSession, d: str) -> DataFrame:
    """Analysis records of the last successful indexing against what is on disk."""
    saved = increment.indexed_state(table(spark, d, "files"), table(spark, d, "runs"))
    return analytics.staleness(saved, increment.current_state(table(spark, d, "file_listing")))


QUERIES["invalidation"] = invalidation
SQL["invalidation"] = "WITH " + _todo_sql()[0] + " SELECT coalesce(n.path, d.path) AS path, CASE WHEN n.path IS NULL OR n.m IS NULL THEN 'gone' WHEN d.path IS NULL THEN 'new' WHEN d.m = 0 THEN 'baseline' WHEN n.m IS NOT DISTINCT FROM d.m THEN 'fresh' ELSE 'stale' END AS state FROM now n FULL JOIN done d ON d.path = n.path"
add("consistency_report", lambda g, s, d: analytics.consistency(g, table(s, d, "files")), graph_sql(
    "SELECT path, 'no record' AS problem FROM (SELECT DISTINCT file_path AS path FROM n WHERE kind IN ('function', 'method', 'class', 'file') AND file_path IS NOT NULL) WHERE path NOT IN (SELECT path FROM files WHERE path IS NOT NULL) "
    "UNION ALL SELECT path, 'no symbols' FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) WHERE path NOT IN (SELECT file_path FROM n WHERE kind IN ('function', 'method', 'class', 'file') AND file_path IS NOT NULL)"), whole=True)  # fmt: skip

# --- bodies ---


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The look-ahead of the rules, spelled for an engine without it: no quote next but for blanks, one later in the line.
_PLAIN = lambda p: "(?i)" + p.replace(r"""(?!\s*["'])(.+?)["']""", r"""[^\S\n]*[^\s"'][^\n]*?["']""")
_RULES_SQL = " UNION ALL ".join(
    f"SELECT id, '{c}' AS category, CASE " + " ".join(f"WHEN regexp_matches(body, {_quoted(_PLAIN(p))}) THEN '{s}'" for k, s, p in analytics.SECURITY_RULES if k == c) + " END AS severity FROM b"
    for c in dict.fromkeys(k for k, _, _ in analytics.SECURITY_RULES)
)
add("security_scan", analytics.security_findings, graph_sql(
    f"SELECT id, category, severity FROM ({_RULES_SQL} UNION ALL SELECT id, 'path_traversal', CASE WHEN regexp_matches(body, {_quoted(analytics.PATH_CONCAT)}) AND regexp_matches(body, {_quoted(analytics.FILE_CALL)}) THEN 'high' END FROM b) WHERE severity IS NOT NULL",
    "b AS (SELECT id, body FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL)"))
add("find_pattern", lambda g: analytics.find_structure(g, "for_loop"), graph_sql(
    f"SELECT id, file_path, start_line FROM (SELECT id, file_path, start_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS LAST, id) AS k FROM n WHERE regexp_matches(body, {_quoted(analytics.STRUCTURES['for_loop'])})) WHERE k <= 5"))


def _complexity(g: PropertyGraph) -> DataFrame:
    f = analytics.functions(g, "body", "language").filter("body is not null").withColumn("t", code.words_and_signs(F.col("body")))
    lang = F.coalesce(F.lower("language"), F.lit(""))
    volume, difficulty = code.halstead(F.col("t"), lang)
    lines = F.size(F.split(F.regexp_replace("body", r"\n$", ""), "\n"))
    return f.select("id", code.cyclomatic(F.col("t"), lang).alias("cyclomatic"), lines.alias("lines"), F.round(volume, 6).alias("volume"), F.round(difficulty, 6).alias("difficulty"), F.round(volume * difficulty, 4).alias("effort"))


_OPS, _NOT = code.among_sql("x", code.OPERATORS, code.OPERATORS_OF), _in(code.NO_OPERANDS)
_CYCLOMATIC = f"1 + len(list_filter(t, lambda x: {code.among_sql('x', (*code.DECISIONS, '&&', '||', '?'), code.DECISIONS_OF)})) + len(list_filter(t, lambda x: {code.among_sql('x', (), code.CASES_OF)}))"
add("complexity", _complexity, graph_sql(
    rf"""SELECT id, {_CYCLOMATIC} AS cyclomatic, lines,
    round(v, 6) AS volume, round(d, 6) AS difficulty, round(v * d, 4) AS effort FROM (
      SELECT *, CASE WHEN n1 + n2 > 0 THEN (len(o) + len(w)) * log2(n1 + n2) ELSE 0 END AS v, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / 2 * (len(w) / n2) ELSE 0 END AS d FROM (
        SELECT *, len(list_distinct(o)) AS n1, len(list_distinct(w)) AS n2 FROM (
          SELECT *, list_filter(t, lambda x: {_OPS}) AS o, list_filter(t, lambda x: NOT {_OPS} AND x NOT IN ({_NOT}) AND regexp_full_match(x, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM (
            SELECT id, coalesce(lower(language), '') AS lang, regexp_extract_all(body, {_quoted(code.WORD_OR_SIGN)}, 1) AS t, len(string_split(regexp_replace(body, '\n$', ''), chr(10))) AS lines
            FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL))))"""))  # fmt: skip


def _cognitive(g: PropertyGraph) -> DataFrame:
    f = analytics.functions(g, "body", "language").filter("body is not null").withColumn("t", code.words_and_signs(F.col("body")))
    lang = F.coalesce(F.lower("language"), F.lit(""))
    f = f.select("id", code.cyclomatic(F.col("t"), lang).alias("cyclomatic"), code.cognitive(F.col("t"), lang).alias("cognitive"))
    return f.withColumn("risk", code.risk_level(F.col("cyclomatic"), F.col("cognitive")))


_CODES = f"""CASE WHEN x IN ('{{', 'begin', 'do') THEN 1 WHEN x IN ('}}', 'end', 'endfunction', 'endif') THEN 2 WHEN x = ':' AND lang = 'python' THEN 1
  WHEN {code.among_sql('x', code.DECISIONS, code.DECISIONS_OF)} AND {code.among_sql('x', code.LOOPS, code.LOOPS_OF)} THEN 5 WHEN {code.among_sql('x', code.DECISIONS, code.DECISIONS_OF)} OR {code.among_sql('x', code.LOOPS, code.LOOPS_OF)} THEN 4
  WHEN x IN ('&&', '||') THEN 7 WHEN x IN ('break', 'continue') THEN 8 ELSE 0 END"""
# the fold keeps score and depth in one number: 100000 * score + depth
add("complexity_risk", _cognitive, graph_sql(
    rf"""SELECT id, cyclomatic, cognitive, (['low', 'medium', 'high', 'critical'])[greatest(CASE WHEN cyclomatic <= 5 THEN 1 WHEN cyclomatic <= 10 THEN 2 WHEN cyclomatic <= 20 THEN 3 ELSE 4 END, CASE WHEN cognitive <= 5 THEN 1 WHEN cognitive <= 15 THEN 2 WHEN cognitive <= 30 THEN 3 ELSE 4 END)] AS risk FROM (
      SELECT id, {_CYCLOMATIC} AS cyclomatic,
        list_reduce(list_transform(t, lambda x: ({_CODES})::BIGINT), lambda a, c: CASE c WHEN 1 THEN a + 1 WHEN 2 THEN a - (a % 100000 > 0)::BIGINT WHEN 4 THEN a + 100000 * (1 + a % 100000) WHEN 5 THEN a + 200000 * (1 + a % 100000) WHEN 7 THEN a + 100000 WHEN 8 THEN a + 100000 * (a % 100000) ELSE a END, 0::BIGINT) // 100000 AS cognitive
      FROM (SELECT id, coalesce(lower(language), '') AS lang, regexp_extract_all(body, {_quoted(code.WORD_OR_SIGN)}, 1) AS t FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL))"""))  # fmt: skip
_TOKENS_SQL = rf"""tok AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(coalesce(body, ''), '(?m)#.*$', '', 'g'), {_quoted(code.TOKEN)}, 1), lambda t: CASE WHEN regexp_matches(t, '^["'']') THEN 'S' WHEN regexp_matches(t, '^\d') THEN 'N' WHEN t IN ({_in(code.KEPT_KEYWORDS)}) THEN t WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'I' ELSE t END) AS tokens
  FROM n WHERE kind IN ('function', 'method') AND body IS NOT NULL)"""
add("ast_tokens", lambda g: analytics.functions(g, "body").filter("body is not null").select("id", F.concat_ws(" ", code.ast_tokens(F.col("body"))).alias("tokens")), graph_sql("SELECT id, array_to_string(tokens, ' ') AS tokens FROM tok", _TOKENS_SQL))


def api_compat(spark: SparkSession, d: str) -> DataFrame:
    return analytics.api_changes(table(spark, d, "node_snapshots"))


QUERIES["api_compat"] = api_compat
SQL["api_compat"] = r"""WITH o AS (SELECT snap, qualified_name, max(regexp_replace(coalesce(signature, ''), '\s+', '', 'g')) AS s FROM node_snapshots WHERE qualified_name IS NOT NULL GROUP BY ALL),
x AS (SELECT b.snap, b.qualified_name, regexp_extract(a.s, '\(([^)]*)\)', 1) AS p, regexp_extract(b.s, '\(([^)]*)\)', 1) AS q FROM o a JOIN o b ON b.snap = a.snap + 1 AND b.qualified_name = a.qualified_name WHERE a.s <> b.s AND a.s <> '' AND b.s <> ''),
y AS (SELECT snap, qualified_name, CASE WHEN trim(p) = '' THEN 0 ELSE len(string_split(p, ',')) END AS before, CASE WHEN trim(q) = '' THEN 0 ELSE len(string_split(q, ',')) END AS after FROM x)
SELECT snap, qualified_name, before, after, CASE WHEN after < before THEN 'major' WHEN after > before THEN 'minor' ELSE 'patch' END AS bump FROM y"""
