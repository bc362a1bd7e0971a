"""Queries of scans, writes, exports, the FIND language, traversal and graph algorithms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import gql
from graphloom.graph import PropertyGraph
from graphloom.operators import algorithms, storage, traverse
from graphloom.plans.base import Query, graph_sql
from graphloom.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[PropertyGraph], DataFrame], sql: str | None = None) -> None:
    """A query over the loaded graph, and what states its result."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(PropertyGraph.load(spark, d))

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# --- scans ---

add("scan_all_nodes", lambda g: g.nodes("kind", "name", "file_path"), graph_sql("SELECT id, kind, name, file_path FROM n"))
add("scan_nodes_by_kind", lambda g: g.nodes("kind", "name").filter("kind = 'method'"), graph_sql("SELECT id, kind, name FROM n WHERE kind = 'method'"))
add("scan_nodes_by_file", lambda g: g.nodes("file_path", "name", "start_line").filter("file_path like 'harbor-mono/web00/%'"), graph_sql("SELECT id, file_path, name, start_line FROM n WHERE file_path LIKE 'harbor-mono/web00/%'"))
add("scan_edges", lambda g: storage.edges_with_source(g).withColumnRenamed("id", "eid"), graph_sql("SELECT e.eid, e.source, e.target, e.kind, n.file_path AS source_file, n.language AS source_language FROM e JOIN n ON n.id = e.source"))
add("node_lookup", lambda g: g.nodes("name").join(g.edges(kinds=["test_edge"]).select(F.col("target").alias("id")).distinct(), "id", "left_semi"), graph_sql("SELECT id, name FROM n WHERE id IN (SELECT target FROM e WHERE kind = 'test_edge')"))


def _between(g: PropertyGraph) -> DataFrame:
    """All edges from members of one file to members of another, for each pair of files linked by an import."""
    f = g.nodes("file_path")
    e = g.edges("id", kinds=["imports"]).join(f.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source").join(f.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target")
    return e.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("edges"))


add("edges_between", _between, graph_sql("SELECT a.file_path AS a, b.file_path AS b, count(*) AS edges FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND a.file_path <> b.file_path GROUP BY ALL"))
add("dangling_edges", lambda g: storage.dangling_edges(g, "calls").select(F.col("id").alias("eid"), "source", "target_text"), graph_sql("SELECT eid, source, target_text FROM e WHERE kind = 'calls' AND trim(target_text) <> '' AND (target IS NULL OR target NOT IN (SELECT id FROM n))"))
add("def_index", storage.def_index, graph_sql("SELECT qualified_name, max(id) AS id FROM n WHERE qualified_name IS NOT NULL GROUP BY 1"))
add("resolve_name", lambda g: storage.resolve_name(g, "vendors"), graph_sql("SELECT id, name, qualified_name FROM n WHERE name = 'vendors' OR qualified_name = 'vendors' ORDER BY (qualified_name = 'vendors')::INT DESC, id LIMIT 1"))
add(
    "scope_filter",
    lambda g: g.nodes("file_path").filter(storage.in_scope(F.col("file_path"), ["**/*.py", "*.go"], ["**/vendors/**", "*test*"])),
    graph_sql("SELECT id, file_path FROM n WHERE (file_path LIKE '%.py' OR file_path LIKE '%.go') AND NOT (file_path LIKE '%/vendors/%' OR split_part(file_path, '/', -1) LIKE '%test%') AND contains(file_path, '/')"),
)
add("graph_stats", storage.graph_stats, graph_sql(
    "SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'files', count(DISTINCT file_path) FROM n UNION ALL SELECT 'edges', count(*) FROM e "
    "UNION ALL SELECT 'unresolved', count(*) FROM e WHERE trim(target_text) <> '' AND (target IS NULL OR target NOT IN (SELECT id FROM n)) "
    "UNION ALL SELECT 'language ' || coalesce(language, '?'), count(*) FROM n GROUP BY 1"
))
add("edge_kind_distribution", lambda g: g.edges("id").groupBy("kind").agg(F.count("*").alias("edges")), graph_sql("SELECT kind, count(*) AS edges FROM e GROUP BY 1"))


# --- writes ---


def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Rows from before mid-2025 are the store, later ones are merged in."""
    n = table(spark, d, "nodes").filter("id is not null").select(F.lower(F.trim("id")).alias("id"), "name", "file_path", "updated_at")
    cut = 1_750_000_000_000
    return storage.upsert_nodes(n.filter(F.col("updated_at") < cut), n.filter(F.col("updated_at") >= cut)).select("id", "name", "file_path")


def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that no delivery of April 2025 or later has are the store; all that were seen since, known or new, are merged in. Sources without a node are dropped."""
    g = PropertyGraph.load(spark, d)
    e = table(spark, d, "edges")
    late = F.coalesce(F.col("seen_at") >= F.lit("2025-04-01").cast("timestamp"), F.lit(False))
    part = lambda rows: PropertyGraph(table(spark, d, "nodes"), rows).edges("id", "target_text")
    return storage.upsert_edges(part(e.filter(~late)), part(e.filter(late)), g.nodes())


QUERIES |= {"upsert_nodes": upsert_nodes, "upsert_edges": upsert_edges}
SQL["upsert_nodes"] = graph_sql("SELECT id, name, file_path FROM n")
SQL["upsert_edges"] = graph_sql("SELECT DISTINCT source, target, target_text, kind FROM e WHERE source IN (SELECT id FROM n)")

add("export_json", lambda g: storage.export_json(g).groupBy("what").agg(F.count("*").alias("lines"), F.countDistinct("line").alias("different")), graph_sql(
    "SELECT 'node' AS what, count(*) AS lines, count(*) AS different FROM n WHERE id IN (SELECT source FROM l) OR id IN (SELECT target FROM l) UNION ALL SELECT 'edge', count(*), count(*) FROM (SELECT DISTINCT source, target FROM l)", links=True))
add("export_dot", lambda g: storage.export_dot(g.nodes("name"), g.links("extends")), graph_sql(
    "SELECT '  \"' || id || '\" [label=\"' || regexp_replace(coalesce(name, ''), '([\"\\\\])', '\\\\\\1', 'g') || '\"];' AS line FROM n UNION ALL SELECT DISTINCT '  \"' || source || '\" -> \"' || target || '\";' FROM l WHERE kind = 'extends'", links=True))
add("export_mermaid", lambda g: storage.export_mermaid(g.nodes("name", "file_path"), g.links("extends"), True), graph_sql(
    "SELECT '  n' || id || '[\"' || split_part(coalesce(file_path, ''), '/', -1) || ': ' || regexp_replace(regexp_replace(coalesce(name, ''), '[(\\[{]', '[', 'g'), '[)\\]}]', ']', 'g') || '\"]' AS line FROM n "
    "UNION ALL SELECT DISTINCT '  n' || source || ' --> n' || target FROM l WHERE kind = 'extends'", links=True))  # fmt: skip

# --- FIND language ---

add("gql_scan", lambda g: gql.query(g, "FIND class RETURN id, name"), graph_sql("SELECT id, name FROM n WHERE kind = 'class'"))
add("gql_find", lambda g: gql.query(g, "FIND function WHERE language = 'go' RETURN id, name, start_line ORDER BY start_line DESC, id LIMIT 20"), graph_sql("SELECT id, name, start_line FROM n WHERE kind = 'function' AND language = 'go' ORDER BY start_line DESC NULLS LAST, id LIMIT 20"))
add("gql_matches", lambda g: gql.query(g, "FIND method WHERE name MATCHES 'CACHE'"), graph_sql("SELECT id, kind, name, qualified_name, file_path, language FROM n WHERE kind = 'method' AND name ILIKE '%CACHE%'"))
add("gql_compare", lambda g: gql.query(g, "FIND function WHERE start_line >= 20 AND end_line < 60 AND visibility != 'public' RETURN id"), graph_sql("SELECT id FROM n WHERE kind = 'function' AND start_line >= 20 AND end_line < 60 AND visibility <> 'public'"))
add("gql_bool", lambda g: gql.query(g, "FIND WHERE NOT (kind = 'file' OR kind = 'package' OR framework = 'x') RETURN id"), graph_sql("SELECT id FROM n WHERE NOT (kind = 'file' OR kind = 'package' OR framework = 'x')"))

_HUB = "SELECT target AS id FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
_FAN = "SELECT source AS id FROM l WHERE kind <> 'contains' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


def _hub(g: PropertyGraph) -> str:
    """The node most links lead to."""
    ids = g.nodes()
    e = g.edges().filter("target is not null").select("source", "target", "kind").distinct().join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()[0]


def _fan(g: PropertyGraph) -> str:
    """The node most links leave from, containment aside."""
    ids = g.nodes()
    e = g.edges().filter("target is not null and kind <> 'contains'").select("source", "target", "kind").distinct().join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return e.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()[0]


add("gql_impact", lambda g: gql.query(g, f"IMPACT '{_hub(g)}'"), graph_sql(f"SELECT n.id, n.name, n.kind, n.file_path, e.kind AS edge_kind FROM e JOIN n ON n.id = e.source WHERE e.target = ({_HUB})", links=True))
add("gql_calls_out", lambda g: gql.query(g, f"CALLS '{_fan(g)}'"), graph_sql(f"SELECT n.id, n.name, n.kind, n.file_path, e.kind AS edge_kind FROM e JOIN n ON n.id = e.target WHERE e.source = ({_FAN})", links=True))
add("gql_calls_in", lambda g: gql.query(g, f"CALLS '{_hub(g)}' --inbound"), graph_sql(f"SELECT n.id, n.name, n.kind, n.file_path, e.kind AS edge_kind FROM e JOIN n ON n.id = e.source WHERE e.target = ({_HUB})", links=True))


def gql_trace(g: PropertyGraph) -> DataFrame:
    """From the node with most outgoing links to the smallest node that is two links away."""
    a = _fan(g)
    two = traverse.bfs(g.links(), g.nodes().filter(F.col("id") == a), "out", 2).filter("depth = 2").agg(F.min("id")).first()[0]
    return gql.query(g, f"TRACE '{a}' '{two}'")


add("gql_trace", gql_trace, graph_sql(
    "SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM walk WHERE id = (SELECT id FROM b)",
    "d AS (SELECT DISTINCT source, target FROM l WHERE source <> target)", f"a AS ({_FAN})", "one AS (SELECT target AS id FROM d WHERE source = (SELECT id FROM a))",
    "two AS (SELECT DISTINCT target AS id FROM d WHERE source IN (SELECT id FROM one) AND target <> (SELECT id FROM a) AND target NOT IN (SELECT id FROM one))", "b AS (SELECT min(id) AS id FROM two)",
    "back AS (SELECT id, 0 AS k FROM b UNION SELECT d.source, k + 1 FROM back JOIN d ON d.target = back.id WHERE k < 9)", "near AS (SELECT id, min(k) AS k FROM back GROUP BY 1)",
    "walk AS (SELECT id, [id] AS path FROM a UNION ALL SELECT d.target, list_append(w.path, d.target) FROM walk w JOIN d ON d.source = w.id JOIN near ON near.id = d.target "
    "WHERE w.id <> (SELECT id FROM b) AND NOT list_contains(w.path, d.target) AND len(w.path) + near.k <= 10)",
    links=True, recursive=True))

# --- traversal; seeds are the removed symbols: what their removal touches ---


def _removed(g: PropertyGraph, spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tombstones").select(F.lower(F.trim("node_id")).alias("id")).distinct()
    return t.join(g.nodes(), "id", "left_semi")


def add_seeded(name: str, run: Callable[[PropertyGraph, DataFrame], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        g = PropertyGraph.load(spark, d)
        return run(g, _removed(g, spark, d))

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = sql


_CALLS = ("calls", "references", "imports")
_SEEDS = "seeds AS (SELECT DISTINCT lower(trim(node_id)) AS id FROM tombstones WHERE lower(trim(node_id)) IN (SELECT id FROM n))"


def _hop(kinds: tuple[str, ...], direction: str) -> str:
    where = f"WHERE kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    out, back = f"SELECT source AS a, target AS b FROM l {where}", f"SELECT target AS a, source AS b FROM l {where}"
    return f"hop AS ({ {'out': f'SELECT DISTINCT a, b FROM ({out})', 'in': f'SELECT DISTINCT a, b FROM ({back})', 'both': f'{out} UNION {back}'}[direction]})"


def _bfs_sql(kinds: tuple[str, ...], direction: str, depth: int, select: str = "SELECT seed, id, depth FROM bfs") -> str:
    walk = f"walk AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT w.seed, h.b, w.depth + 1 FROM walk w JOIN hop h ON h.a = w.id WHERE w.depth < {depth})"
    return graph_sql(select, _SEEDS, _hop(kinds, direction), walk, "bfs AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)", links=True, recursive=True)


for _way, _dir in (("outbound", "out"), ("inbound", "in"), ("both", "both")):
    add_seeded(f"calls_{_way}", lambda g, s, x=_dir: traverse.bfs(g.links(*_CALLS), s, x, 1), _bfs_sql(_CALLS, _dir, 1))


def _impact(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    found = traverse.bfs(g.links(*_CALLS), seeds, "in", 3).join(g.nodes("file_path"), "id")
    return found.groupBy("seed", "file_path").agg(F.count("*").alias("symbols"), F.min("depth").alias("depth"))


add_seeded("impact_radius", _impact, _bfs_sql(_CALLS, "in", 3, "SELECT seed, file_path, count(*) AS symbols, min(depth) AS depth FROM bfs JOIN n ON n.id = bfs.id GROUP BY ALL"))
add_seeded("k_hop", lambda g, s: traverse.bfs(g.links(), s, "out", 2), _bfs_sql((), "out", 2))
add_seeded("reachable", lambda g, s: traverse.reachable(g.links("calls"), s), graph_sql("SELECT id FROM reach", _SEEDS, _hop(("calls",), "out"), "reach AS (SELECT id FROM seeds UNION SELECT h.b FROM reach r JOIN hop h ON h.a = r.id)", links=True, recursive=True))


def _paths(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """From each removed symbol to each class."""
    near = traverse.bfs(g.links(*_CALLS), seeds, "out", 3).join(g.nodes("kind").filter("kind = 'class'"), "id", "left_semi")
    return traverse.shortest_paths(g.links(*_CALLS), near.select(F.col("seed").alias("source"), F.col("id").alias("target")), 3)


add_seeded("shortest_path", _paths, graph_sql(
    "SELECT seed AS source, id AS target, length, path FROM (SELECT seed, id, min(depth) AS length, min_by(path, depth || path) AS path FROM walk GROUP BY ALL HAVING min(depth) > 0) WHERE id IN (SELECT id FROM n WHERE kind = 'class')",
    _SEEDS, _hop(_CALLS, "out"), "walk AS (SELECT id AS seed, id, 0 AS depth, id AS path FROM seeds UNION SELECT w.seed, h.b, w.depth + 1, w.path || '>' || h.b FROM walk w JOIN hop h ON h.a = w.id WHERE w.depth < 3)", links=True, recursive=True))
add_seeded("neighbors", lambda g, s: traverse.neighbors(g.edges().join(g.nodes().withColumnRenamed("id", "target"), "target", "left_semi").join(g.nodes().withColumnRenamed("id", "source"), "source", "left_semi"), s), graph_sql(
    "SELECT seed, id, kind, way FROM (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY o, kind) AS rn FROM (SELECT source AS seed, target AS id, kind, 'out' AS way, 0 AS o FROM l UNION ALL SELECT target, source, kind, 'in', 1 FROM l) WHERE seed IN (SELECT id FROM seeds)) WHERE rn = 1",
    _SEEDS, links=True))
add("graph_counts", lambda g: (lambda x: x.select(F.col("source").alias("id")).unionByName(x.select(F.col("target").alias("id"))).agg(F.countDistinct("id").alias("nodes"), (F.count("*") / 2).cast("long").alias("links")))(g.links()), graph_sql(
    "SELECT (SELECT count(*) FROM (SELECT source FROM l UNION SELECT target FROM l)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM l)) AS links", links=True))

# --- algorithms ---


def _pagerank_sql(rounds: int) -> str:
    parts = ["c AS (SELECT DISTINCT source, target FROM l WHERE kind = 'calls')", "deg AS (SELECT source, count(*) AS degree FROM c GROUP BY 1)", "num AS (SELECT count(*)::DOUBLE AS k FROM n)", "r0 AS MATERIALIZED (SELECT id, 1.0 / k AS rank FROM n, num)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT n.id, 0.15 / k + 0.85 * coalesce((SELECT sum(rank) FROM r{i-1} WHERE id NOT IN (SELECT source FROM deg)), 0) / k + 0.85 * coalesce(g.got, 0) AS rank FROM n CROSS JOIN num LEFT JOIN "
            f"(SELECT c.target AS id, sum(r.rank / deg.degree) AS got FROM c JOIN deg ON deg.source = c.source JOIN r{i-1} r ON r.id = c.source GROUP BY 1) g ON g.id = n.id)"
        )
    return graph_sql(f"SELECT id, round(rank, 9) AS rank FROM r{rounds}", *parts, links=True)


add("pagerank", lambda g: algorithms.pagerank(g.nodes(), g.links("calls"), rounds=5).select("id", F.round("rank", 9).alias("rank")), _pagerank_sql(5))


def _labels_sql(rounds: int) -> str:
    parts = ["hop AS (SELECT source AS a, target AS b FROM l WHERE source <> target UNION SELECT target, source FROM l WHERE source <> target)", "c0 AS MATERIALIZED (SELECT id, id AS community FROM n)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"c{i} AS MATERIALIZED (SELECT p.id, coalesce(v.community, p.community) AS community FROM c{i-1} p LEFT JOIN (SELECT a AS id, community, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, community) AS rn "
            f"FROM hop JOIN c{i-1} q ON q.id = hop.b GROUP BY a, community) v ON v.id = p.id AND v.rn = 1)"
        )
    return graph_sql(f"SELECT id, community FROM c{rounds}", *parts, links=True)


add("communities", lambda g: algorithms.label_propagation(g.nodes(), g.links(), 3), _labels_sql(3))
add("cycle_nodes", lambda g: algorithms.cycle_nodes(g.links("contains", "calls")), graph_sql(
    "SELECT DISTINCT a AS id FROM reach WHERE a = b", _hop(("contains", "calls"), "out"), "reach AS (SELECT a, b FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b)", links=True, recursive=True))
add("cycles_k", lambda g: algorithms.cycles_up_to(g.links("calls"), 3), graph_sql(
    "SELECT a AS cycle, 1 AS length FROM hop WHERE a = b UNION ALL SELECT x.a || '>' || x.b, 2 FROM hop x JOIN hop y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b "
    "UNION ALL SELECT x.a || '>' || x.b || '>' || y.b, 3 FROM hop x JOIN hop y ON y.a = x.b JOIN hop z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b", _hop(("calls",), "out"), links=True))  # fmt: skip
add("betweenness", lambda g: algorithms.betweenness(g.links("calls"), g.nodes("kind").filter("kind = 'class'"), 3).select("id", F.round("score", 6).alias("score")), graph_sql(
    """SELECT v AS id, round(sum(delta), 6) AS score FROM (SELECT v, delta FROM b2 UNION ALL SELECT v, delta FROM b1 UNION ALL SELECT v, 0.0 FROM s3) GROUP BY 1""",
    "hop AS (SELECT DISTINCT source AS a, target AS b FROM l WHERE kind = 'calls' AND source <> target)",
    "s0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM n WHERE kind = 'class')",
    "s1 AS MATERIALIZED (SELECT s, b AS v, sum(sigma) AS sigma FROM s0 JOIN hop ON a = v WHERE (s, b) NOT IN (SELECT (s, v) FROM s0) GROUP BY ALL)",
    "s2 AS MATERIALIZED (SELECT s, b AS v, sum(sigma) AS sigma FROM s1 JOIN hop ON a = v WHERE (s, b) NOT IN (SELECT (s, v) FROM s0 UNION ALL SELECT (s, v) FROM s1) GROUP BY ALL)",
    "s3 AS MATERIALIZED (SELECT s, b AS v, sum(sigma) AS sigma FROM s2 JOIN hop ON a = v WHERE (s, b) NOT IN (SELECT (s, v) FROM s0 UNION ALL SELECT (s, v) FROM s1 UNION ALL SELECT (s, v) FROM s2) GROUP BY ALL)",
    "b2 AS MATERIALIZED (SELECT x.s, x.v, coalesce((SELECT sum(x.sigma / y.sigma) FROM hop JOIN s3 y ON y.v = hop.b WHERE hop.a = x.v AND y.s = x.s), 0) AS delta, x.sigma FROM s2 x)",
    "b1 AS MATERIALIZED (SELECT x.s, x.v, coalesce((SELECT sum(x.sigma / y.sigma * (1 + y.delta)) FROM hop JOIN b2 y ON y.v = hop.b WHERE hop.a = x.v AND y.s = x.s), 0) AS delta FROM s1 x)", links=True))
