"""Queries in Cypher: operators, expressions and aggregates of the language over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import cypher
from graphloom.graph import PropertyGraph
from graphloom.plans.base import Query, graph_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str, sql: str, params: dict | None = None, rename: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = cypher.query(PropertyGraph.load(spark, d), text, params)
        return out.withColumnsRenamed(rename) if rename else out

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = graph_sql(sql)


_OUT = "FROM n a JOIN e r ON r.source = a.id JOIN n b ON b.id = r.target"

_add("cy_scan", "MATCH (c:class) RETURN c.id AS id, c.name AS name", "SELECT id, name FROM n WHERE kind = 'class'")
_add("cy_filter", "MATCH (f:function) WHERE f.start_line > 40 AND f.language = 'python' RETURN f.id AS id, f.start_line AS line", "SELECT id, start_line AS line FROM n WHERE kind = 'function' AND start_line > 40 AND language = 'python'")
_add("cy_expand_out", "MATCH (a:function)-[r:calls]->(b) RETURN a.id AS a, b.id AS b, r.id AS edge", f"SELECT a.id AS a, b.id AS b, r.eid AS edge {_OUT} WHERE a.kind = 'function' AND r.kind = 'calls'")
_add("cy_expand_in", "MATCH (a:function)<-[r:calls]-(b) RETURN a.id AS a, b.id AS b, r.id AS edge", "SELECT a.id AS a, b.id AS b, r.eid AS edge FROM n a JOIN e r ON r.target = a.id JOIN n b ON b.id = r.source WHERE a.kind = 'function' AND r.kind = 'calls'")
_add(
    "cy_expand_both",
    "MATCH (a:class)-[r:references]-(b) RETURN a.id AS a, b.id AS b, r.id AS edge",
    f"SELECT a.id AS a, b.id AS b, r.eid AS edge {_OUT} WHERE a.kind = 'class' AND r.kind = 'references' UNION ALL "
    "SELECT a.id, b.id, r.eid FROM n a JOIN e r ON r.target = a.id JOIN n b ON b.id = r.source WHERE a.kind = 'class' AND r.kind = 'references' AND r.source <> r.target",
)
_add(
    "cy_expand_optional",
    "MATCH (c:class) OPTIONAL MATCH (c)-[:extends]->(p) RETURN c.id AS class, p.id AS parent",
    "SELECT c.id AS class, p.id AS parent FROM n c LEFT JOIN (SELECT r.source, b.id FROM e r JOIN n b ON b.id = r.target WHERE r.kind = 'extends') p ON p.source = c.id WHERE c.kind = 'class'",
)
_add(
    "cy_two_hop",
    "MATCH (a:class)-[:contains]->(b:method)-[:calls]->(c) RETURN a.id AS a, b.id AS b, c.id AS c",
    "SELECT a.id AS a, b.id AS b, c.id AS c FROM n a JOIN e r ON r.source = a.id JOIN n b ON b.id = r.target JOIN e s ON s.source = b.id JOIN n c ON c.id = s.target WHERE a.kind = 'class' AND r.kind = 'contains' AND b.kind = 'method' AND s.kind = 'calls'",
)
_add(
    "cy_var_length",
    "MATCH (a:module)-[:contains*1..3]->(b) RETURN a.id AS a, b.id AS b, b.kind AS kind",
    "SELECT a.id AS a, b.id AS b, b.kind FROM n a JOIN (WITH k AS (SELECT DISTINCT source, target FROM e WHERE kind = 'contains' AND source <> target) "
    "SELECT source AS s, target AS t FROM k UNION ALL SELECT x.source, y.target FROM k x JOIN k y ON y.source = x.target WHERE y.target <> x.source "
    "UNION ALL SELECT x.source, z.target FROM k x JOIN k y ON y.source = x.target JOIN k z ON z.source = y.target WHERE y.target <> x.source AND z.target <> x.source AND z.target <> x.target) p "
    "ON p.s = a.id JOIN n b ON b.id = p.t WHERE a.kind = 'module'",
)
_add("cy_project", "MATCH (c:class) RETURN c.name, c.language AS lang", 'SELECT name AS "c.name", language AS lang FROM n WHERE kind = \'class\'')
_add("cy_sort", "MATCH (c:class) RETURN c.name AS name, c.framework AS framework, c.id AS id ORDER BY c.framework DESC, c.name, c.id LIMIT 50", "SELECT name, framework, id FROM n WHERE kind = 'class' ORDER BY framework DESC NULLS FIRST, name NULLS LAST, id LIMIT 50")
_add("cy_skip_limit", "MATCH (f:function) RETURN f.id AS id ORDER BY f.id SKIP 8 LIMIT 5", "SELECT id FROM n WHERE kind = 'function' ORDER BY id LIMIT 5 OFFSET 8")
_add("cy_distinct", "MATCH (a:function)-[:calls]->(b) RETURN DISTINCT b.language AS language, b.kind AS kind", f"SELECT DISTINCT b.language, b.kind {_OUT} WHERE a.kind = 'function' AND r.kind = 'calls'")
_add("cy_agg", "MATCH (c:class)-[:contains]->(m:method) RETURN c.id AS class, count(*) AS methods, min(m.start_line) AS first", f"SELECT a.id AS class, count(*) AS methods, min(b.start_line) AS first {_OUT} WHERE a.kind = 'class' AND r.kind = 'contains' AND b.kind = 'method' GROUP BY a.id")
_add("cy_agg_empty", "MATCH (c:no_such_kind) RETURN count(*) AS rows", "SELECT count(*) AS rows FROM n WHERE kind = 'no_such_kind' HAVING count(*) > 0")
_add("cy_union", "MATCH (c:class) RETURN c.name AS name UNION MATCH (f:function) RETURN f.name AS name", "SELECT name FROM n WHERE kind = 'class' UNION SELECT name FROM n WHERE kind = 'function'")
_add("cy_union_all", "MATCH (c:class) RETURN c.name AS name UNION ALL MATCH (m:module) RETURN m.name AS name", "SELECT name FROM n WHERE kind = 'class' UNION ALL SELECT name FROM n WHERE kind = 'module'")
_add("cy_unwind", "UNWIND ['class', 'function', 'class'] AS k RETURN k, count(*) AS times", "SELECT k, count(*) AS times FROM (SELECT unnest(['class', 'function', 'class']) AS k) GROUP BY k")
_add("cy_exists", "MATCH (f:function) WHERE EXISTS { MATCH (f)<-[:test_edge]-(t) } RETURN f.id AS id", "SELECT id FROM n f WHERE kind = 'function' AND EXISTS (SELECT 1 FROM e r JOIN n t ON t.id = r.source WHERE r.target = f.id AND r.kind = 'test_edge')")
_add("cy_not_exists", "MATCH (f:function) WHERE NOT EXISTS { MATCH (f)<-[:calls]-(t) } RETURN f.id AS id", "SELECT id FROM n f WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM e r JOIN n t ON t.id = r.source WHERE r.target = f.id AND r.kind = 'calls')")
_add(
    "cy_exists_or",
    "MATCH (f:method) WHERE EXISTS { MATCH (f)-[:writes]->(t) } OR f.visibility = 'private' RETURN f.id AS id",
    "SELECT id FROM n f WHERE kind = 'method' AND (EXISTS (SELECT 1 FROM e r JOIN n t ON t.id = r.target WHERE r.source = f.id AND r.kind = 'writes') OR coalesce(f.visibility = 'private', false))",
)
_add("cy_with", "MATCH (f:function) WITH f.language AS lang, f.end_line - f.start_line AS len WHERE len > 10 RETURN lang, count(*) AS n", "SELECT language AS lang, count(*) AS n FROM n WHERE kind = 'function' AND end_line - start_line > 10 GROUP BY 1")
_add("cy_with_agg", "MATCH (a)-[:calls]->(b:function) WITH b.id AS callee, count(*) AS calls WHERE calls >= 5 RETURN callee, calls", f"SELECT b.id AS callee, count(*) AS calls {_OUT} WHERE r.kind = 'calls' AND b.kind = 'function' GROUP BY 1 HAVING count(*) >= 5")
_add("cy_far_label", "MATCH (a:function)-[:instantiates]->(b:class) RETURN a.id AS a, b.id AS b", f"SELECT a.id AS a, b.id AS b {_OUT} WHERE a.kind = 'function' AND b.kind = 'class' AND r.kind = 'instantiates'")
_add("cy_inline_props", "MATCH (a {language: 'go'})-[r:calls {provenance: 'resolved'}]->(b) RETURN a.id AS a, b.id AS b", f"SELECT a.id AS a, b.id AS b {_OUT} WHERE a.language = 'go' AND r.kind = 'calls' AND r.provenance = 'resolved'")
_add("cy_params", "MATCH (f:function) WHERE f.language IN $langs AND f.start_line >= $line RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'function' AND language IN ('java', 'go') AND start_line >= 30", {"langs": ["java", "go"], "line": 30})
_add("cy_multi_pattern", "MATCH (a:class)-[:contains]->(m:method), (a)-[:extends]->(p) RETURN a.id AS a, m.id AS m, p.id AS p", "SELECT a.id AS a, m.id AS m, p.id AS p FROM n a JOIN e r ON r.source = a.id AND r.kind = 'contains' JOIN n m ON m.id = r.target AND m.kind = 'method' JOIN e s ON s.source = a.id AND s.kind = 'extends' JOIN n p ON p.id = s.target WHERE a.kind = 'class'")


def cy_return_star(spark: SparkSession, d: str) -> DataFrame:
    """RETURN * gives whole nodes; two of their fields are compared."""
    out = cypher.query(PropertyGraph.load(spark, d), "MATCH (c:class)-[:contains]->(m:method) RETURN *")
    return out.select(F.col("c.id").alias("class"), F.col("c.name").alias("class_name"), F.col("m.id").alias("method"), F.col("m.signature").alias("signature"))


QUERIES["cy_return_star"] = cy_return_star
SQL["cy_return_star"] = graph_sql(f"SELECT a.id AS class, a.name AS class_name, b.id AS method, b.signature {_OUT} WHERE a.kind = 'class' AND r.kind = 'contains' AND b.kind = 'method'")

# --- expressions: null is false, also behind NOT and <> ---

_add("ex_and_or_xor_not", "MATCH (f:function) WHERE (f.is_exported = 1 AND NOT f.framework = 'x') XOR (f.visibility = 'private' OR f.docstring IS NULL) RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'function' AND (coalesce(is_exported = 1, false) AND NOT coalesce(framework = 'x', false)) <> (coalesce(visibility = 'private', false) OR docstring IS NULL)")
_add("ex_compare", "MATCH (f:method) WHERE f.framework <> 'none' OR f.start_line <= 12 AND f.end_line >= 15 RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'method' AND (coalesce(framework <> 'none', false) OR coalesce(start_line <= 12, false) AND coalesce(end_line >= 15, false))")
_add("ex_arith", "MATCH (c:class) RETURN c.id AS id, (c.end_line - c.start_line) * 2 AS twice, c.end_line / 4 AS quarter, (0 - c.start_line) % 7 AS modulo, c.start_line ^ 2 AS square, c.name + '!' AS shout", "SELECT id, (end_line - start_line) * 2 AS twice, end_line / 4 AS quarter, ((0 - start_line) % 7 + 7) % 7 AS modulo, start_line ** 2 AS square, name || '!' AS shout FROM n WHERE kind = 'class'")
_add("ex_regex", "MATCH (f:function) WHERE f.name =~ '^(load|save|parse)' RETURN f.id AS id, f.name AS name", "SELECT id, name FROM n WHERE kind = 'function' AND regexp_matches(name, '^(load|save|parse)')")
_add("ex_starts_ends", "MATCH (f:function) WHERE f.name STARTS WITH 'merge' OR f.name ENDS WITH 'node' RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'function' AND (coalesce(starts_with(name, 'merge'), false) OR coalesce(ends_with(name, 'node'), false))")
_add("ex_contains", "MATCH (f:function) WHERE f.docstring CONTAINS 'rows' RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'function' AND contains(docstring, 'rows')")
_add("ex_in", "MATCH (f) WHERE f.kind IN ['class', 'method'] AND NOT f.language IN ['go', 'java'] RETURN f.id AS id", "SELECT id FROM n WHERE coalesce(kind IN ('class', 'method'), false) AND NOT coalesce(language IN ('go', 'java'), false)")
_add("ex_is_null", "MATCH (f:function) WHERE f.docstring IS NULL AND f.signature IS NOT NULL RETURN f.id AS id", "SELECT id FROM n WHERE kind = 'function' AND docstring IS NULL AND signature IS NOT NULL")
_add("ex_neg", "MATCH (f:function) RETURN f.id AS id, -f.start_line AS line", "SELECT id, -start_line AS line FROM n WHERE kind = 'function'")
_add("ex_case", "MATCH (f:method) RETURN f.id AS id, CASE f.framework WHEN null THEN 'bare' ELSE 'framed' END AS simple, CASE WHEN f.start_line < 20 THEN 'top' WHEN f.start_line < 60 THEN 'middle' END AS searched", "SELECT id, CASE WHEN framework IS NULL THEN 'bare' ELSE 'framed' END AS simple, CASE WHEN start_line < 20 THEN 'top' WHEN start_line < 60 THEN 'middle' END AS searched FROM n WHERE kind = 'method'")
_add("ex_list", "MATCH (c:class) RETURN c.id AS id, [c.name, c.language] AS pair", "SELECT id, [name, language] AS pair FROM n WHERE kind = 'class'")
_add("ex_prop", "MATCH (c:class) RETURN c.id AS id, c.no_such_property AS missing, c.visibility AS visibility", "SELECT id, NULL AS missing, visibility FROM n WHERE kind = 'class'")
_add("fn_toupper", "MATCH (c:class) RETURN c.id AS id, toUpper(c.name) AS v", "SELECT id, upper(name) AS v FROM n WHERE kind = 'class'")
_add("fn_tolower", "MATCH (c:class) RETURN c.id AS id, toLower(c.name) AS v", "SELECT id, lower(name) AS v FROM n WHERE kind = 'class'")
_add("fn_tostring", "MATCH (c:class) RETURN c.id AS id, toString(c.start_line) AS v", "SELECT id, start_line::VARCHAR AS v FROM n WHERE kind = 'class'")
_add("fn_coalesce", "MATCH (f:function) RETURN f.id AS id, coalesce(f.framework, f.visibility, '-') AS v", "SELECT id, coalesce(framework, visibility, '-') AS v FROM n WHERE kind = 'function'")
_add("fn_type", "MATCH (c:class) RETURN c.id AS id, type(c.name) AS a, type(c.start_line) AS b, type(c) AS c", "SELECT id, CASE WHEN name IS NOT NULL THEN 'str' END AS a, CASE WHEN start_line IS NOT NULL THEN 'int' END AS b, 'dict' AS c FROM n WHERE kind = 'class'")

# --- aggregates ---

_add("agg_count_star", "MATCH (a)-[r]->(b) RETURN b.kind AS kind, count(*) AS n", f"SELECT b.kind, count(*) AS n {_OUT} GROUP BY 1")
_add("agg_count_expr", "MATCH (f:function) RETURN f.language AS language, count(f.docstring) AS n", "SELECT language, count(docstring) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_count_distinct", "MATCH (f:function) RETURN f.language AS language, count(DISTINCT f.file_path) AS n", "SELECT language, count(DISTINCT file_path) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_sum", "MATCH (f:function) RETURN f.language AS language, sum(f.end_line - f.start_line) AS n", "SELECT language, coalesce(sum(end_line - start_line), 0) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_avg", "MATCH (f:function) RETURN f.language AS language, avg(f.start_line) AS n", "SELECT language, avg(start_line) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_min", "MATCH (f:function) RETURN f.language AS language, min(f.name) AS n", "SELECT language, min(name) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_max", "MATCH (f:function) RETURN f.language AS language, max(f.name) AS n", "SELECT language, max(name) AS n FROM n WHERE kind = 'function' GROUP BY 1")
_add("agg_collect", "MATCH (c:class)-[:contains]->(m:method) RETURN c.id AS class, collect(m.name) AS methods", f"SELECT a.id AS class, list(b.name ORDER BY b.name NULLS FIRST) AS methods {_OUT} WHERE a.kind = 'class' AND r.kind = 'contains' AND b.kind = 'method' GROUP BY 1")


def udf_register(spark: SparkSession, d: str) -> DataFrame:
    """A registered scalar function, built from columns, in a query."""
    if "basename" not in cypher.binder._FUNCTIONS:
        cypher.register_function("basename", lambda c: F.element_at(F.split(c, "/"), -1))
    return cypher.query(PropertyGraph.load(spark, d), "MATCH (f:file) RETURN f.id AS id, basename(f.file_path) AS base")


def udaf_register(spark: SparkSession, d: str) -> DataFrame:
    """A registered aggregate in a query."""
    if "spread" not in cypher.binder._AGGREGATES:
        cypher.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    return cypher.query(PropertyGraph.load(spark, d), "MATCH (f:function) RETURN f.file_path AS file, spread(f.start_line) AS lines")


QUERIES |= {"udf_register": udf_register, "udaf_register": udaf_register}
SQL["udf_register"] = graph_sql("SELECT id, split_part(file_path, '/', -1) AS base FROM n WHERE kind = 'file'")
SQL["udaf_register"] = graph_sql("SELECT file_path AS file, max(start_line) - min(start_line) AS lines FROM n WHERE kind = 'function' GROUP BY 1")
