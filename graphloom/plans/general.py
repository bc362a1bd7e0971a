"""Queries of the general data-preparation operators (p2, p3, p4, p6) and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, increment, orphans, snapshots
from graphloom.sources.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.contains_links(table(spark, d, "nodes"), table(spark, d, "edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots(_links(spark, d))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d)).select("node_id", "root_id", "depth", F.concat_ws("/", "path").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_edges(*(table(spark, d, t) for t in ("nodes", "edges", "tombstones", "externals")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "month_seen").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return (
        _orphans(spark, d)
        .groupBy(F.lit("edges").alias("table_name"), "month_seen", F.when(F.col("null_mask").startswith("1"), "target").otherwise("target_text").alias("key_used"))
        .agg(F.countDistinct("edge_id").alias("orphans"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return increment.paths_to_index(*(table(spark, d, t) for t in ("files", "runs", "file_listing"))).select("path").distinct()


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    return increment.paths_to_index(*(table(spark, d, t) for t in ("files", "runs", "file_listing"))).groupBy("change").agg(F.count("*").alias("paths"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n, e = table(spark, d, "node_snapshots"), table(spark, d, "edge_snapshots")
    return snapshots.changes(snapshots.graph_items(n, e), snapshots.snap_numbers(n, e))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("snap", "entity", "change_kind").agg(F.count("*").alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_report, p4_found, p4_changes, p6_found, p6_summary)
}

_LINKS_SQL = """
ids AS (SELECT DISTINCT lower(trim(id)) AS id FROM nodes WHERE id IS NOT NULL),
links AS (
  SELECT lower(trim(target)) AS child, min(lower(trim(source))) AS parent FROM edges
  WHERE lower(trim(kind)) = 'contains' AND lower(trim(source)) IN (SELECT id FROM ids) AND lower(trim(target)) IN (SELECT id FROM ids)
  GROUP BY 1),
ends AS (SELECT child AS node_id FROM links UNION SELECT parent FROM links),
tops AS (SELECT node_id FROM ends WHERE node_id NOT IN (SELECT child FROM links))
"""
_TREE_SQL = f"""
WITH RECURSIVE {_LINKS_SQL},
tree AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM tops
  UNION ALL
  SELECT l.child, t.root_id, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN links l ON l.parent = t.node_id)
"""
_ORPHAN_SQL = """
WITH gone AS (SELECT lower(trim(node_id)) AS id, max(removed_at) AS at FROM tombstones GROUP BY 1),
rows_ AS (SELECT lower(trim(id)) AS id, max(updated_at) AS updated_at FROM nodes WHERE id IS NOT NULL GROUP BY 1),
alive AS (
  SELECT r.id FROM rows_ r LEFT JOIN gone g ON g.id = r.id WHERE g.id IS NULL OR epoch_us(g.at) < r.updated_at * 1000
  UNION SELECT lower(trim(id)) FROM externals WHERE id IS NOT NULL),
refs AS (
  SELECT id AS edge_id, coalesce(strftime(seen_at, '%Y-%m'), 'unknown') AS month_seen, trim(coalesce(target, '')) <> '' AS by_id,
    CASE WHEN trim(coalesce(target, '')) <> '' THEN lower(trim(target)) WHEN trim(coalesce(target_text, '')) <> '' THEN substr(sha256(target_text), 1, 32) END AS ref
  FROM edges),
orphan AS (SELECT DISTINCT edge_id, month_seen, by_id FROM refs WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM alive))
"""
_INDEX_SQL = """
WITH ok AS (SELECT started_at, finished_at FROM runs WHERE lower(trim(status)) IN ('success', 'ok') AND finished_at IS NOT NULL),
done AS (
  SELECT path, arg_max(nullif(regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+:', ''), ''), indexed_at) AS h, arg_max(size, indexed_at) AS s,
    arg_max(CASE WHEN modified_at > 100000000000 THEN modified_at // 1000 ELSE modified_at END, indexed_at) AS m
  FROM files WHERE EXISTS (SELECT 1 FROM ok WHERE indexed_at BETWEEN started_at AND finished_at) GROUP BY path),
latest AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY listed_at DESC) AS rn FROM file_listing),
now AS (
  SELECT path, nullif(regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+:', ''), '') AS h, size AS s,
    CASE WHEN modified_at > 100000000000 THEN modified_at // 1000 ELSE modified_at END AS m FROM latest WHERE rn = 1),
todo AS (
  SELECT n.path, CASE WHEN d.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM now n LEFT JOIN done d ON d.path = n.path
  WHERE d.path IS NULL OR CASE WHEN n.h IS NOT NULL THEN n.h IS DISTINCT FROM d.h ELSE n.s IS DISTINCT FROM d.s OR n.m IS DISTINCT FROM d.m END)
"""
_SNAP_SQL = r"""
WITH n AS (SELECT snap, qualified_name AS k, max(regexp_replace(coalesce(signature, ''), '\s', '', 'g')) AS v FROM node_snapshots WHERE qualified_name IS NOT NULL GROUP BY ALL),
e AS (SELECT DISTINCT snap, source_name || '>' || target_name || '>' || lower(trim(kind)) AS k FROM edge_snapshots),
found AS (
  SELECT b.snap, 'node' AS entity, b.k AS item_key, 'added' AS change_kind FROM n b WHERE b.snap > 1 AND NOT EXISTS (SELECT 1 FROM n a WHERE a.snap = b.snap - 1 AND a.k = b.k)
  UNION ALL SELECT a.snap + 1, 'node', a.k, 'removed' FROM n a WHERE a.snap < 4 AND NOT EXISTS (SELECT 1 FROM n b WHERE a.snap = b.snap - 1 AND a.k = b.k)
  UNION ALL SELECT b.snap, 'node', b.k, 'changed' FROM n a JOIN n b ON a.snap = b.snap - 1 AND a.k = b.k WHERE a.v <> b.v
  UNION ALL SELECT b.snap, 'edge', b.k, 'added' FROM e b WHERE b.snap > 1 AND b.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e a WHERE a.snap = b.snap - 1 AND a.k = b.k)
  UNION ALL SELECT a.snap + 1, 'edge', a.k, 'removed' FROM e a WHERE a.snap < 4 AND a.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e b WHERE a.snap = b.snap - 1 AND a.k = b.k))
"""

SQL: dict[str, str] = {
    "p2_found": _TREE_SQL + "SELECT node_id, root_id, depth FROM tree UNION ALL SELECT node_id, '', -1 FROM ends WHERE node_id NOT IN (SELECT node_id FROM tree)",
    "p2_paths": _TREE_SQL + "SELECT node_id, root_id, depth, path FROM tree",
    "p2_descendants": f"WITH RECURSIVE {_LINKS_SQL}, good AS (SELECT node_id FROM tops UNION SELECT l.child FROM good g JOIN links l ON l.parent = g.node_id), "
    "pairs AS (SELECT parent AS ancestor_id, child AS node_id, 1 AS distance FROM links WHERE parent IN (SELECT node_id FROM good) "
    "UNION ALL SELECT p.ancestor_id, l.child, p.distance + 1 FROM pairs p JOIN links l ON l.parent = p.node_id) SELECT * FROM pairs",
    "p3_found": _ORPHAN_SQL + "SELECT DISTINCT edge_id, month_seen FROM orphan",
    "p3_report": _ORPHAN_SQL
    + "SELECT 'edges' AS table_name, month_seen, CASE WHEN by_id THEN 'target' ELSE 'target_text' END AS key_used, count(DISTINCT edge_id) AS orphans FROM orphan GROUP BY ALL",
    "p4_found": _INDEX_SQL + "SELECT path FROM todo",
    "p4_changes": _INDEX_SQL + "SELECT change, count(*) AS paths FROM todo GROUP BY 1",
    "p6_found": _SNAP_SQL + "SELECT * FROM found",
    "p6_summary": _SNAP_SQL + "SELECT snap, entity, change_kind, count(*) AS items FROM found GROUP BY ALL",
}
