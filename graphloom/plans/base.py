"""What the SQL of all graph queries begins with, and how queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

NODES = """n AS (
  SELECT * REPLACE (lower(trim(id)) AS id, lower(trim(kind)) AS kind) FROM nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC) = 1)"""
EDGES = """e AS (
  SELECT DISTINCT id AS eid, lower(trim(source)) AS source,
    coalesce(nullif(lower(trim(target)), ''), CASE WHEN trim(target_text) <> '' THEN substr(sha256(target_text), 1, 32) END) AS target,
    lower(trim(kind)) AS kind, target_text, source_loc, provenance, properties
  FROM edges WHERE trim(source) <> '')"""
LINKS = """l AS (
  SELECT DISTINCT source, target, kind FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))"""


def graph_sql(body: str, *more: str, links: bool = False, recursive: bool = False) -> str:
    """``body`` behind the common table expressions of the graph (n, e, and l: links with both ends known)."""
    parts = [NODES, EDGES, *([LINKS] if links else []), *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{body}"
