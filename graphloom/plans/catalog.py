"""All queries of the core: general operators and the graph engine's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom import cypher
from graphloom.graph import PropertyGraph
from graphloom.plans import analytics_queries, cypher_queries, general, graph_queries, search_queries, state_queries


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The symbols most functions call."""
    text = "MATCH (f:function)-[:calls]->(g) RETURN g.qualified_name AS symbol, count(*) AS calls ORDER BY calls DESC, symbol LIMIT 10"
    return cypher.query(PropertyGraph.load(spark, d), text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**general.QUERIES, **cypher_queries.QUERIES, **graph_queries.QUERIES, **analytics_queries.QUERIES, **search_queries.QUERIES, **state_queries.QUERIES}
SQL: dict[str, str] = {**general.SQL, **cypher_queries.SQL, **graph_queries.SQL, **analytics_queries.SQL, **search_queries.SQL, **state_queries.SQL}
