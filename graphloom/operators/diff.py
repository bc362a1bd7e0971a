"""Differences of two states of a table by full outer join, and views over many repositories at once.

Null keys and paths are left out, a null value equals an empty one, repeated rows count once, an empty state has lost or gained all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import search, storage


def repo_of(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(0))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """key, change: added, removed or changed (``value`` differs; of several rows of a key the largest value holds)."""
    v = F.max(F.coalesce(value, F.lit(""))) if value else F.lit(1)
    a = before.dropna(subset=key).groupBy(*key).agg((v if value else F.max(F.lit(1))).alias("v1"))
    b = after.dropna(subset=key).groupBy(*key).agg((v if value else F.max(F.lit(1))).alias("v2"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("v1").isNull(), "added").when(F.col("v2").isNull(), "removed").when(F.col("v1") != F.col("v2"), "changed")
    return j.select(*key, change.alias("change")).filter("change is not null")


def fed_search(graph: PropertyGraph, query: str, limit: int = 200) -> DataFrame:
    """repo, id, place of the best ``limit`` hits of each repository."""
    from pyspark.sql import Window

    hits = search.search_text(graph, query, "file_path").filter("file_path is not null").select("id", F.round("rank", 9).alias("rank"), repo_of(F.col("file_path")).alias("repo"))
    w = Window.partitionBy("repo").orderBy(F.desc("rank"), "id")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("repo", "id", "place")


def fed_symbols(graph: PropertyGraph) -> DataFrame:
    """name, repo, symbols: names that stand in more than one repository."""
    n = graph.nodes("name", "file_path").filter("name is not null and file_path is not null").select("name", repo_of(F.col("file_path")).alias("repo"))
    per = n.groupBy("name", "repo").agg(F.count("*").alias("symbols"))
    shared = per.groupBy("name").agg(F.count("*").alias("repos")).filter("repos > 1")
    return per.join(shared, "name", "left_semi")


def fed_calls(graph: PropertyGraph) -> DataFrame:
    """repo, target_repo, references: dangling references whose last name is a symbol of another repository."""
    src = graph.nodes("file_path").select(F.col("id").alias("source"), repo_of(F.col("file_path")).alias("repo"))
    name = F.regexp_extract("target_text", r"([A-Za-z_]\w*)\W*$", 1)
    refs = storage.dangling_edges(graph).join(src, "source").select("id", "repo", name.alias("name")).filter("name <> ''")
    defs = graph.nodes("name", "file_path").select("name", repo_of(F.col("file_path")).alias("target_repo")).dropna().distinct()
    return refs.join(defs, "name").filter("repo <> target_repo").groupBy("repo", "target_repo").agg(F.count("*").alias("references"))


def fed_impact(graph: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """seed, repo, edges from other repositories that lead to each seed."""
    n = graph.nodes("file_path").select("id", repo_of(F.col("file_path")).alias("repo"))
    s = seeds.join(n, "id").select(F.col("id").alias("target"), F.col("repo").alias("own"))
    e = graph.edges("id").withColumnRenamed("id", "eid").join(s, "target").join(n.withColumnRenamed("id", "source"), "source")
    return e.filter("repo <> own").groupBy(F.col("target").alias("seed"), "repo").agg(F.count("*").alias("edges"))


def fed_unresolved(graph: PropertyGraph) -> DataFrame:
    src = graph.nodes("file_path").select(F.col("id").alias("source"), repo_of(F.col("file_path")).alias("repo"))
    return storage.dangling_edges(graph).join(src, "source").groupBy("repo").agg(F.count("*").alias("references"))
