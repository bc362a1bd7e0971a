"""Scans, lookups, writes and exports of a property graph.

Null ids and sources are dropped by the graph; null names become empty labels in exports; empty tables give empty results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not; without a slash it fits any file name."""
    out = re.escape(glob)
    for a, b in ((r"\*\*/", "(?:.*/)?"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]")):
        out = out.replace(a, b)
    return ("^" if "/" in glob else "(?:^|.*/)") + out + "$"


def in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any include fits (if there are some), then no exclude does. A null path is out of every scope."""
    ok = F.lit(True)
    if include:
        ok = path.rlike("|".join(glob_regex(g) for g in include))
    if exclude:
        ok = ok & ~path.rlike("|".join(glob_regex(g) for g in exclude))
    return F.coalesce(ok & path.isNotNull(), F.lit(False))


def edges_with_source(graph: PropertyGraph) -> DataFrame:
    nodes = graph.nodes("file_path", "language").select(F.col("id").alias("source"), F.col("file_path").alias("source_file"), F.col("language").alias("source_language"))
    return graph.edges("id").join(nodes, "source")


def dangling_edges(graph: PropertyGraph, kind: str | None = None) -> DataFrame:
    """Edges with a text behind their target that lead to no node."""
    e = graph.edges("id", "target_text", kinds=[kind] if kind else None).filter("trim(target_text) <> ''")
    return e.join(graph.nodes().withColumnRenamed("id", "target"), "target", "left_anti")


def def_index(graph: PropertyGraph) -> DataFrame:
    """qualified_name -> id; of several nodes with a name the largest id."""
    return graph.nodes("qualified_name").filter("qualified_name is not null").groupBy("qualified_name").agg(F.max("id").alias("id"))


def resolve_name(graph: PropertyGraph, name: str) -> DataFrame:
    """The node a name means: an id, a qualified or plain name, or Class.method; the smallest id of the best form."""
    n = graph.nodes("name", "qualified_name")
    owner, _, method = name.rpartition(".")
    by_method = (F.col("name") == method) & F.contains("qualified_name", F.lit(owner)) if owner else F.lit(False)
    form = F.when(F.col("id") == name.strip().lower(), 0).when(F.col("qualified_name") == name, 1).when(by_method, 2).when(F.col("name") == name, 3)
    return n.withColumn("form", form).filter("form is not null").orderBy("form", "id").limit(1).select("id", "name", "qualified_name")


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """metric, value: nodes, files, edges, unresolved edges and nodes by language."""
    n = graph.nodes("file_path", "language")
    e = graph.edges("id", "target_text")
    open_ = dangling_edges(graph)
    parts = [
        n.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), "value"),
        n.agg(F.countDistinct("file_path").alias("value")).select(F.lit("files").alias("metric"), "value"),
        e.agg(F.count("*").alias("value")).select(F.lit("edges").alias("metric"), "value"),
        open_.agg(F.count("*").alias("value")).select(F.lit("unresolved").alias("metric"), "value"),
        n.groupBy(F.concat(F.lit("language "), F.coalesce("language", F.lit("?"))).alias("metric")).agg(F.count("*").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- writes ---


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same id; of several new ones the highest updated_at holds; rows without id are dropped."""
    cols = old.columns
    old, new = old.filter("id is not null"), new.filter("id is not null")
    all_ = old.withColumn("_gen", F.lit(0)).unionByName(new.select(*cols).withColumn("_gen", F.lit(1)))
    return all_.groupBy("id").agg(F.max_by(F.struct(*[c for c in cols if c != "id"]), F.struct("_gen", F.coalesce("updated_at", F.lit(-1)))).alias("r")).select("id", "r.*")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``paths`` (file_path), and without the edges that start at them."""
    gone = nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("source"))
    return nodes.join(paths, "file_path", "left_anti"), edges.join(gone, "source", "left_anti")


def merge_properties(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: id, key, value. The JSON object in properties gets the keys; a repeated key takes the largest value."""
    kind = "map<string,string>"
    new = changes.filter("id is not null and key is not null").groupBy("id", "key").agg(F.max("value").alias("value"))
    new = new.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("_new"))
    old = F.coalesce(F.from_json("properties", kind), F.create_map().cast(kind))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    joined = nodes.join(new, "id", "left")
    return joined.withColumn("properties", F.when(F.col("_new").isNull(), F.col("properties")).otherwise(F.to_json(F.map_concat(kept, "_new")))).drop("_new")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Union without repeats of (source, target, target_text, kind); edges whose source has no node are dropped."""
    key = ["source", "target", "target_text", "kind"]
    both = old.select(*key).unionByName(new.select(*key)).distinct()
    return both.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(*key)


# --- exports ---


def export_json(graph: PropertyGraph, limit: int = 0) -> DataFrame:
    """One JSON line for each node that touches a link, and for each link between such nodes; ``limit`` counts nodes in id order, 0 is all."""
    links = graph.links()
    touched = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    nodes = graph.nodes("kind", "name", "file_path").join(touched, "id", "left_semi")
    if limit:
        nodes = nodes.orderBy("id").limit(limit)
        ids = nodes.select("id")
        links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.select(F.lit("node").alias("what"), F.to_json(F.struct("id", "kind", "name", "file_path")).alias("line")).unionByName(
        links.select(F.lit("edge").alias("what"), F.to_json(F.struct("source", "target")).alias("line"))
    )


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '(["\\\\])', r"\\$1"), F.lit('"'))


def export_dot(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """line: statements of a DOT graph, nodes (id, name) then links; the caller adds the frame."""
    n = nodes.select(F.concat(F.lit("  "), _quoted("id"), F.lit(" [label="), _quoted("name"), F.lit("];")).alias("line"))
    return n.unionByName(links.select(F.concat(F.lit("  "), _quoted("source"), F.lit(" -> "), _quoted("target"), F.lit(";")).alias("line")))


def export_mermaid(nodes: DataFrame, links: DataFrame, grouped: bool = False) -> DataFrame:
    """line: statements of a Mermaid flowchart; aliases are ``n`` and the id, labels have their brackets escaped; ``grouped`` puts the file's base name before the label."""
    label = F.regexp_replace(F.coalesce("name", F.lit("")), r"[(\[{]", "[")
    label = F.regexp_replace(label, r"[)\]}]", "]")
    if grouped:
        label = F.concat(F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1), F.lit(": "), label)
    n = nodes.select(F.concat(F.lit("  n"), F.col("id"), F.lit('["'), label, F.lit('"]')).alias("line"))
    return n.unionByName(links.select(F.concat(F.lit("  n"), F.col("source"), F.lit(" --> n"), F.col("target")).alias("line")))


def snapshot_create(graph: PropertyGraph, folder: str, name: str) -> None:
    """A full copy under a name; an existing one is replaced."""
    graph.nodes(*graph.node_types).write.mode("overwrite").parquet(f"{folder}/{name}/nodes")
    graph.edges("id", "target_text", "provenance").write.mode("overwrite").parquet(f"{folder}/{name}/edges")


def snapshot_list(spark, folder: str) -> list[str]:
    """Names under the folder, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
