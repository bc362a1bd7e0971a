"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, with loops recognised.

Method: a weighted disjoint-set forest (each entry keeps its distance to the entry it points at) is built over each
partition's links; the links between local roots are far fewer and are merged again in fewer partitions, until one
partition of proven size is left. Where the boundary stays too large for that, it is resolved by distributed pointer
doubling. Paths come from repeated traversal of the parent index, doubling its reach each time.

Defined results: null or blank ends are no link; exact repeats count once; a node given several parents keeps the
smallest id; a node linked to itself is a loop; nodes on a loop or below one get root '' and depth -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut, norm_id, norm_kind

#: Links one task may merge; two id strings, two integers each, some 250 bytes a link in Python.
TASK_LINKS = 1_000_000
#: Links from which the first level gives another task work.
SPREAD_LINKS = 20_000


class WeightedForest:
    """Disjoint sets over 0..n-1 whose entries know their distance to their root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.far = [0] * n
        self.loop: set[int] = set()

    def find(self, x: int) -> tuple[int, int]:
        up, far = self.up, self.far
        trail = []
        while up[x] != x:
            trail.append(x)
            x = up[x]
        total = 0
        for y in reversed(trail):
            total += far[y]
            up[y], far[y] = x, total
        return x, total

    def link(self, child: int, parent: int, weight: int) -> None:
        root, far = self.find(parent)
        if root == child:
            self.loop.add(child)
        else:
            self.up[child], self.far[child] = root, far + weight


def _merge_local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    links = pd.concat(frames, ignore_index=True)
    codes, names = pd.factorize(pd.concat([links["node"], links["ptr"]], ignore_index=True))
    n = len(links)
    forest = WeightedForest(len(names))
    child, parent, weight = codes[:n].tolist(), codes[n:].tolist(), links["off"].tolist()
    for c, p, w in zip(child, parent, weight):
        forest.link(c, p, w)
    ends = [forest.find(c) for c in child]
    lost = [r in forest.loop for r, _ in ends]
    yield pd.DataFrame({
        "node": links["node"],
        "ptr": ["" if x else names[r] for x, (r, _) in zip(lost, ends)],
        "off": [-1 if x else o for x, (_, o) in zip(lost, ends)],
    })


_LINK = "node string, ptr string, off long"


def _double(links: DataFrame) -> DataFrame:
    """Pointer doubling over links of any number. What points at a lost node (ptr '') is lost with it; what has not reached a root when
    2^rounds exceeds the rows is on or below a loop."""
    n = links.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        up = links.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"))
        lost = (F.col("ptr") == "") | (F.coalesce("ptr2", F.lit("-")) == "")
        links = cut(
            links.join(up, "ptr", "left").select(
                "node",
                F.when(lost, "").otherwise(F.coalesce("ptr2", "ptr")).alias("ptr"),
                F.when(lost, -1).otherwise(F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
                (F.col("ptr2").isNotNull() & ~lost).alias("open"),
            )
        )
        if links.filter("open").isEmpty():
            return links.select("node", "ptr", "off")
        links = links.drop("open")
    nodes = links.select(F.col("node").alias("ptr"))
    below = links.join(nodes, "ptr", "left_semi").select("node", F.lit("").alias("ptr"), F.lit(-1).cast("long").alias("off"))
    return links.join(nodes, "ptr", "left_anti").select("node", "ptr", "off").unionByName(below)


def _resolve(links: DataFrame, task_links: int, wide: int = 1) -> DataFrame:
    n = links.count()
    parts = max(1, math.ceil(n / task_links), min(wide, n // SPREAD_LINKS))
    local = cut(links.repartition(parts, "node").mapInPandas(_merge_local, _LINK))
    if parts == 1:
        return local
    roots = local.filter("ptr <> ''").select(F.col("ptr").alias("node")).distinct()
    boundary = cut(local.join(roots, "node", "left_semi"))
    left = boundary.count()
    if not left:
        return local
    top = _resolve(boundary, task_links) if math.ceil(left / task_links) < parts else _double(boundary)
    top = top.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"))
    joined = local.join(top, "ptr", "left")
    lost = (F.col("ptr") == "") | (F.coalesce("ptr2", F.lit("-")) == "")
    return joined.select(
        "node",
        F.when(lost, "").otherwise(F.coalesce("ptr2", "ptr")).alias("ptr"),
        F.when(lost, -1).otherwise(F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
    )


def roots(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``links``: child, parent (ids as they compare). Out: node_id, root_id, depth of every node that is an end of a link."""
    links = links.select("child", "parent").dropna()
    one = cut(links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("ptr")).withColumn("off", F.lit(1).cast("long")))
    found = _resolve(one, task_links, links.sparkSession.sparkContext.defaultParallelism)
    children = found.select(F.col("node").alias("node_id"), F.col("ptr").alias("root_id"), F.col("off").cast("int").alias("depth"))
    tops = one.select(F.col("ptr").alias("node_id")).distinct().join(one.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    return children.unionByName(tops.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth")))


def contains_links(nodes: DataFrame, edges: DataFrame, kind: str = "contains") -> DataFrame:
    """Valid links of ``kind``: both ends have a row in ``nodes``. Ids compare in lower case without surrounding blanks."""
    ids = nodes.select(norm_id("id").alias("id")).dropna().distinct()
    e = (
        edges.filter(norm_kind("kind") == kind)
        .select(norm_id("source").alias("parent"), norm_id("target").alias("child"))
        .dropna()
        .distinct()
    )
    e = e.join(ids.withColumnRenamed("id", "child"), "child", "left_semi")
    return e.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def paths(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node_id, root_id, depth, path (ids from the root down to the node) of nodes outside loops; each round doubles the reach."""
    top = cut(roots(links, task_links))
    tree = top.filter("depth >= 0")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    parent = links.select("child", "parent").dropna().groupBy("child").agg(F.min("parent").alias("parent"))
    walk = cut(
        tree.join(parent, tree.node_id == parent.child, "left").select(
            "node_id", "root_id", "depth", F.col("parent").alias("up"), F.array("node_id").alias("path")
        )
    )
    for _ in range(math.ceil(math.log2(deepest + 1)) if deepest else 0):
        above = walk.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        walk = cut(
            walk.join(above, "up", "left").select(
                "node_id", "root_id", "depth", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<string>")), "path").alias("path")
            )
        )
    return walk.select("node_id", "root_id", "depth", "path")


def descendants(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """ancestor_id, node_id, distance: every pair of a node and one below it, from the materialised paths."""
    p = paths(links, task_links).filter("depth > 0")
    return p.select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id")).filter("at < depth").select(
        "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance")
    )
