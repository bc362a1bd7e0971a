"""Level-synchronous traversal over link tables (source, target).

Seeds and links with null ids count for nothing; an empty table of either gives an empty result; repeated rows count once.

A level is one join of the frontier with the links and one anti join with what was met before; small depths are unrolled
into one plan, deeper ones cut their lineage through the shared folder every few levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut

#: Levels that stay one plan.
UNROLLED = 3
#: Levels a round of ``reachable`` takes.
STRIDE = 4


def directed(links: DataFrame, direction: str) -> DataFrame:
    """links as (a, b): out follows them, in goes against them, both does either; a link without one of its ends is none."""
    links = links.dropna(subset=["source", "target"])
    out = links.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = links.select(F.col("target").alias("a"), F.col("source").alias("b"))
    if direction == "out":
        return out.distinct()
    if direction == "in":
        return back.distinct()
    if direction == "both":
        return out.unionByName(back).distinct()
    raise ValueError("direction must be out, in or both")


def bfs(links: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int | None = 1) -> DataFrame:
    """seed, id, depth: what each seed (column ``id``) reaches, at its least depth, the seed itself left out. No bound: until nothing new."""
    hop = directed(links, direction)
    if max_depth is None or max_depth > UNROLLED:
        hop = cut(hop)
    met = frontier = seeds.select(F.col("id").alias("seed"), "id").dropna().distinct()
    out: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(hop, frontier.id == hop.a).select("seed", F.col("b").alias("id")).distinct().join(met, ["seed", "id"], "left_anti")
        if max_depth is None or max_depth > UNROLLED:
            new = cut(new)
            if new.isEmpty():
                break
        out.append(new.withColumn("depth", F.lit(depth)))
        met = met.unionByName(new)
        if (max_depth is None or max_depth > UNROLLED) and depth % 4 == 0:
            met = cut(met)
        frontier = new
    return reduce(lambda a, b: a.unionByName(b), out) if out else met.limit(0).withColumn("depth", F.lit(0))


def reachable(links: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """id: everything any seed reaches, the seeds too; one visited set, not one for each seed.

    A round takes STRIDE levels in one plan, whose steps share their exchanges, and cuts the lineage once; what several levels of a
    round meet again is dropped at its end."""
    hop = cut(directed(links, direction))
    met = frontier = cut(seeds.select("id").dropna().distinct())
    level = 0
    while True:
        level += 1
        steps, step = [], frontier
        for _ in range(STRIDE):
            step = step.join(hop, step.id == hop.a).select(F.col("b").alias("id")).distinct()
            steps.append(step)
        frontier = cut(reduce(lambda a, b: a.unionByName(b), steps).distinct().join(met, "id", "left_anti"))
        if frontier.isEmpty():
            return met
        met = met.unionByName(frontier)
        if level % 4 == 0:
            met = cut(met)


def shortest_paths(links: DataFrame, pairs: DataFrame, max_depth: int = 5, direction: str = "out") -> DataFrame:
    """source, target, length, path ('>'-joined ids) of each pair that is connected within ``max_depth``; among equally short ones the
    smallest path; a pair of the same node twice has length 0."""
    hop = cut(directed(links, direction))
    wanted = cut(pairs.select("source", "target").dropna().distinct())
    met = frontier = wanted.select("source", F.col("source").alias("id"), F.col("source").alias("path")).distinct()
    found = [frontier.withColumn("length", F.lit(0))]
    for depth in range(1, max_depth + 1):
        step = frontier.join(hop, frontier.id == hop.a).select("source", F.col("b").alias("id"), F.concat_ws(">", "path", "b").alias("path"))
        new = step.groupBy("source", "id").agg(F.min("path").alias("path")).join(met.select("source", "id"), ["source", "id"], "left_anti")
        new = cut(new)
        found.append(new.withColumn("length", F.lit(depth)))
        met = met.unionByName(new)
        frontier = new
    every = reduce(lambda a, b: a.unionByName(b), found).withColumnRenamed("id", "target")
    return wanted.join(every, ["source", "target"]).select("source", "target", "length", "path")


def simple_paths(links: DataFrame, seeds: DataFrame, max_length: int) -> DataFrame:
    """seed, id, length, path of all paths from the seeds that meet no node twice; their number grows with the length, so it is bounded."""
    hop = directed(links, "out")
    walk = seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("path"))
    out = []
    for n in range(1, max_length + 1):
        walk = walk.join(hop, walk.id == hop.a).filter(~F.array_contains("path", F.col("b"))).select("seed", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        out.append(walk.select("seed", "id", F.lit(n).alias("length"), F.concat_ws(">", "path").alias("path")))
    return reduce(lambda a, b: a.unionByName(b), out)


def paths_between(links: DataFrame, source: str, target: str, max_length: int = 10) -> DataFrame:
    """path ('>'-joined ids), length of all paths of at most ``max_length`` links from one node to another that meet no node twice; of a
    node to itself the empty one.

    Links that can't be part of one are left out first: a walk goes on only where the target is near enough for the links left."""
    spark = links.sparkSession
    if source == target:
        return spark.createDataFrame([(source, 0)], "path string, length int")
    end = spark.createDataFrame([(target,)], "id string")
    left = bfs(links, end, "in", max_length - 1).select("id", F.col("depth").alias("left")).unionByName(end.withColumn("left", F.lit(0)))
    hop = directed(links, "out").filter(F.col("a") != target).join(left.withColumnRenamed("id", "b"), "b")
    hop = cut(hop.filter(F.col("left") < max_length))
    walk = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    out = []
    for n in range(1, max_length + 1):
        walk = walk.join(hop, walk.id == hop.a).filter(F.col("left") <= max_length - n).filter(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        if n > UNROLLED:
            walk = cut(walk)
            if walk.isEmpty():
                break
        out.append(walk.filter(F.col("id") == target).select(F.concat_ws(">", "path").alias("path"), F.lit(n).alias("length")))
    return reduce(lambda a, b: a.unionByName(b), out)


def closure(links: DataFrame, max_depth: int = 3) -> DataFrame:
    """source, target, depth: pairs connected over 2 to ``max_depth`` links at their least depth, without direct ones and pairs of a node with itself."""
    one = links.select("source", "target").dropna().distinct()
    reach = [one.withColumn("depth", F.lit(1))]
    walk = one
    for d in range(2, max_depth + 1):
        walk = walk.join(one.select(F.col("source").alias("target"), F.col("target").alias("next")), "target").select("source", F.col("next").alias("target")).distinct()
        reach.append(walk.withColumn("depth", F.lit(d)))
    every = reduce(lambda a, b: a.unionByName(b), reach).filter("source <> target")
    return every.groupBy("source", "target").agg(F.min("depth").alias("depth")).filter("depth > 1")


def chains(links: DataFrame, max_length: int = 3, min_length: int = 2) -> DataFrame:
    """path, length of chains from nodes without inbound link, of ``min_length`` to ``max_length`` nodes; one that closes a cycle ends with the node it meets again."""
    one = links.select("source", "target").dropna().distinct()
    roots = one.select(F.col("source").alias("id")).distinct().join(one.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    walk = roots.select("id", F.array("id").alias("path"), F.lit(False).alias("closed"))
    out = []
    for n in range(2, max_length + 1):
        walk = walk.filter(~F.col("closed")).join(one, F.col("id") == F.col("source")).select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"), F.array_contains("path", F.col("target")).alias("closed"))
        if n >= min_length:
            out.append(walk.select(F.concat_ws(">", "path").alias("path"), F.lit(n).alias("length")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """seed, id, kind, way: each neighbour once; an outgoing edge wins over an incoming one, then the smallest kind."""
    out = edges.select(F.col("source").alias("seed"), F.col("target").alias("id"), "kind", F.lit("out").alias("way"), F.lit(0).alias("o"))
    back = edges.select(F.col("target").alias("seed"), F.col("source").alias("id"), "kind", F.lit("in").alias("way"), F.lit(1).alias("o"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    both = both.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    return both.groupBy("seed", "id").agg(F.min(F.struct("o", "kind", "way")).alias("r")).select("seed", "id", "r.kind", "r.way")
