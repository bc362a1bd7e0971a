"""Graph algorithms as loops of joins; nothing of the graph is gathered on the driver but one number a round.

Links without one of their ends and nodes without id count for nothing, repeated links count once, empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut
from graphloom.operators.traverse import directed


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = None) -> DataFrame:
    """id, rank: mass-conserving PageRank on distinct links; the mass of nodes without outgoing link is spread evenly."""
    one = links.select("source", "target").dropna().distinct()
    degree = one.groupBy("source").agg(F.count("*").alias("degree"))
    hop = cut(one.join(degree, "source"))
    ids = cut(nodes.select("id").dropna().distinct().join(degree.select(F.col("source").alias("id"), F.lit(True).alias("has")), "id", "left"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks = ids.select("id", "has", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        hanging = ranks.filter("has is null").agg(F.sum("rank")).first()[0] or 0.0
        given = hop.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = F.lit((1 - damping) / n + damping * hanging / n) + damping * F.coalesce("got", F.lit(0.0))
        new = cut(ranks.withColumnRenamed("rank", "was").join(given, "id", "left").select("id", "has", "was", rank.alias("rank")))
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] if tolerance else None
        ranks = new.drop("was")
        if tolerance and moved < tolerance:
            break
    return ranks.select("id", "rank")


def label_propagation(nodes: DataFrame, links: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community: each round a node takes the label most of its neighbours have, the smallest of the most frequent; a node without neighbours keeps its own."""
    hop = cut(directed(links, "both").filter("a <> b"))
    labels = nodes.select("id", F.col("id").alias("community")).dropna().distinct()
    for _ in range(rounds):
        votes = hop.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("new"))
        labels = cut(labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return labels


#: Links up to which what is left of a graph is decided within one task.
TASK_LINKS = 500_000


def _on_cycles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of strong components of more than one node, of all links of one task: depth first along the links, then against them."""
    parts = list(frames)
    if not parts:
        return
    links = pd.concat(parts)
    codes, names = pd.factorize(pd.concat([links["source"], links["target"]]))
    n, m = len(names), len(links)

    def lists(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()

    starts, ends = lists(codes[:m], codes[m:])
    seen, left = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, starts[root])]
        while stack:
            v, k = stack.pop()
            while k < starts[v + 1] and seen[ends[k]]:
                k += 1
            if k < starts[v + 1]:
                w = ends[k]
                seen[w] = True
                stack += [(v, k + 1), (w, starts[w])]
            else:
                left.append(v)
    starts, ends = lists(codes[m:], codes[:m])
    done, found = [False] * n, []
    for root in reversed(left):
        if done[root]:
            continue
        done[root] = True
        part, at = [root], 0
        while at < len(part):
            v = part[at]
            at += 1
            for k in range(starts[v], starts[v + 1]):
                if not done[ends[k]]:
                    done[ends[k]] = True
                    part.append(ends[k])
        if len(part) > 1:
            found += part
    yield pd.DataFrame({"id": names[found]})


def cycle_nodes(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """id of nodes on a closed path: they are the strongly connected components of more than one node, and loops.

    Nodes without way in or out are trimmed first; then the largest id that reaches a node colours it, and those of a
    colour that reach its origin are one component. What is left goes round again, until no more than ``task_links`` links are: these
    one task decides."""
    every = cut(links.select("source", "target").dropna().distinct())
    found = every.filter("source = target").select(F.col("source").alias("id"))
    rest = every.filter("source <> target")
    while True:
        rest = cut(rest)
        size = rest.count()
        while size > task_links:  # trim
            into, out = rest.select(F.col("target").alias("k")).distinct(), rest.select(F.col("source").alias("k")).distinct()
            rest = cut(rest.join(into, rest.source == into.k, "left_semi").join(out, rest.target == out.k, "left_semi"))
            size, before = rest.count(), size
            if size == before:
                break
        if size <= task_links:
            return found.unionByName(rest.coalesce(1).mapInPandas(_on_cycles, "id string")).distinct()
        ids = rest.select(F.col("source").alias("id")).unionByName(rest.select(F.col("target").alias("id"))).distinct()
        colours = cut(ids.select("id", F.col("id").alias("colour")))
        while True:  # largest id upstream
            sent = rest.join(colours.select(F.col("id").alias("source"), "colour"), "source").groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("new"))
            new = cut(colours.join(sent, "id", "left").select("id", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.coalesce("new", "colour") > F.col("colour")).alias("moved")))
            colours = new.drop("moved")
            if new.filter("moved").isEmpty():
                break
        inside = cut(
            rest.join(colours.select(F.col("id").alias("source"), F.col("colour").alias("c1")), "source")
            .join(colours.select(F.col("id").alias("target"), F.col("colour").alias("c2")), "target")
            .filter("c1 = c2")
            .select("source", "target", F.col("c1").alias("colour"))
        )
        met = frontier = cut(colours.filter("id = colour"))
        while True:  # backwards from the origin within the colour
            step = inside.join(frontier.select(F.col("id").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("id"), "colour").distinct()
            frontier = cut(step.join(met, ["id", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            met = cut(met.unionByName(frontier))
        sizes = met.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1")
        found = cut(found.unionByName(met.join(sizes, "colour", "left_semi").select("id")))
        done = met.select(F.col("id").alias("k"))
        rest = rest.join(done, rest.source == done.k, "left_anti").join(done, rest.target == done.k, "left_anti")


def cycles_up_to(links: DataFrame, length: int = 3) -> DataFrame:
    """cycle, length: simple cycles of at most ``length`` nodes, each once, written from its smallest node."""
    one = links.select("source", "target").dropna().distinct()
    out = [one.filter("source = target").select(F.col("source").alias("cycle"), F.lit(1).alias("length"))]
    hop = one.filter("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    walk = hop.filter("a < b").select(F.col("a").alias("low"), F.col("b").alias("at"), F.array("a", "b").alias("path"))
    for n in range(2, length + 1):
        closed = walk.join(hop, (F.col("at") == F.col("a")) & (F.col("low") == F.col("b")), "left_semi")
        out.append(closed.select(F.concat_ws(">", "path").alias("cycle"), F.lit(n).alias("length")))
        if n < length:
            walk = walk.join(hop, F.col("at") == F.col("a")).filter("low < b").filter(~F.array_contains("path", F.col("b"))).select("low", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def betweenness(links: DataFrame, pivots: DataFrame, max_depth: int = 3, directed_: bool = True) -> DataFrame:
    """id, score: dependencies of the pivots (column id) on the nodes of their shortest paths of at most ``max_depth`` links.

    With all nodes as pivots and no shorter bound than the longest shortest path this is exact betweenness. One table of
    (pivot, node, distance, number of shortest paths) is built level by level, then dependencies flow back."""
    hop = directed(links, "out" if directed_ else "both").filter("a <> b")
    levels = [pivots.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")).distinct()]
    met = levels[0].select("s", "v")
    for _ in range(max_depth):
        last = levels[-1]
        new = last.join(hop, last.v == hop.a).groupBy("s", F.col("b").alias("v")).agg(F.sum("sigma").alias("sigma")).join(met, ["s", "v"], "left_anti")
        new = cut(new)
        levels.append(new)
        met = met.unionByName(new.select("s", "v"))
    delta = levels[-1].select("s", "v", "sigma", F.lit(0.0).alias("delta"))
    score = delta.select("v", "delta")
    for level in reversed(levels[:-1]):
        below = delta.select("s", F.col("v").alias("b"), F.col("sigma").alias("sigma_b"), F.col("delta").alias("delta_b"))
        owed = level.join(hop, level.v == hop.a).join(below, ["s", "b"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sigma_b") * (1 + F.col("delta_b"))).alias("delta"))
        delta = cut(level.join(owed, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        score = score.unionByName(delta.filter("s <> v").select("v", "delta"))
    return score.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("score"))
