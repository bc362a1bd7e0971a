import random

import pytest

from graphloom.operators import hierarchy


def brute(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in set(up) | set(up.values()):
        seen, at, d = set(), n, 0
        while at in up and at not in seen:
            seen.add(at)
            at, d = up[at], d + 1
        out[n] = ("", -1) if at in seen else (at, d)
    return out


def found(df):
    return {r.node_id: (r.root_id, r.depth) for r in df.collect()}


def forest(seed, n, loops):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    links = [(ids[i], ids[rnd.randrange(max(0, i - 4), i)]) for i in range(1, n) if rnd.random() < 0.95]
    links += [(f"x{i}", f"x{(i + 1) % 3}") for i in range(3)] * loops + [("y", "x0")] * loops + [("self", "self")] * loops
    return links + links[:5]


@pytest.mark.parametrize("bound", [1_000_000, 7])
def test_roots_against_walk(spark, bound, monkeypatch):
    """A bound of 7 links a task makes levels merge and the rest be doubled."""
    monkeypatch.setattr(hierarchy, "SPREAD_LINKS", 5)
    links = forest(1, 60, 1)
    assert found(hierarchy.roots(spark.createDataFrame(links, "child string, parent string"), bound)) == brute(links)


def test_chain_by_doubling(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("p", "q"), ("q", "p")]
    df = spark.createDataFrame(links, "child string, parent string")
    assert found(hierarchy.roots(df, 3)) == brute(links)


def test_doubling_carries_lost_nodes(spark):
    """L is closed on itself below this level; nothing stays open two rounds after, and all above L are lost."""
    links = spark.createDataFrame([("L", "", -1), ("A", "L", 1), ("B", "A", 1), ("C", "B", 1), ("y", "x", 1), ("z", "y", 2)], hierarchy._LINK)
    assert {r.node: (r.ptr, r.off) for r in hierarchy._double(links).collect()} == dict.fromkeys("LABC", ("", -1)) | {"y": ("x", 1), "z": ("x", 3)}


def test_chain_above_self_loop(spark):
    links = [("n00", "n00")] + [(f"n{i:02}", f"n{i - 1:02}") for i in range(1, 24)] + [("b", "a"), ("c", "b")]
    df = spark.createDataFrame(links, "child string, parent string")
    assert found(hierarchy.roots(df, 2)) == brute(links)


def test_nulls_ties_empty(spark):
    links = [("a", "b"), ("a", "b"), ("a", "c"), (None, "b"), ("a", None)]
    assert found(hierarchy.roots(spark.createDataFrame(links, "child string, parent string"))) == {"a": ("b", 1), "b": ("b", 0)}
    assert found(hierarchy.roots(spark.createDataFrame([], "child string, parent string"))) == {}


def test_paths_and_descendants(spark, rows):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("l", "m"), ("m", "l")]
    df = spark.createDataFrame(links, "child string, parent string")
    assert {r.node_id: "/".join(r.path) for r in hierarchy.paths(df).collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/b/c/d"}
    assert rows(hierarchy.descendants(df)) == sorted([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)])


def test_contains_links_spelling_and_clashing_columns(spark, rows):
    nodes = spark.createDataFrame([("A", "x"), ("b", "y"), (None, "z"), ("b", "y")], "id string, child string")
    edges = spark.createDataFrame([(" a ", "B", "Contains", 1), ("a", "gone", "contains", 2), ("a", "b", "calls", 3), (None, "b", "contains", 4), ("a", "  ", "contains", 5)], "source string, target string, kind string, parent int")
    assert rows(hierarchy.contains_links(nodes, edges)) == [("a", "b")] or rows(hierarchy.contains_links(nodes, edges).select("parent", "child")) == [("a", "b")]
