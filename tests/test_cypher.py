import pytest

from graphloom import cypher, gql
from graphloom.graph import PropertyGraph

NODES = [
    ("f1", "load", "function", "/lib/io.go", 3, 30, "go", "io.load"), ("f2", "store", "function", "/lib/io.go", 40, 48, "go", "io.store"), ("f3", "hash", "function", "/lib/sum.go", 5, 9, "go", "sum.hash"),
    ("f4", "sweep", "function", "/job/sweep.py", 1, 60, "python", "sweep"), ("c1", "Cache", "class", "/lib/cache.go", 8, 90, "go", "cache.Cache"), ("c2", "Pool", "class", "/job/pool.py", 2, 70, "python", "pool.Pool"),
    ("m1", "put", "method", "/lib/cache.go", 20, 35, "go", "cache.Cache.put"), ("m2", "take", "method", "/lib/cache.go", 40, 52, "go", "cache.Cache.take"), ("m3", "drain", "method", "/job/pool.py", 30, 44, "python", "pool.Pool.drain"),
]
CALLS = [("f4", "f1"), ("f4", "m3"), ("f1", "f3"), ("f1", "m2"), ("f2", "f3"), ("m1", "f2"), ("m1", "f3"), ("m2", "f1"), ("m3", "m2"), ("m3", "m1")]
OTHER = [("c1", "m1", "contains"), ("c1", "m2", "contains"), ("c2", "m3", "contains"), ("f4", "c2", "imports")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(*n, None) for n in NODES], "id string, name string, kind string, file_path string, start_line int, end_line int, language string, qualified_name string, docstring string")
    edges = [(k, *e) for k, e in enumerate([(a, b, "calls") for a, b in CALLS] + OTHER)]
    return PropertyGraph(nodes, spark.createDataFrame(edges, "id long, source string, target string, kind string"), clean=True)


@pytest.mark.parametrize(
    "text, n",
    [
        ("MATCH (n) RETURN n", 9), ("MATCH (n:function) RETURN n.name", 4), ("MATCH (n:Class) RETURN n.name", 2), ("MATCH (n) RETURN n LIMIT 0", 0), ("MATCH (n) RETURN n.name SKIP 7 LIMIT 5", 2),
        ("MATCH (a)-[r]->(b) RETURN a, b", 14), ("MATCH (a)<-[r]-(b) RETURN a, b", 14), ("MATCH (a)-[r]-(b) RETURN a, b", 28), ("MATCH (a)-[:calls]-(b) RETURN a.id", 20), ("MATCH (a)-[:imports|contains]->(b) RETURN b.id", 4),
        ("MATCH (a)-[:imports]->(b)-[:contains]->(c) RETURN c.id", 1), ("MATCH (a {name: 'sweep'})-->(b) RETURN b", 3), ("MATCH (a:class)-[:contains]->(b:method) RETURN b", 3), ("MATCH (a)-[*2]->(b) WHERE a.id = 'f4' RETURN b.id", 5),
        ("MATCH (n) WHERE n.docstring <> 'x' RETURN n", 0), ("MATCH (n) WHERE NOT n.docstring = 'x' RETURN n", 9), ("MATCH (n) WHERE n.docstring RETURN n", 0), ("MATCH (n) WHERE n.start_line XOR n.end_line RETURN n", 0),
        ("MATCH (n:function) WHERE EXISTS { MATCH (n)-[:calls]->(m:method) } RETURN n.id", 2), ("MATCH (n:function) WHERE NOT EXISTS { MATCH (n)-[:calls]->() } RETURN n.id", 1), ("MATCH (n:nothing) RETURN count(*) AS c", 0),
        ("MATCH (n:class) OPTIONAL MATCH (n)-[:imports]->(m) RETURN n.id, m.id", 2), ("UNWIND [1, 2, 3] AS x RETURN x", 3), ("UNWIND [] AS x RETURN x", 0), ("MATCH (n) WHERE n.name IN ['put', 'hash'] RETURN n", 2),
        ("MATCH (n:class) RETURN n.name AS x UNION MATCH (n:class) RETURN n.name AS x", 2), ("MATCH (n:class) RETURN n.name AS x UNION ALL MATCH (n:class) RETURN n.name AS x", 4), ("MATCH (n) RETURN DISTINCT n.language", 2),
    ],
)
def test_counts(g, text, n):
    assert cypher.query(g, text).count() == n


def simple(pairs, low, high):
    """Ends of all paths of low to high links that meet no node twice."""
    out, walks = [], [[a, b] for a, b in sorted(set(pairs)) if a != b]
    while walks:
        out += [(w[0], w[-1]) for w in walks if low <= len(w) - 1 <= high]
        walks = [[*w, b] for w in walks for a, b in sorted(set(pairs)) if a == w[-1] and b not in w]
    return sorted(out)


@pytest.mark.parametrize("stars, low, high", [("*", 1, 99), ("*4..", 4, 99), ("*1..12", 1, 12), ("*9..10", 9, 10), ("*99", 99, 99), ("*2", 2, 2)])
def test_paths_of_any_length(spark, g, stars, low, high):
    """Beyond what is unrolled, around loops, and to their end where no bound is given."""
    got = [tuple(r) for r in cypher.query(g, f"MATCH (a)-[:calls{stars}]->(b) RETURN a.id AS a, b.id AS b").collect()]
    assert sorted(got) == simple(CALLS, low, high)
    chain = [(f"x{k:02}", f"x{k + 1:02}") for k in range(14)] + [("x13", "x05"), ("x03", "x03")]
    nodes = spark.createDataFrame([(f"x{k:02}",) for k in range(15)], "id string")
    h = PropertyGraph(nodes, spark.createDataFrame([(k, a, b, "calls") for k, (a, b) in enumerate(chain)], "id long, source string, target string, kind string"), clean=True)
    got = [tuple(r) for r in cypher.query(h, f"MATCH (a)-[:calls{stars}]->(b) RETURN a.id AS a, b.id AS b").collect()]
    assert sorted(got) == simple(chain, low, high)


def one(g, text, **params):
    return [tuple(r) for r in cypher.query(g, text, params).collect()]


def test_values(g):
    assert one(g, "MATCH (a)<-[:calls]-(b) WHERE a.name = 'load' RETURN b.name ORDER BY b.name") == [("sweep",), ("take",)]
    assert one(g, "MATCH (n:class) RETURN n.name AS n, count(*) AS c ORDER BY n") == [("Cache", 1), ("Pool", 1)]
    assert [(c, sorted(m)) for c, m in one(g, "MATCH (c:class)-[:contains]->(m) RETURN c.name AS c, collect(m.name) AS m ORDER BY c")] == [("Cache", ["put", "take"]), ("Pool", ["drain"])]
    assert one(g, "UNWIND [-7] AS x RETURN x % 3 AS m, x / 2 AS d, 2 ^ 3 AS p") == [(2, -3.5, 8.0)]
    assert one(g, "MATCH (n {id: 'f1'}) RETURN CASE n.docstring WHEN null THEN 1 ELSE 2 END AS c, type(n) AS t, n.nope AS z") == [(1, "dict", None)]
    assert one(g, "MATCH (n) WHERE n.start_line > $low RETURN n.name AS x ORDER BY n.end_line DESC LIMIT 1", low=29) == [("take",)]
    assert one(g, "MATCH (n:function) WITH n.file_path AS f, count(*) AS c WHERE c > 1 RETURN f, c ORDER BY f") == [("/lib/io.go", 2)]
    assert one(g, "MATCH (n:class) RETURN n.docstring AS d, n.name AS x ORDER BY d DESC, x") == [(None, "Cache"), (None, "Pool")]


@pytest.mark.parametrize("text", ["RETURN 1", "MATCH (n RETURN n", "MATCH (n) RETURN m", "MATCH (n)", "MATCH (a), (b) RETURN a, b", "MATCH (n) RETURN nope(n)", "MATCH (n) RETURN n LIMIT -1", "MATCH (n) RETURN $x", "MATCH (n) RETURN n ~ 1"])
def test_errors(g, text):
    with pytest.raises(cypher.CypherError):
        cypher.query(g, text)


def test_error_tells_the_place(g):
    with pytest.raises(cypher.CypherError, match=r"line 2, column 8"):
        cypher.query(g, "MATCH (n)\nRETURN ,")


def test_registration(g):
    from pyspark.sql import functions as F

    cypher.register_function("twice", lambda c: c * 2)
    assert one(g, "UNWIND [4] AS x RETURN twice(x) AS y") == [(8,)]
    with pytest.raises(ValueError):
        cypher.register_function("Twice", lambda c: c)
    cypher.register_aggregate("longest", lambda c: F.max(F.length(c)))
    assert one(g, "MATCH (n) RETURN longest(n.name) AS l") == [(5,)]
    with pytest.raises(ValueError):
        cypher.register_aggregate("count", lambda c: c)


def test_plan_reads_only_what_is_asked(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "class", "A", 1, "text")], "id string, kind string, name string, updated_at long, body string")
    edges = spark.createDataFrame([(1, "a", "a", "calls", None)], "id long, source string, target string, kind string, target_text string")
    nodes.write.parquet(f"{tmp_path}/n")
    edges.write.parquet(f"{tmp_path}/e")
    g = PropertyGraph(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/e"))
    plan = cypher.query(g, "MATCH (c:class) RETURN c.name AS name")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "name" in plan


def test_gql(spark, g):
    assert [r.name for r in gql.query(g, "FIND class RETURN name ORDER BY name").collect()] == ["Cache", "Pool"]
    assert gql.query(g, "FIND WHERE NOT (kind = 'class' OR kind = 'method') RETURN id").count() == 4
    assert gql.query(g, "FIND * WHERE name MATCHES 'POO' OR start_line < 6 RETURN id LIMIT 3").count() == 3
    assert sorted(r.name for r in gql.query(g, "IMPACT load").collect()) == ["sweep", "take"]
    assert sorted(r.name for r in gql.query(g, "CALLS cache.Cache.put").collect()) == ["hash", "store"]
    assert [r.path for r in gql.query(g, "TRACE sweep hash").collect()] == ["f4>f1>f3", "f4>m3>m1>f3", "f4>c2>m3>m1>f3", "f4>m3>m1>f2>f3", "f4>m3>m2>f1>f3", "f4>c2>m3>m1>f2>f3", "f4>c2>m3>m2>f1>f3"]
    assert [tuple(r) for r in gql.query(g, "TRACE sweep sweep").collect()] == [("f4", 0)] and gql.query(g, "TRACE hash sweep").count() == 0
    for bad in ("FIND WHERE nope = 1", "LOOK x", "IMPACT nobody", "FIND class LIMIT x"):
        with pytest.raises(gql.GqlError):
            gql.query(g, bad)


def test_trace_follows_ten_links(spark):
    """A way of ten links is found, one of eleven is not; every way of a grid that meets no node twice is."""
    ids = [f"t{k:02}" for k in range(12)]
    nodes = spark.createDataFrame([(i, i) for i in ids] + [(f"{x}.{y}", f"{x}.{y}") for x in range(4) for y in range(4)], "id string, name string")
    grid = [(f"{x}.{y}", f"{x + a}.{y + b}") for x in range(4) for y in range(4) for a, b in ((0, 1), (1, 0), (0, -1)) if 0 <= x + a < 4 and 0 <= y + b < 4]
    h = PropertyGraph(nodes, spark.createDataFrame([(k, a, b, "calls") for k, (a, b) in enumerate([*zip(ids, ids[1:]), *grid])], "id long, source string, target string, kind string"), clean=True)
    links = h.links()
    from graphloom.operators.traverse import paths_between

    assert [tuple(r) for r in paths_between(links, "t00", "t10").collect()] == [(">".join(ids[:11]), 10)] and paths_between(links, "t00", "t11").count() == 0
    walks, want = [["0.0"]], []
    for _ in range(10):
        walks = [[*w, b] for w in walks for a, b in grid if a == w[-1] and b not in w and w[-1] != "3.3"]
        want += [">".join(w) for w in walks if w[-1] == "3.3"]
    assert sorted(r.path for r in paths_between(links, "0.0", "3.3").collect()) == sorted(want) and len(want) > 30
