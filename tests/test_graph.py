import itertools
"""Traversal and algorithms against plain Python on random graphs; storage, tiers, search and streams on small tables."""

import collections
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import code
from graphloom.graph import PropertyGraph
from graphloom.operators import algorithms, analytics, crosstier, search, similarity, storage, traverse
from graphloom.streaming import watch


def random_links(seed, n=14, m=26):
    r = random.Random(seed)
    return sorted({(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)})


def links_df(spark, links):
    return spark.createDataFrame(links, "source string, target string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def distances(links, start):
    adj = collections.defaultdict(set)
    for a, b in links:
        adj[a].add(b)
    out, q = {start: 0}, collections.deque([start])
    while q:
        x = q.popleft()
        for y in adj[x]:
            if y not in out:
                out[y] = out[x] + 1
                q.append(y)
    return out


@pytest.mark.parametrize("depth", [2, None])
def test_bfs(spark, depth):
    links = random_links(3)
    got = {(r.seed, r.id): r.depth for r in traverse.bfs(links_df(spark, links), ids_df(spark, ["v00", "v05"]), "out", depth).collect()}
    assert got == {(s, i): d for s in ("v00", "v05") for i, d in distances(links, s).items() if 0 < d <= (depth or 99)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_cycle_nodes_property(spark, seed):
    links = random_links(seed, 9, 13)
    reach = {a: distances([(x, y) for x, y in links], a) for a, _ in links}
    want = {a for a, b in links if a in reach.get(b, {}) or a == b}
    for task_links in (algorithms.TASK_LINKS, 0):  # within one task, and by rounds of joins alone
        assert {r.id for r in algorithms.cycle_nodes(links_df(spark, links), task_links).collect()} == want


def test_reachable_over_many_rounds(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(11)] + [("n05", "n02"), ("n11", "m"), ("z", "n00")]
    assert sorted(r.id for r in traverse.reachable(links_df(spark, chain), ids_df(spark, ["n03"])).collect()) == ["m"] + [f"n{k:02}" for k in range(2, 12)]


def test_reachable_closure_chains_paths(spark, rows):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]
    df = links_df(spark, links)
    assert sorted(r.id for r in traverse.reachable(df, ids_df(spark, ["b"])).collect()) == ["a", "b", "c", "d"]
    assert rows(traverse.closure(df, 3)) == sorted([("a", "c", 2), ("b", "a", 2), ("b", "d", 2), ("c", "b", 2), ("a", "d", 3)], key=repr)
    assert rows(traverse.chains(df, 3)) == [("x>y", 2)]
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a"), ("a", "x")], "source string, target string")
    assert rows(traverse.shortest_paths(df, pairs, 4)) == [("a", "a", 0, "a"), ("a", "d", 3, "a>b>c>d")]
    assert rows(traverse.bfs(df, ids_df(spark, []), "out", 2)) == []


def test_pagerank_conserves_mass(spark):
    links = random_links(5)
    ids = sorted({x for p in links for x in p} | {"lonely"})
    got = {r.id: r.rank for r in algorithms.pagerank(ids_df(spark, ids), links_df(spark, links + links[:3]), rounds=6).collect()}
    rank = {i: 1 / len(ids) for i in ids}
    out = collections.Counter(a for a, _ in links)
    for _ in range(6):
        hang = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * hang / len(ids) + 0.85 * sum(rank[a] / out[a] for a, b in links if b == i) for i in ids}
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)
    assert all(math.isclose(got[i], rank[i], abs_tol=1e-9) for i in ids)


def test_betweenness_exact(spark):
    links = [x for x in random_links(11, 9, 16) if x[0] != x[1]]
    ids = sorted({x for p in links for x in p})
    want = collections.Counter()
    for s in ids:
        d = distances(links, s)
        sigma = collections.Counter({s: 1})
        for x in sorted(d, key=d.get):
            for a, b in links:
                if a == x and d.get(b) == d[x] + 1:
                    sigma[b] += sigma[x]
        delta = collections.Counter()
        for x in sorted(d, key=d.get, reverse=True):
            for a, b in links:
                if a == x and d.get(b) == d[x] + 1:
                    delta[x] += sigma[x] / sigma[b] * (1 + delta[b])
            if x != s:
                want[x] += delta[x]
    got = {r.id: r.score for r in algorithms.betweenness(links_df(spark, links), ids_df(spark, ids), 9).collect()}
    assert all(math.isclose(got.get(i, 0), want[i], abs_tol=1e-9) for i in ids)


def test_cycles_and_labels(spark, rows):
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "f")]
    assert rows(algorithms.cycles_up_to(links_df(spark, links), 3)) == sorted([("d", 1), ("a>b", 2), ("a>b>c", 3)], key=repr)
    got = {r.id: r.community for r in algorithms.label_propagation(ids_df(spark, "abcdef"), links_df(spark, links), 3).collect()}
    assert got["d"] == "d" and len({got[x] for x in "abc"}) == 1


def test_dead_code_and_entry_points(spark, rows):
    nodes = [("m", "main", "function", "src/main.py"), ("h", "helper", "function", "src/lib.py"), ("u", "util", "function", "src/lib.py"), ("o", "orphan", "function", "src/dead.py"), ("t", "test_main", "function", "tests/test_main.py")]
    n = spark.createDataFrame([(i, name, kind, f, None, name, None, 0) for i, name, kind, f in nodes], "id string, name string, kind string, file_path string, decorators string, qualified_name string, language string, is_exported int")
    e = spark.createDataFrame([(1, "m", "h", "calls"), (2, "h", "u", "calls"), (3, "t", "m", "calls")], "id long, source string, target string, kind string")
    g = PropertyGraph(n, e, clean=True)
    assert rows(analytics.dead_by_reach(g)) == [("o", "no_callers")]
    assert {r.entry_type for r in analytics.entry_points(g).collect()} == {"main", "test"}
    assert [r.id for r in analytics.dead_by_rules(g).collect()] == ["o"]
    assert rows(analytics.coverage(g).filter("covered > 0").select("file_path", "covered")) == [("src/main.py", 1)]


def test_security_rules(spark, rows):
    bodies = {"a": "cur.execute('SELECT ' + name)", "b": 'password = "hunter2"', "c": "os.system('rm ' + x)", "d": "pickle.loads(x)", "e": "open('a/b/' + p)", "f": "return 1", "g": None}
    n = spark.createDataFrame([(k, "function", v) for k, v in bodies.items()], "id string, kind string, body string")
    g = PropertyGraph(n, spark.createDataFrame([], "id long, source string, target string, kind string"), clean=True)
    got = {(r.id, r.category) for r in analytics.security_findings(g).collect()}
    assert {("a", "sql_injection"), ("b", "hardcoded_secret"), ("c", "command_injection"), ("d", "deserialization"), ("e", "path_traversal")} <= got
    assert not any(i in "fg" for i, _ in got)


def test_cognitive_complexity(spark):
    def brute(tokens, lang):
        score = depth = 0
        for t in tokens:
            if t in ("{", "begin", "do"):
                depth += 1
                continue
            if t in ("}", "end", "endfunction", "endif"):
                depth = max(0, depth - 1)
                continue
            if t == ":" and lang == "python":
                depth += 1
            score += (1 + depth) * (t in code.DECISIONS) + (1 + depth) * (t in code.LOOPS) + (t in ("&&", "||")) + (depth if t in ("break", "continue") else 0)
        return score

    import re

    bodies = [("} if (a && b) { for (;;) { while (x) { break; } } }", "java"), ("def f(x):\n  if x:\n    for i in x:\n      continue", "python"), ("", "go")]
    df = spark.createDataFrame(bodies, "body string, language string").withColumn("t", code.words_and_signs(F.col("body")))
    for r in df.select("body", "language", code.cognitive(F.col("t"), F.col("language")).alias("c")).collect():
        assert r.c == brute(re.findall(code.WORD_OR_SIGN, r.body), r.language)


def test_words_of_each_language_count(spark):
    bodies = [
        ("def f\n  return 1 unless x\n  case y when 1 then 2 when 3 then 4 end\nensure\n  z\nend", "ruby", 1 + 1 + 2 + 1 + 2), ("function f() { foreach (x) {} if (a) {} elseif (b) {} switch (c) { case 1: } }", "php", 1 + 1 + 1 + 1 + 1),
        ("fn f() { match x { _ => 1 } loop { } }", "rust", 3), ("func f() { for range x { } switch y { case 1: fallthrough } }", "go", 1 + 2 + 1 + 1), ("int f() { return a ? 1 : 2; }", "java", 2), ("foreach match ensure case", "python", 1), ("case case", "other", 1),
    ]
    df = spark.createDataFrame(bodies, "body string, language string, want int").withColumn("t", code.words_and_signs(F.col("body")))
    for r in df.select("want", "language", code.cyclomatic(F.col("t"), F.col("language")).alias("got")).collect():
        assert r.got == r.want, r.language
    volume, _ = code.halstead(F.col("t"), F.col("language"))
    one = spark.createDataFrame([("let x", "rust"), ("let x", "javascript"), ("let x", "go")], "body string, language string").withColumn("t", code.words_and_signs(F.col("body")))
    # one operator and one operand, or two operands: the volume is the same, the difficulty is not
    assert {r.language: r.d > 0 for r in one.select("language", code.halstead(F.col("t"), F.col("language"))[1].alias("d")).collect()} == {"rust": True, "javascript": True, "go": False}


def test_similarity_join_is_exact(spark):
    r = random.Random(2)
    base = [[f"w{r.randrange(40)}" for _ in range(12)] for _ in range(6)]
    sets = {f"s{i:02}": sorted(set(base[i % 6][: 12 - (i % 3)] + ([f"x{i}"] if i % 4 == 0 else []))) for i in range(24)} | {"e1": [], "e2": []}
    df = spark.createDataFrame(list(sets.items()), "id string, items array<string>")
    distinct = {}
    for k, v in sorted(sets.items()):
        distinct.setdefault(tuple(v), k)
    reps = {k: v for v, k in distinct.items() if v}
    want = {(a, b) for a in reps for b in reps if a < b and len(set(reps[a]) & set(reps[b])) / len(set(reps[a]) | set(reps[b])) >= 0.8 - 1e-9}
    got = similarity.similarity_links(df.filter(F.col("id").isin(*reps)))
    assert {(x.a, x.b) for x in got.collect()} == want
    per = {x.id: x for x in similarity.clones(df).collect()}
    assert set(per) == set(sets) and per["e1"]["class"] == "e1" and per["e2"].copies == 1
    assert all(per[a]["class"] == per[b]["class"] for a, b in want)


def _moved(spark) -> int:
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_clones_write_no_candidates(spark):
    """Sets that share their rarest item and hardly more: 70,000 pairs and more meet, none of them matches, none is written."""
    r = random.Random(5)
    sets = [(f"{i:05}", [f"r{i % 60}", *{f"w{r.randrange(60)}" for _ in range(10)}]) for i in range(3000)]
    heavy = spark.createDataFrame([(k, [*v, *(f"{x}'" for x in v[1:])]) for k, v in sets], "id string, items array<string>")
    was = _moved(spark)
    got = similarity.clones(heavy).collect()
    assert len(got) == 3000 and all(x.id == x["class"] and (x.copies, x.links) == (1, 0) for x in got)
    moved = _moved(spark) - was
    assert moved < 5_000_000


def test_blocks_of_pairs_are_bounded(monkeypatch):
    """The first sets have few partners, the last have many: no block holds more pairs than it may, every pair comes once."""
    n = np.array(sorted([1, 2, 3, *[40] * 300]))
    sketch = np.zeros(len(n), dtype=np.uint64)
    monkeypatch.setattr(similarity, "PAIRS", 1_000)
    blocks = list(similarity._near(n, sketch, np.arange(len(n)), 0.8))
    got = [(i, j) for x, y in blocks for i, j in zip(x.tolist(), y.tolist())]
    assert max(len(x) for x, _ in blocks) <= 1_000 and len(got) == len(set(got)) and set(got) >= set(itertools.combinations(range(3, 303), 2))


def test_clones_of_a_long_chain_take_few_jobs(spark):
    """Each set is similar to the next only: one class, in as many jobs as for a short chain."""
    chain = [(f"{(i * 37) % 400:03}", [f"w{x}" for x in range(i, i + 10)]) for i in range(400)]
    sc = spark.sparkContext
    sc.setJobGroup("chain", "")
    got = similarity.clones(spark.createDataFrame(chain, "id string, items array<string>")).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {x["class"] for x in got} == {"000"} and sorted(x.links for x in got) == [1, 1, *[2] * 398] and {x.copies for x in got} == {1}
    assert jobs < 60


@pytest.mark.parametrize(("rows", "links"), [(50_000, 4_000_000), (5, 20), (2, 1)])
def test_clones_in_small_parts(spark, monkeypatch, rows, links):
    """Groups that are split, forests that are merged in several steps or by joins: the same result as comparing all with all."""
    for name, value in (("GROUP_ROWS", rows), ("TASK_LINKS", links)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(rows)
    base = [{f"w{r.randrange(90)}" for _ in range(r.choice((1, 2, 6, 15, 40)))} for _ in range(12)]
    sets = {}
    for i in range(90):
        b = sorted(r.choice(base))
        sets[f"s{i:02}"] = sorted(set(r.sample(b, max(1, len(b) - r.randrange(4)))) | {f"w{r.randrange(90)}" for _ in range(r.randrange(2))})
    apart = {}
    for k, v in sorted(sets.items()):
        apart.setdefault(tuple(v), k)
    near = [(a, b) for a, b in itertools.combinations(sorted(apart.values()), 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8 - 1e-9]
    top = {k: k for k in apart.values()}
    for _ in top:
        for a, b in near:
            top[a] = top[b] = min(top[a], top[b])
    copies = {k: sum(x == list(v) for x in sets.values()) for v, k in apart.items()}
    want = {(k, top[apart[tuple(v)]], copies[apart[tuple(v)]], sum(apart[tuple(v)] in p for p in near)) for k, v in sets.items()}
    df = spark.createDataFrame(list(sets.items()), "id string, items array<string>")
    assert len(near) > 20 and {tuple(x) for x in similarity.clones(df.repartition(3)).collect()} == want
    alike = {(x.a, x.b): x.similarity for x in similarity.similarity_links(df.filter(F.col("id").isin(*apart.values()))).collect()}
    assert alike == {(a, b): pytest.approx(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) for a, b in near}


def test_minhash(spark):
    a, b = {f"t{i}" for i in range(60)}, {f"t{i}" for i in range(8, 60)}
    x, y = similarity.signature(a), similarity.signature(b)
    assert abs(sum(p == q for p, q in zip(x, y)) / 128 - len(a & b) / len(a | b)) < 0.15
    assert similarity.signature(set()) == [similarity.PRIME] * 128
    got = similarity.signatures(spark.createDataFrame([("a", sorted(a)), ("e", []), ("n", None)], "id string, items array<string>")).collect()
    assert [list(r.sig) for r in sorted(got)] == [x, [similarity.PRIME] * 128, [similarity.PRIME] * 128]


def test_vector_topk(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 0.1]), (7, [1.0, None])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in search.vector_topk(v, v.filter("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 6, 2), (0, 2, 3)]
    assert search.vector_topk(v.limit(0), v.limit(0)).count() == 0


def test_urls(spark):
    cases = [("/users/<int:id>", "flask", "/users/{id}"), ("/users/:id/", "express", "/users/{id}"), ("/f/*path", "gin", "/f/{path}"), ("/u/{id:[0-9]+}", "spring", "/u/{id}"), ("^a/(?P<pk>\\d+)/$", "django", "a/{pk}"), ("http://h:1/x?q=1", None, "/x"), ("http://h", "flask", "/"), ("/u/{id}", "fastapi", "/u/{id}")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "url string, framework string")
    assert [r[0] for r in df.select(crosstier.normalize_url(F.col("url"), F.col("framework"))).collect()] == [c for _, _, c in cases]


def test_storage(spark, rows):
    old = spark.createDataFrame([("a", "x", 1, '{"k": "1"}', "f"), ("b", "x", 1, None, "g")], "id string, name string, updated_at long, properties string, file_path string")
    new = spark.createDataFrame([("b", "y", 0, None, "g"), ("b", "z", 5, None, "g"), ("c", "n", None, None, "h")], old.schema)
    assert rows(storage.upsert_nodes(old, new).select("id", "name")) == [("a", "x"), ("b", "z"), ("c", "n")]
    got = storage.merge_properties(old, spark.createDataFrame([("a", "k", "2"), ("b", "z", "9"), (None, "z", "9")], "id string, key string, value string"))
    assert {r.id: r.properties for r in got.collect()} == {"a": '{"k":"2"}', "b": '{"z":"9"}'}
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    n, e = storage.delete_files(old, edges, spark.createDataFrame([("f",)], "file_path string"))
    assert rows(n.select("id")) == [("b",)] and rows(e.select("source")) == [("b",)]
    paths = spark.createDataFrame([("a/b.py",), ("a/vendors/b.py",), ("a/b.go",), (None,)], "p string")
    assert rows(paths.filter(storage.in_scope(F.col("p"), ["**/*.py"], ["**/vendors/**"]))) == [("a/b.py",)]


def test_snapshots_on_disk(spark, tmp_path):
    n = spark.createDataFrame([("a", "x")], "id string, name string")
    g = PropertyGraph(n, spark.createDataFrame([(1, "a", "a", "calls", None, None)], "id long, source string, target string, kind string, target_text string, provenance string"), clean=True)
    folder = f"file://{tmp_path}/snaps"
    assert storage.snapshot_list(spark, folder) == []
    storage.snapshot_create(g, folder, "two")
    storage.snapshot_create(g, folder, "one")
    storage.snapshot_create(g, folder, "one")
    assert storage.snapshot_list(spark, folder) == ["one", "two"]


def test_graph_cleans(spark, rows):
    n = spark.createDataFrame([(" A ", "Class", "old", 1), ("a", "CLASS", "new", 2), (None, "class", "x", 3), ("b", None, None, None)], "id string, kind string, name string, updated_at long")
    e = spark.createDataFrame([(1, "A", " ", "p:q", "Calls"), (1, "A", " ", "p:q", "Calls"), (2, "a", "B", None, "CALLS"), (3, None, "b", None, "calls"), (4, "a", None, None, "calls")], "id long, source string, target string, target_text string, kind string")
    g = PropertyGraph(n, e)
    assert rows(g.nodes("kind", "name")) == [("a", "class", "new"), ("b", None, None)]
    assert len(rows(g.edges("id", kinds=["calls"]))) == 3
    assert rows(g.links("calls")) == [("a", "b")]
    assert rows(PropertyGraph(n.limit(0), e.limit(0)).links()) == []


def test_poll_and_debounce(spark, rows):
    s = "path string, modified_at long"
    a, b = spark.createDataFrame([("k", 1), ("m", 1), ("r", 1), ("n", None)], s), spark.createDataFrame([("k", 1), ("m", 2), ("c", 1), ("n", None)], s)
    assert rows(watch.poll_changes(a, b)) == [("c", "created"), ("m", "modified"), ("r", "removed")]
    ev = spark.createDataFrame([("a", "created", 1), ("a", "modified", 2), ("b", "removed", 5), ("b", "created", 5)], "path string, kind string, seq int")
    assert rows(watch.debounce(ev)) == [("a", "modified"), ("b", "removed")]


def test_streams(spark, tmp_path, rows):
    src, seen = f"{tmp_path}/in", []
    spark.sql("SELECT 'a' AS path, 'created' AS kind, timestamp'2025-01-01 00:00:00' AS at UNION ALL SELECT 'a', 'modified', timestamp'2025-01-01 00:00:00.1' UNION ALL SELECT 'a', 'removed', timestamp'2025-01-01 00:00:09' UNION ALL SELECT 'z', 'created', timestamp'2025-01-01 01:00:00'").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("path string, kind string, at timestamp").parquet(src)
    q = watch.debounced_stream(stream).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.kind, r.events) for r in spark.sql("SELECT * FROM bursts WHERE path = 'a' ORDER BY first").collect()] == [("modified", 2), ("removed", 1)]
    done = watch.sync_stream(stream, lambda df, k: seen.append((k, df.count())), f"{tmp_path}/c2")
    done.awaitTermination(60)
    assert seen == [(0, 4)]


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found", "p4_found", "p6_found"} <= set(entry.queries())


def stored(spark, path, nodes, edges):
    """A data folder with these columns of nodes and edges, the others null."""
    from graphloom import schema

    for name, ddl, (cols, data) in (("nodes", schema.NODE_SCHEMA, nodes), ("edges", schema.EDGE_SCHEMA, edges)):
        every = [c.split()[0] for c in ddl.split(", ")]
        spark.createDataFrame([tuple(dict(zip(cols.split(), r)).get(c) for c in every) for r in data], ddl).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_taint_over_five_links(spark, rows, tmp_path):
    import __spark_entry__ as entry

    names = ["a.read", "b", "c", "d", "e", "f.send", "g.send"]
    calls = [(k, names[k], names[k + 1], "calls") for k in range(6)] + [(10, "a.read", "z", "reads"), (11, "f.send", "z", "writes"), (12, "g.send", "z", "writes")]
    d = stored(spark, tmp_path, ("id kind name qualified_name updated_at", [(n, "function", n, n, 1) for n in [*names, "z"]]), ("id source target kind", calls))
    q = entry.queries()
    assert rows(q["taint_paths_full"](spark, d)) == [("a.read", "f.send", 5)] == rows(q["taint_roles_full"](spark, d))
    assert rows(q["taint_paths"](spark, d)) == []


def test_fuzzy_callers_count(spark, rows, tmp_path):
    import __spark_entry__ as entry

    nodes = [("r", "class", "Customer", "m::Customer", "repo/core/a.py", 2, 1), ("m", "method", "get", "m::Customer.get", "repo/core/a.py", 8, 1), ("r2", "class", "Order", "m::Order", "repo/core/b.py", 2, 1)]
    d = stored(spark, tmp_path, ("id kind name qualified_name file_path start_line updated_at", nodes), ("id source target kind", [(1, "m", "m", "calls")]))
    q = entry.queries()
    assert [r.route_id for r in q["routes_overview_full"](spark, d).collect()] == ["r2"] and len(q["routes_overview"](spark, d).collect()) == 2
    assert rows(q["trace_request_full"](spark, d)) == [("r", "/core/customer/{id}", 1)] and rows(q["cross_lang_edges_full"](spark, d)) == [("m", "r", "http_calls"), ("r", "m", "http_calls")]


def test_nulls_and_empties_count_for_nothing(spark, rows):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), (None, "b"), ("b", "c"), (None, None)], "source string, target string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "id string")
    assert rows(traverse.bfs(links, seeds, "both", 2)) == [("a", "b", 1), ("a", "c", 2)]
    assert rows(traverse.reachable(links, seeds)) == [("a",), ("b",), ("c",)]
    assert rows(traverse.closure(links)) == [("a", "c", 2)] and rows(traverse.chains(links, 3)) == [("a>b", 2), ("a>b>c", 3)]
    assert rows(traverse.simple_paths(links, seeds.dropna().distinct(), 2)) == [("a", "b", 1, "a>b"), ("a", "c", 2, "a>b>c")]
    ranks = algorithms.pagerank(seeds.unionByName(spark.createDataFrame([("b",), ("c",)], "id string")), links, rounds=3)
    assert math.isclose(sum(r.rank for r in ranks.collect()), 1.0, abs_tol=1e-9)
    none = links.limit(0)
    assert rows(algorithms.cycle_nodes(links)) == [] and rows(algorithms.cycle_nodes(none)) == [] and rows(algorithms.cycles_up_to(none)) == []
    assert rows(algorithms.pagerank(seeds.limit(0), none)) == [] and rows(algorithms.label_propagation(seeds, links, 1)) == [("a", "a")]
    assert rows(algorithms.betweenness(none, seeds.limit(0))) == [] and rows(traverse.shortest_paths(none, links.limit(0), 2)) == []
    sets = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), ("b", None), (None, ["x"]), ("c", [])], "id string, items array<string>")
    assert rows(similarity.clones(sets)) == [("a", "a", 1, 0), ("b", "b", 1, 0), ("c", "c", 1, 0)]
    assert rows(similarity.clones(sets.limit(0))) == []
    calls = spark.createDataFrame([(1, "GET", None), (2, None, "/a"), (3, "GET", "/"), (4, "GET", "")], "call_id int, method string, url string")
    routes = spark.createDataFrame([(9, "GET", None), (8, "GET", "/"), (7, "GET", "/{x}")], "route_id int, method string, url string")
    assert {(r.call_id, r.route_id) for r in crosstier.match_http(calls, routes).collect()} == {(3, 8), (4, 8)}
    assert rows(crosstier.match_http(calls.limit(0), routes)) == []


def test_null_columns_in_every_analysis(spark):
    """A graph of rows that know little more than their id goes through all analyses."""
    ddl = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, decorators string, framework string, visibility string, is_exported int, body string, updated_at long"
    bare = [(i, k, *[None] * 14) for i, k in (("a", "function"), ("b", "method"), ("c", None), (None, "function"))]
    e = spark.createDataFrame([(1, "a", "b", None, "calls", None), (2, "b", "gone", "x:y", "calls", None), (3, "a", None, None, None, None)], "id long, source string, target string, target_text string, kind string, provenance string")
    g = PropertyGraph(spark.createDataFrame(bare, ddl), e)
    hunks = spark.createDataFrame([("f", 1, 2), (None, 1, 2)], "file_path string, first int, last int")
    made = [
        analytics.dead_by_degree(g), analytics.dead_by_rules(g), analytics.dead_by_reach(g), analytics.one_entry_a_file(analytics.entry_points(g)), analytics.layer_violations(g, F.lit(1)), analytics.unit_metrics(g, F.col("file_path")), analytics.health(g),
        analytics.health_by_links(g), analytics.coverage(g), analytics.test_links(g), analytics.changed_symbols(g, hunks), analytics.change_impact(g, hunks), analytics.classify_references(g), analytics.resolve_references(g), analytics.security_findings(g),
        analytics.find_structure(g, "for_loop"), analytics.quality_gates(g), analytics.impact_prediction(g, g.nodes()), search.search_text(g, "a b"), search.cascade(g, "abc"), search.search_qualified(g, "kind:method"), search.rank_lite(g, "a"), storage.graph_stats(g), storage.def_index(g), storage.export_json(g),
    ]
    counts = [df.count() for df in made]
    assert counts[0] >= 1 and counts[-3] >= 4
    assert {r.id for r in search.search_qualified(g, "kind:method").collect()} == {"b"}


def test_published_graph(spark, rows, tmp_path):
    """The published graph gives what the tables give, reads kinds by partition, and is made anew where the tables change."""
    data = (("id kind name qualified_name updated_at", [("A ", "Class", "A", "a", 1), ("a", "class", "B", "b", 2), ("m", "METHOD", None, None, None), ("x", None, "x", "x", 1), (None, "class", "z", "z", 1)]), ("id source target kind", [(1, "a", "m", "Contains"), (1, " A", "m", "contains"), (2, "a", "gone", "calls"), (3, "lost", "m", "calls"), (4, "m", None, "calls"), (5, None, "m", "calls"), (6, "m", "x", None)]))
    d = stored(spark, tmp_path, *data)
    g, raw = PropertyGraph.load(spark, d), PropertyGraph(spark.read.parquet(f"{d}/nodes.parquet"), spark.read.parquet(f"{d}/edges.parquet"))
    assert g.node_types == raw.node_types and g.edge_types == raw.edge_types
    for f in (lambda x: x.nodes("kind", "name"), lambda x: x.nodes(), lambda x: x.edges("id"), lambda x: x.edges(kinds=["Calls"]), lambda x: x.links(), lambda x: x.links("contains")):
        assert rows(f(g)) == rows(f(raw))
    plan = g.edges(kinds=["contains"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan or "PartitionFilters: [kind" in plan
    assert "Exchange" not in plan and "Exchange" not in g.nodes("name", "kind")._jdf.queryExecution().executedPlan().toString()
    again = tmp_path / "again"
    again.mkdir()
    d2 = stored(spark, again, data[0], ("id source target kind", [(1, "a", "m", "contains")]))
    assert PropertyGraph.load(spark, d2).edges().count() == 1 and PropertyGraph.load(spark, d).edges("id").count() == 6 - 1


def test_bands_find_similar_sets(spark):
    """At least nine in ten of the exactly similar pairs are connected by the stars of the buckets."""
    r = random.Random(8)
    sets = []
    for k in range(30):
        base = [f"s{k}.{x}" for x in range(40)]
        sets += [(f"{k:02}{v}", sorted(set(base) - set(r.sample(base, v)) | {f"n{k}.{v}.{x}" for x in range(v)})) for v in range(4)]
    df = spark.createDataFrame(sets, "id string, items array<string>")
    exact = {(x.a, x.b) for x in similarity.similarity_links(df).collect()}
    assert exact == {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets), 2) if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))} and len(exact) > 100
    links = similarity.band_links(similarity.signatures(df))
    label = {x.id: x["class"] for x in similarity.components(df.select("id"), links.select("a", "b")).collect()}
    assert sum(label[a] == label[b] for a, b in exact) >= 0.9 * len(exact)
    near = {(x.a, x.b): x.similarity for x in similarity.estimated_links(similarity.signatures(df)).collect()}
    of = dict(sets)
    assert near and all(abs(v - len(set(of[a]) & set(of[b])) / len(set(of[a]) | set(of[b]))) < 0.2 for (a, b), v in near.items())


def test_watch_loop_survives_a_repeated_batch(spark, rows, tmp_path):
    from graphloom.operators.increment import Published

    p = Published(spark, f"file://{tmp_path}/watched")
    merge = watch.keep_newest(p)
    one, two = (spark.createDataFrame(x, "key string, value string") for x in ([("a", "1"), ("b", "3"), (None, "9")], [("a", "2"), ("b", "1"), ("c", "1"), ("c", "1")]))
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 0), (one.limit(0), 2)):
        merge(batch, number)
    assert rows(p.read("state").select("key", "value")) == [("a", "2"), ("b", "3"), ("c", "1")] and rows(p.read("output")) == []


def test_channels_and_remote_services(spark, rows, tmp_path):
    """Events sent and awaited, and remote services served and called, in planted bodies; a console sends nothing."""
    import duckdb

    import __spark_entry__ as entry

    bodies = {
        "a": "bus.emit('job.done', x); console.log('job.done')", "b": "bus.on('job.done', f); el.addEventListener(\"click\", g)", "c": "target.dispatchEvent(new CustomEvent('opened'))", "d": "@KafkaListener('orders') void f() {}", "e": "emit(name)",
        "f": "class S(order_pb2_grpc.OrderServicer):\n  pass", "g": "stub = order_pb2_grpc.OrderStub(channel)", "h": "class T extends OrderGrpc.OrderImplBase {}", "i": "OrderGrpc.newBlockingStub(c)", "j": "return 1", "k": None,
    }
    d = stored(spark, tmp_path, ("id kind name qualified_name body updated_at", [(k, "function", k, k, v, 1) for k, v in bodies.items()]), ("id source target kind", [(1, "a", "b", "calls")]))
    q, sql = entry.queries(), entry.oracle_sql()
    assert rows(q["channel_edges"](spark, d)) == [("a", "emits", "job.done"), ("b", "listens_on", "click"), ("b", "listens_on", "job.done"), ("c", "emits", "opened"), ("d", "listens_on", "orders")]
    assert rows(q["grpc_edges"](spark, d)) == [("f", "grpc_server", "Order"), ("g", "grpc_client", "Order"), ("h", "grpc_server", "Order"), ("i", "grpc_client", "Order")]
    con = duckdb.connect()
    for t in ("nodes", "edges"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    for name in ("channel_edges", "grpc_edges"):
        assert sorted(con.execute(sql[name]).fetchall()) == [tuple(r) for r in rows(q[name](spark, d))]
