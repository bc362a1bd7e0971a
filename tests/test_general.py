"""Orphan references, increments and snapshots on small tables with nulls, repeats, ties and none at all."""

import datetime as dt

import numpy as np
import pytest

from graphloom.operators import increment, orphans, snapshots


def test_match_rules(spark, rows):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, None, None), (5, "b", "y"), (6, "z", "x"), (7, "a", "q"), (7, "a", "q")], "n int, k string, l string")
    targets = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x"), (None, "w")], "k string, l string")
    orphan = lambda m: sorted({r.n for r in orphans.find_orphans(refs, targets, ["k", "l"], m).collect()})
    assert orphan("simple") == [6, 7]
    assert orphan("partial") == [6, 7]
    assert orphan("full") == [2, 3, 6, 7]
    assert orphan("first") == [6]
    masks = {r.n: r.null_mask for r in orphans.find_orphans(refs, targets.limit(0), ["k", "l"], "partial").collect()}
    assert masks == {1: "11", 2: "10", 3: "01", 5: "11", 6: "11", 7: "11"}
    with pytest.raises(ValueError):
        orphans.find_orphans(refs, targets, ["k"], "fuzzy")


def test_orphan_edges(spark, rows):
    ts = lambda s: dt.datetime.fromisoformat(s)
    hashed = orphans.text_id
    text = "f.py:f.py::gone"
    nodes = spark.createDataFrame([("A1", 1000), ("a1", 2000), ("b2", 1000), ("c3", 1000), (None, 5)], "id string, updated_at long")
    tomb = spark.createDataFrame([("B2", ts("1970-01-01T00:00:01")), ("c3", ts("1970-01-01T00:00:00.5")), ("zz", None)], "node_id string, removed_at timestamp")
    ext = spark.createDataFrame([("EXT", "p", "q")], "id string, qualified_name string, package string")
    edges = spark.createDataFrame(
        [(1, " A1 ", None, ts("2025-03-01T00:00:00")), (2, "b2", None, None), (3, "c3", None, None), (4, "ext", None, None), (5, " ", text, ts("2025-04-02T00:00:00")), (6, None, None, None), (7, "nope", "x", None), (7, "nope", "x", None)],
        "id long, target string, target_text string, seen_at timestamp",
    )
    assert rows(orphans.orphan_edges(nodes, edges, tomb, ext).select("edge_id", "month_seen")) == [(2, "unknown"), (5, "2025-04"), (7, "unknown")]
    assert hashed is not None
    assert rows(orphans.orphan_edges(nodes.limit(0), edges.limit(0), tomb.limit(0), ext.limit(0))) == []


FILES = "path string, content_hash string, language string, indexed_at long, size long, modified_at long"
LISTING = "path string, content_hash string, size long, modified_at long, listed_at timestamp"


def test_paths_to_index(spark, rows):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    runs = spark.createDataFrame([(1, 100, 200, " OK "), (2, 300, 400, "failed"), (3, 500, None, "success"), (4, 600, 700, "SUCCESS")], "run_id int, started_at long, finished_at long, status string")
    files = spark.createDataFrame(
        [("same", "AA", "x", 150, 1, 1), ("same", "AA", "x", 150, 1, 1), ("failed", "bb", "x", 350, 1, 1), ("crashed", "bb", "x", 550, 1, 1), ("older", "new", "x", 650, 1, 1), ("older", "old", "x", 150, 1, 1), ("bare", "h", "x", 150, 7, 9), ("bare2", "h", "x", 150, 7, 9), (None, "h", "x", 150, 7, 9)],
        FILES,
    )
    listing = spark.createDataFrame(
        [("same", "sha256:aa", 5, 5, at(1)), ("failed", "bb", 1, 1, at(1)), ("crashed", "bb", 1, 1, at(1)), ("older", "old", 1, 1, at(1)), ("older", "new", 1, 1, at(2)), ("bare", None, 7, 1_700_000_000_000, at(0)), ("bare", " ", 7, 9, at(1)), ("bare2", None, 8, 9, at(1)), ("fresh", None, 1, 1, at(1)), (None, "x", 1, 1, at(1))],
        LISTING,
    )
    want = [("bare2", "changed"), ("crashed", "added"), ("failed", "added"), ("fresh", "added")]
    for depth in (None, 2, 4):
        assert rows(increment.paths_to_index(files, runs, listing, depth)) == want
    assert len(rows(increment.paths_to_index(files.limit(0), runs.limit(0), listing))) == 7
    assert rows(increment.paths_to_index(files, runs, listing.limit(0))) == []


def test_tree_opens_only_what_differs(spark, rows):
    a = spark.createDataFrame([(f"k{i}", "v") for i in range(300)], "key string, value string")
    b = spark.createDataFrame([(f"k{i}", "v" if i != 7 else "w") for i in range(300)], "key string, value string")
    leaves = increment.changed_leaves(increment.merkle_leaves(a, 4), increment.merkle_leaves(b, 4), 4)
    assert leaves.count() == 1
    assert rows(increment.changed_records(b, a, 4)) == [("k7", "w", "changed")]
    assert rows(increment.changed_records(a, a, 4)) == []


def test_published_runs_survive_failure(spark, tmp_path, rows):
    p = increment.Published(spark, f"file://{tmp_path}/state")
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string")
    two = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", None)], "key string, value string")
    assert p.version() is None
    p.run(one, lambda changed: changed.select("key"), 2)
    assert rows(p.read("output")) == [("a",), ("b",)]

    def broken(changed):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        p.run(two, broken, 2)
    assert p.version() == 1
    p.run(two, lambda changed: changed.select("key"), 2)  # nothing skipped, nothing repeated
    assert rows(p.read("output")) == [("b",), ("c",), ("d",)]
    p.run(two, lambda changed: changed.select("key"), 2)
    assert rows(p.read("output")) == []


def test_snapshots(spark, rows):
    n = spark.createDataFrame(
        [(1, "a", "f( x )"), (1, "a", "f( x )"), (1, "b", None), (1, "c", "g()"), (2, "a", "f(x)\n"), (2, "b", ""), (2, "d", "h()"), (4, "d", "h(y)"), (1, None, "z"), (None, "q", "z")],
        "snap int, qualified_name string, signature string",
    )
    e = spark.createDataFrame([(1, "a", "b", "Calls"), (2, "a", "b", "calls"), (2, "a", None, "calls"), (4, "a", "b", "extends")], "snap int, source_name string, target_name string, kind string")
    assert snapshots.snap_numbers(n, e) == [1, 2, 3, 4]
    want = sorted(
        [(2, "node", "c", "removed"), (2, "node", "d", "added"), (3, "node", "a", "removed"), (3, "node", "b", "removed"), (3, "node", "d", "removed"), (4, "node", "d", "added"), (3, "edge", "a>b>calls", "removed"), (4, "edge", "a>b>extends", "added")], key=repr
    )
    for size in (16_384, 1):
        assert rows(snapshots.changes(snapshots.graph_items(n, e), [1, 2, 3, 4], size)) == want
    assert rows(snapshots.changes(snapshots.graph_items(n.limit(0), e.limit(0)), [])) == []


def test_ordinals_persist(spark):
    """A state that is kept and advanced later gives known keys the ordinals they had."""
    snap = lambda *k: spark.createDataFrame([("node", x, v) for x, v in k], "entity string, item_key string, value string")
    names = lambda df: snapshots.Chunk(df.filter("change_kind is null").first().names).names
    one = snapshots.advance(None, snap(("b", "1"), ("d", "1"), ("b", "1")), 1, 1)
    assert names(one) == ["b", "d"]
    state = one.filter("change_kind is null").select("entity", "chunk", "names", "bits", "digests")
    two = snapshots.advance(state, snap(("a", "1"), ("b", "1"), ("c", None), ("d", "2"), ("b", "0")), 1, 2)
    assert names(two) == ["b", "d", "a", "c"]
    assert {(r.item_key, r.change_kind) for r in two.filter("change_kind is not null").collect()} == {("a", "added"), ("c", "added"), ("d", "changed")}


def test_bitmaps():
    """Every kind of container against sets, through bytes; a dense or constant set takes a few bytes."""
    r = np.random.default_rng(3)
    sets = [np.zeros(0, dtype=int), np.arange(70_000), np.arange(0, 140_000, 2), np.array([5, 65_535, 65_536, 200_000]), r.choice(200_000, 9_000, replace=False), r.choice(70_000, 50_000, replace=False), np.arange(100, 60_000)]
    maps = [snapshots.Bitmap.from_bytes(snapshots.Bitmap.of(x).to_bytes()) for x in sets]
    assert {k for m in maps for k, _ in m.containers.values()} == {0, 1, 2}
    for x, a in zip(sets, maps):
        assert a.ordinals().tolist() == sorted(x.tolist())
        for y, b in zip(sets, maps):
            assert a.and_not(b).ordinals().tolist() == sorted(set(x.tolist()) - set(y.tolist()))
            assert a.intersect(b).ordinals().tolist() == sorted(set(x.tolist()) & set(y.tolist()))
    assert len(maps[1].to_bytes()) < 40


def test_runs_can_be_lost_at_every_step(spark, tmp_path, rows, monkeypatch):
    """A run that dies before or after any write is repeated as if it had never been; a source that moves meanwhile is neither skipped nor repeated."""
    source = f"file://{tmp_path}/source"
    put = lambda *k: spark.createDataFrame(list(k), "key string, value string").write.mode("overwrite").parquet(source)
    read = lambda: spark.read.parquet(source)
    p = increment.Published(spark, f"file://{tmp_path}/state")
    keys = lambda changed: changed.select("key", "change")
    put(("a", "1"), ("b", "1"), ("c", "1"))
    p.run(read(), keys, 2)
    real = {"_write": increment.Published._write, "_switch": increment.Published._switch}
    put(("a", "1"), ("b", "2"), ("d", "1"))
    for name, at in (("_write", 0), ("_write", 1), ("_write", 2), ("_switch", 0)):
        for after in (False, True):
            if name == "_switch" and after:
                continue
            calls = []

            def dies(self, *x, name=name, at=at, after=after, calls=calls):
                calls.append(1)
                if len(calls) - 1 == at:
                    if after:
                        real[name](self, *x)
                    raise RuntimeError("lost")
                return real[name](self, *x)

            monkeypatch.setattr(increment.Published, name, dies)
            with pytest.raises(RuntimeError):
                p.run(read(), keys, 2)
            monkeypatch.setattr(increment.Published, name, real[name])
            assert p.version() == 1 and rows(p.read("state").select("key", "value")) == [("a", "1"), ("b", "1"), ("c", "1")]

    def moves(self, version, part, df):
        real["_write"](self, version, part, df)
        put(("a", "9"), ("b", "2"), ("d", "1"), (f"late-{part}", "1"))

    monkeypatch.setattr(increment.Published, "_write", moves)
    p.run(read(), keys, 2)
    monkeypatch.setattr(increment.Published, "_write", real["_write"])
    assert rows(p.read("output")) == [("b", "changed"), ("d", "added")]
    p.run(read(), keys, 2)
    assert rows(p.read("output")) == [("a", "changed"), ("late-tree", "added")]
    p.run(read(), keys, 4)  # another depth: the tree is made anew from the state
    assert rows(p.read("output")) == []


def test_only_touched_ranges_are_written(spark, tmp_path, rows):
    p = increment.Published(spark, f"file://{tmp_path}/state")
    many = [(f"k{i}", "v", None) for i in range(3_000)]
    make = lambda x: spark.createDataFrame(x, "key string, value string, weak string")
    p.run(make(many), lambda c: c.select("key"), 4)
    assert len(p._ranges(1)) == 16
    p.run(make([("k7", "w", None), *[x for x in many if x[0] not in ("k7", "k8")], ("new", None, "1@2")]), lambda c: c.select("key", "change"), 4)
    assert rows(p.read("output")) == [("k7", "changed"), ("new", "added")] and 1 <= len(p._ranges(2)) <= 3 < len(p.read("state").inputFiles())
    p.run(make([("k7", None, "5@5"), *[x for x in many if x[0] not in ("k7", "k8")], ("new", None, "1@2")]), lambda c: c.select("key", "change"), 4)
    assert rows(p.read("output")) == [("k7", "changed")] and p.read("state").count() == 3_000
    p.run(make([("k7", None, "5@5"), *[x for x in many if x[0] not in ("k7", "k8")], ("new", None, "1@2")]), lambda c: c.select("key", "change"), 6)  # more records: finer ranges
    assert rows(p.read("output")) == [] and len(p._ranges(4)) > 250 and p.read("state").count() == 3_000
    p.run(make([x for x in many if x[0] != "k9"]), lambda c: c.select("key", "change"), 6)
    assert rows(p.read("output")) == [("k7", "changed"), ("k8", "added")] and len(p._ranges(5)) < 6 and p.read("state").count() == 2_999


