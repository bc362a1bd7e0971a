"""Search over symbols: full text with BM25, pattern, edit distance, cascades of these, and rankings from several signals.

Null columns are empty texts; a query without terms finds nothing; an empty graph gives empty results; ties in ranking keep
their equal ranks, and wherever a place is given the smaller id comes first."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import traverse

K1, B = 1.2, 0.75
#: Queries of a vector search that go to the executors at a time.
QUERY_BLOCK = 2_000


def _text(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def terms_of(query: str) -> list[str]:
    """Terms in lower case, a ``field:`` before them left off."""
    return [t for t in (re.sub(r"^\w+:", "", w).strip('"*').lower() for w in query.split()) if t]


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9_]+"), lambda t: t != "")


def search_text(graph: PropertyGraph, query: str, *keep: str) -> DataFrame:
    """id, rank and ``keep`` of symbols in which every term begins some word; rank is BM25, higher is better.

    Words, lengths and document counts come from one pass; nothing but the counts of the few terms leaves the cluster."""
    want = terms_of(query)
    cols = ["name", "qualified_name", "docstring", "signature", *keep]
    n = graph.nodes(*cols)
    if not want:
        return n.limit(0).select("id", F.lit(0.0).alias("rank"), *keep)
    t = n.withColumn("t", tokens(_text("name", "qualified_name", "docstring", "signature")))
    begins = lambda w: lambda x: F.startswith(x, F.lit(w))
    hits = [F.size(F.filter("t", begins(w))) for w in want]
    t = t.select("id", *keep, F.size("t").alias("len"), *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    stat = t.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"h{i}") > 0, 1)).alias(f"d{i}") for i in range(len(want))]).first()
    avg = stat["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(want)):
        idf = math.log(1 + (stat["n"] - stat[f"d{i}"] + 0.5) / (stat[f"d{i}"] + 0.5))
        tf = F.col(f"h{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avg))
    every = reduce(lambda a, b: a & b, [F.col(f"h{i}") > 0 for i in range(len(want))])
    return t.filter(every).select("id", score.alias("rank"), *keep)


def search_like(graph: PropertyGraph, query: str, *keep: str) -> DataFrame:
    n = graph.nodes("name", "qualified_name", *keep)
    q = F.lit(f"%{query}%")
    return n.filter(F.coalesce(F.ilike("name", q), F.lit(False)) | F.coalesce(F.ilike("qualified_name", q), F.lit(False))).select("id", *keep)


def search_fuzzy(graph: PropertyGraph, query: str, distance: int = 2, *keep: str) -> DataFrame:
    """id, distance of names with the same first letter within an edit distance; queries under three letters find nothing."""
    low = query.lower()
    n = graph.nodes("name", *keep)
    if len(low) < 3:
        return n.limit(0).select("id", F.lit(0).alias("distance"), *keep)
    near = n.filter(F.lower(F.substring("name", 1, 1)) == low[0]).withColumn("distance", F.levenshtein(F.lower("name"), F.lit(low), distance))
    return near.filter("distance >= 0").select("id", "distance", *keep)


def cascade(graph: PropertyGraph, query: str) -> DataFrame:
    """id, tier of the first of full text (1), pattern (2), edit distance (3) that finds anything; the tiers are one plan."""
    every = (
        search_text(graph, query).select("id", F.lit(1).alias("tier"))
        .unionByName(search_like(graph, query).select("id", F.lit(2).alias("tier")))
        .unionByName(search_fuzzy(graph, query).select("id", F.lit(3).alias("tier")))
    )
    least = every.agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(least), "tier", "left_semi")  # one row


_FILTERS = {"kind": "kind", "lang": "language", "language": "language", "path": "file_path", "visibility": "visibility", "framework": "framework"}


def search_qualified(graph: PropertyGraph, query: str) -> DataFrame:
    """id of symbols under ``kind: lang: path: visibility: framework:`` filters and the text left; no text: the filters alone."""
    filters, rest = [], []
    for w in query.split():
        k, _, v = w.partition(":")
        if v and k.lower() in _FILTERS:
            filters.append((_FILTERS[k.lower()], v))
        else:
            rest.append(w)
    cols = [c for c, _ in filters]
    df = search_text(graph, " ".join(rest), *cols) if rest else graph.nodes(*cols)
    for c, v in filters:
        df = df.filter(F.contains(c, F.lit(v)) if c == "file_path" else F.lower(c) == v.lower())
    return df.select("id")


def search_substring(graph: PropertyGraph, query: str) -> DataFrame:
    """id, found_in: name before qualified name before documentation."""
    q = F.lit(query.lower())
    n = graph.nodes("name", "qualified_name", "docstring")
    where = F.coalesce(*[F.when(F.contains(F.lower(c), q), c) for c in ("name", "qualified_name", "docstring")])
    return n.select("id", where.alias("found_in")).filter("found_in is not null")


def _share(text: Column, want: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in want]) / len(want)


# Weights of the six signals.
LITE_WEIGHTS = {"bm25": 0.25, "qualified_name": 0.20, "name": 0.20, "docstring": 0.15, "path": 0.10, "popularity": 0.10}


def rank_lite(graph: PropertyGraph, query: str) -> DataFrame:
    """id, score of what full text finds, from six signals."""
    want, q = terms_of(query), " ".join(terms_of(query))
    c = search_text(graph, query, "name", "qualified_name", "docstring", "signature", "file_path")
    degree = graph.edges().filter("target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    c = c.join(degree, "id", "left")
    qn, nm = F.lower(F.coalesce("qualified_name", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    whole = F.lit(q)
    s_q = F.when(F.contains(qn, whole), len(q) / F.length(qn) * 0.8 + 0.2).otherwise(_share(qn, want) * 0.6)
    s_n = F.when(nm == whole, 1.0).when(F.contains(nm, whole), len(q) / F.length(nm) * 0.7 + 0.3).otherwise(_share(nm, want) * 0.5)
    s_d = _share(_text("docstring", "signature"), want)
    s_p = _share(F.lower(F.coalesce("file_path", F.lit(""))), want)
    s_c = F.least(F.log10(1 + F.coalesce("in_degree", F.lit(0)).cast("double")) / 3, F.lit(1.0))
    s_b = 1 / (1 + F.exp(5 - F.col("rank")))
    w = LITE_WEIGHTS
    score = s_b * w["bm25"] + s_q * w["qualified_name"] + s_n * w["name"] + s_d * w["docstring"] + s_p * w["path"] + s_c * w["popularity"]
    return c.select("id", F.round(score, 6).alias("score"))


# Weights of the eleven signals.
FULL_WEIGHTS = {"bm25": 1.0, "qualified_name": 1.5, "docstring": 0.8, "ast_similarity": 1.2, "signature": 1.0, "clone": 0.8, "module": 0.7, "diffusion": 1.0, "callers": 1.2, "centrality": 0.6, "dataflow": 0.5}


def rank_full(graph: PropertyGraph, query: str, weights: dict[str, float] | None = None, origins: int = 5) -> DataFrame:
    """id, score: weighted mean of eleven signals of what full text finds. Graph signals spread from the ``origins`` candidates whose
    names fit best (the smallest ids of equal ones): a parameter of the measure, all candidates are ranked."""
    w = FULL_WEIGHTS | (weights or {})
    want = terms_of(query)
    c = search_text(graph, query, "name", "qualified_name", "docstring", "signature", "file_path", "body")
    low = {k: F.lower(F.coalesce(k, F.lit(""))) for k in ("name", "qualified_name", "docstring", "signature", "file_path", "body")}
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    top = c.select("id", _share(low["name"], want).alias("fit"), folder.alias("folder")).orderBy(F.desc("fit"), "id").limit(origins)
    links = graph.links("calls", "references", "imports")
    near = traverse.bfs(links, top, "both", 2).groupBy("id").agg(F.min("depth").alias("near"))
    flow = traverse.bfs(graph.links("reads", "writes"), top, "both", 1).groupBy("id").agg(F.min("depth").alias("flow"))
    alike = graph.edges(kinds=["similar_to"]).join(top.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.lit(1).alias("alike")).distinct()
    degree = graph.edges().filter("target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    c = c.join(near, "id", "left").join(flow, "id", "left").join(alike, "id", "left").join(degree, "id", "left").join(top.select("folder", F.lit(1).alias("same")).distinct(), folder == F.col("folder"), "left")
    top_rank = c.agg(F.max("rank")).first()[0] or 1.0
    signal = {
        "bm25": F.col("rank") / top_rank,
        "qualified_name": _share(low["qualified_name"], want),
        "docstring": _share(low["docstring"], want),
        "ast_similarity": _share(low["body"], want),
        "signature": _share(low["signature"], want),
        "clone": F.coalesce("alike", F.lit(0)),
        "module": F.coalesce("same", F.lit(0)),
        "diffusion": F.coalesce(1 / (1 + F.col("near")), F.lit(0.0)),
        "callers": F.when(F.col("near") == 1, 1.0).otherwise(0.0),
        "centrality": F.least(F.log10(1 + F.coalesce("in_degree", F.lit(0)).cast("double")) / 3, F.lit(1.0)),
        "dataflow": F.coalesce(1 / (1 + F.col("flow")), F.lit(0.0)),
    }
    total = reduce(lambda a, b: a + b, [signal[k] * w[k] for k in signal]) / sum(w[k] for k in signal)
    return c.select("id", F.round(total, 6).alias("score"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank: the ``k`` nearest of all rows to each query by cosine, ties by id; a query does not find itself.

    Queries go out in blocks; each batch of rows gives its own best ``k`` of each query, so what is shuffled grows with the
    batches, not with the rows. Null, empty and zero vectors find and are found by nothing; vectors of another length neither."""
    from pyspark.sql import Window

    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out, block = [], []

    def search(block: list[tuple[int, list[float]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for size in {len(v) for _, v in sent.value}:
                q = [(i, v) for i, v in sent.value if len(v) == size]
                m = np.array([v for _, v in q])
                norm = np.linalg.norm(m, axis=1)
                ok = norm > 0
                by_size[size] = np.array([i for i, _ in q])[ok], m[ok] / norm[ok, None]
            for b in batches:
                ids, vs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for size, (qid, q) in by_size.items():
                    at = [n for n, v in enumerate(vs) if v is not None and len(v) == size and None not in v]
                    if not at or not len(qid):
                        continue
                    m = np.array([vs[n] for n in at])
                    norm = np.linalg.norm(m, axis=1)
                    ok = norm > 0
                    m, rid = m[ok] / norm[ok, None], ids[at][ok]
                    s = np.round(q @ m.T, 9)
                    for n in range(len(qid)):
                        order = np.lexsort((rid, -s[n]))
                        order = order[rid[order] != qid[n]][:k]
                        found.append((np.full(len(order), qid[n]), rid[order], s[n][order]))
                a = [np.concatenate(x) if found else np.array([]) for x in zip(*found)] if found else [np.array([], dtype="int64")] * 2 + [np.array([])]
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.float64())], names=["query_id", "id", "similarity"])

        return rows.mapInArrow(run, "query_id long, id long, similarity double")

    for r in queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).toLocalIterator():
        if r[1] and None not in r[1]:
            block.append((r[0], list(r[1])))
        if len(block) >= QUERY_BLOCK:
            out.append(search(block))
            block = []
    if block or not out:
        out.append(search(block))
    every = reduce(lambda a, b: a.unionByName(b), out)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
