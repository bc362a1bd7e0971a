"""Queries of what is kept between runs: snapshots, incremental runs, transactions and the watch loop, each in a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cluster import shared_dir
from graphloom.graph import PropertyGraph
from graphloom.operators import storage
from graphloom.operators.increment import Published
from graphloom.plans.base import Query, graph_sql
from graphloom.sources.tables import table
from graphloom.streaming import watch

#: The listing as it was seen before this time is what the first run gets.
UNTIL = "2025-12-01 00:00:00"


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """key, value of each listing row, a later one larger."""
    micros = F.lpad(F.unix_micros(F.col("listed_at").cast("timestamp")).cast("string"), 20, "0")
    return table(spark, d, "file_listing").filter("path is not null").select(F.col("path").alias("key"), F.concat_ws("@", micros, F.coalesce(F.col("modified_at").cast("string"), F.lit(""))).alias("value"), "listed_at")


def _listing(spark: SparkSession, d: str, until: str | None = None) -> DataFrame:
    rows = _events(spark, d)
    rows = rows.filter(F.col("listed_at") < F.lit(until).cast("timestamp_ntz")) if until else rows
    return rows.groupBy("key").agg(F.max("value").alias("value"))


def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the graph, the second of its classes and what they contain, listed with what they hold."""
    g = PropertyGraph.load(spark, d)
    folder = _folder(spark, "snapshots")
    storage.snapshot_create(g, folder, "full")
    part = PropertyGraph(g.nodes(*g.node_types).filter("kind = 'class'"), g.edges("id", "target_text", "provenance", kinds=["contains"]), clean=True)
    storage.snapshot_create(part, folder, "classes")
    out = None
    for name in storage.snapshot_list(spark, folder):
        n, e = (spark.read.parquet(f"{folder}/{name}/{what}").select(F.lit(what).alias("what")) for what in ("nodes", "edges"))
        one = n.unionByName(e).agg(*[F.count(F.when(F.col("what") == what, 1)).alias(what) for what in ("nodes", "edges")]).select(F.lit(name).alias("snapshot"), "nodes", "edges")
        out = one if out is None else out.unionByName(one)
    return out


def sync(spark: SparkSession, d: str) -> DataFrame:
    """What the second of two incremental runs processes: the first has seen the listing up to UNTIL."""
    p = Published(spark, _folder(spark, "sync"))
    keep = lambda changed: changed.select(F.col("key").alias("path"), "change")
    p.run(_listing(spark, d, UNTIL), keep)
    p.run(_listing(spark, d), keep)
    return p.read("output")


def transaction(spark: SparkSession, d: str) -> DataFrame:
    """Records in force after a commit, after a run that fails while it processes, and after the next commit."""
    p = Published(spark, _folder(spark, "transaction"))
    keep = lambda changed: changed.select("key")
    steps = []

    def note(step: str) -> None:
        steps.append((step, p.version(), p.read("state").count()))

    p.run(_listing(spark, d, UNTIL), keep)
    note("committed")

    def fails(changed: DataFrame) -> DataFrame:
        raise InterruptedError("rolled back")

    try:
        p.run(_listing(spark, d), fails)
    except InterruptedError:
        note("rolled back")
    p.run(_listing(spark, d), keep)
    note("committed again")
    return spark.createDataFrame(steps, "step string, version long, records long")


def watch_loop(spark: SparkSession, d: str) -> DataFrame:
    """The listing as a stream of files, merged batch by batch; what is in force when it has run dry."""
    folder = _folder(spark, "watch")
    _events(spark, d).select("key", "value").repartition(2).write.parquet(f"{folder}/in")
    p = Published(spark, f"{folder}/state")
    stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    watch.sync_stream(stream, watch.keep_newest(p), f"{folder}/checkpoint").awaitTermination()
    state = p.read("state")
    if state is None:
        state = spark.createDataFrame([], "key string, value string")
    return state.select(F.col("key").alias("path"), F.substring_index("value", "@", -1).alias("modified_at"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (snapshot_list, sync, transaction, watch_loop)}

_BEFORE = f"SELECT path, max((listed_at, modified_at)) AS v FROM file_listing WHERE path IS NOT NULL AND listed_at < TIMESTAMP '{UNTIL}' GROUP BY 1"
_NOW = "SELECT path, max((listed_at, modified_at)) AS v FROM file_listing WHERE path IS NOT NULL GROUP BY 1"

SQL: dict[str, str] = {
    "snapshot_list": graph_sql(
        "SELECT 'full' AS snapshot, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges UNION ALL SELECT 'classes', (SELECT count(*) FROM n WHERE kind = 'class'), (SELECT count(*) FROM e WHERE kind = 'contains')"
    ),
    "sync": f"SELECT n.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM ({_NOW}) n LEFT JOIN ({_BEFORE}) b ON b.path = n.path WHERE b.path IS NULL OR b.v <> n.v",
    "transaction": f"SELECT step, version, records FROM (SELECT 'committed' AS step, 1 AS version, (SELECT count(*) FROM ({_BEFORE})) AS records UNION ALL SELECT 'rolled back', 1, (SELECT count(*) FROM ({_BEFORE})) UNION ALL SELECT 'committed again', 2, (SELECT count(*) FROM ({_NOW})))",
    "watch_loop": f"SELECT path, coalesce(CAST(v[2] AS VARCHAR), '') AS modified_at FROM ({_NOW})",
}
