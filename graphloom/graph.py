"""A property graph as two DataFrames that are read no wider than a query needs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cluster import freeing, norm_id, norm_kind, shared_dir
from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA, columns
from graphloom.sources.tables import table

NODE_COLUMNS, EDGE_COLUMNS = columns(NODE_SCHEMA), columns(EDGE_SCHEMA)


#: Whether both ends of a published edge have a row.
KNOWN = ("_source_known", "_target_known")


def _fingerprint(*tables: DataFrame) -> str:
    """Names, sizes and times of the files behind tables; one listing a folder."""
    spark = tables[0].sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for t in tables:
        for folder in sorted({f.rpartition("/")[0] for f in t.inputFiles()}):
            at = path(folder)
            seen += sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in at.getFileSystem(conf).listStatus(at) if x.isFile())
        seen.append(t.schema.simpleString())
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


class PropertyGraph:
    """Nodes: one row per id, the one with the highest updated_at, kinds in lower case. Edges: one row per id, ends
    normalised; a blank target is taken from target_text. Rows without id (nodes) or source (edges) are dropped.

    ``clean`` graphs are taken as they are. A graph that is loaded is cleaned once and published in the shared folder, by kind, where
    every later query over the same files reads it: no query removes repeats or looks for missing ends again, and kinds reach the scan."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, clean: bool = False) -> None:
        self._nodes, self._edges, self._clean = nodes, edges, clean
        self.node_types = {k: v for k, v in nodes.dtypes}
        self.edge_types = {k: v for k, v in edges.dtypes if k not in KNOWN}
        self._published = set(KNOWN) <= set(edges.columns)

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """The graph of a folder's tables, published if it is not yet."""
        nodes, edges = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")
        folder = f"{shared_dir(spark)}/graph-{_fingerprint(nodes, edges)}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        raw = cls(nodes, edges)
        made = raw._cleaned()
        if not fs.exists(path(folder)):
            new = f"{folder}.{uuid.uuid4().hex}"
            with freeing(spark):
                for name, df in zip(("nodes", "edges"), made):
                    df.hint("rebalance", "kind").write.partitionBy("kind").parquet(f"{new}/{name}")  # a hot kind is split
            if not fs.rename(path(new), path(folder)):  # another run was first
                fs.delete(path(new), True)
        read = [spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in zip(("nodes", "edges"), made)]
        return cls(*read, clean=True)

    def _cleaned(self) -> tuple[DataFrame, DataFrame]:
        """All columns of nodes, one row an id; edges without repeats and without the time of delivery, and whether their ends are known."""
        nodes = self.nodes(*[c for c in self._nodes.columns if c not in ("id", "kind")], "kind")
        ids = self.nodes()
        e = self.edges(*[c for c in self._edges.columns if c != "seen_at"])
        for end, flag in zip(("source", "target"), KNOWN):
            e = e.join(ids.select(F.col("id").alias(end), F.lit(True).alias(flag)), end, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        return nodes, e.select(*[c for c in e.columns if c != "kind"], "kind")

    def nodes(self, *cols: str) -> DataFrame:
        """id and ``cols``. The newest row of each id is found by partial aggregation over just these columns."""
        cols = [c for c in dict.fromkeys(cols) if c != "id" and c in self.node_types]
        if self._clean:
            return self._nodes.select("id", *cols)
        picked = self._nodes.select(norm_id("id").alias("id"), F.coalesce("updated_at", F.lit(-(2**62))).alias("_at"), *[norm_kind("kind").alias("kind") if c == "kind" else F.col(c) for c in cols])
        picked = picked.filter("id is not null")
        if not cols:
            return picked.select("id").distinct()
        if len(cols) == 1:
            return picked.groupBy("id").agg(F.max_by(cols[0], "_at").alias(cols[0]))
        return picked.groupBy("id").agg(F.max_by(F.struct(*cols), "_at").alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])

    def edges(self, *cols: str, kinds: Iterable[str] | None = None) -> DataFrame:
        """source, target, kind and ``cols`` of each edge once; ``kinds`` reach the scan as a filter on the raw spelling."""
        cols = [c for c in dict.fromkeys(cols) if c not in ("source", "target", "kind")]
        if self._clean:
            e = self._edges.select("source", "target", "kind", *cols)
            return e if kinds is None else e.filter(F.col("kind").isin([k.lower() for k in kinds]))
        e = self._edges
        if kinds is not None:
            e = e.filter(norm_kind("kind").isin([k.lower() for k in kinds]))
        text = F.when(F.btrim(F.col("target_text"), F.lit(" \t\r\n")) != "", F.substring(F.sha2("target_text", 256), 1, 32))
        made = {"source": norm_id("source"), "target": F.coalesce(norm_id("target"), text), "kind": norm_kind("kind")}
        keep = ["id", *made, *[c for c in cols if c != "id"]]
        e = e.select(*[made[c].alias(c) if c in made else F.col(c) for c in keep]).filter("source is not null")
        return e.distinct().select("source", "target", "kind", *cols)

    def links(self, *kinds: str) -> DataFrame:
        """Distinct source, target pairs of ``kinds`` (any if none) whose both ends have a row."""
        if self._published:
            e = self._edges.filter(" and ".join(KNOWN))
            return (e.filter(F.col("kind").isin([k.lower() for k in kinds])) if kinds else e).select("source", "target").distinct()
        ids = self.nodes()
        e = self.edges(kinds=kinds or None).select("source", "target").distinct().filter("target is not null")
        e = e.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        return e.select("source", "target")
