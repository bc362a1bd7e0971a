"""References to records that do not exist.

Method: references are grouped by their null mask; each mask is anti-joined on its own non-null columns, under the
declared match rule:

* ``simple``: a reference with any null column is no reference (SQL's MATCH SIMPLE);
* ``partial``: the non-null columns must exist together in one target row; all null is no reference;
* ``full``: all columns null is no reference, some null is an orphan, none null must exist;
* ``first``: the first non-null column decides; all null is no reference.

Keys of targets are made distinct first (partial aggregation on each mapper), so a hot target costs one row a mapper;
hot keys on the reference side are split by adaptive execution, which may split the left side of an anti join.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import BROADCAST_ROWS, norm_id, small, utc_micros

MATCH = ("simple", "partial", "full", "first")


def _masks(n: int, match: str) -> list[tuple[bool | None, ...]]:
    """Masks that need a join: True = not null, False = null, None = either."""
    if match == "first":
        return [(*(False,) * k, True, *(None,) * (n - k - 1)) for k in range(n)]
    if match in ("simple", "full"):
        return [(True,) * n]
    return [m for m in product((True, False), repeat=n) if any(m)]


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", known: DataFrame | None = None) -> DataFrame:
    """Rows of ``refs`` whose ``keys`` lead to no row of ``targets`` (columns named alike), nor of ``known``, a side table of
    the same columns that is broadcast while it is proven small. Adds ``null_mask``, e.g. '10' (1: not null)."""
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    mask_text = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys])
    refs = refs.withColumn("null_mask", mask_text)
    out = []
    for mask in _masks(len(keys), match):
        held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if m else F.col(k).isNull() for k, m in zip(keys, mask) if m is not None])
        on = [k for k, m in zip(keys, mask) if m]
        part = refs.filter(held)
        if known is not None:
            part = part.join(small(known.select(on).dropna().distinct(), BROADCAST_ROWS), on, "left_anti")
        out.append(part.join(targets.select(on).dropna().distinct(), on, "left_anti"))
    if match == "full" and len(keys) > 1:
        nulls = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("int") for k in keys])
        out.append(refs.filter((nulls > 0) & (nulls < len(keys))))
    return reduce(lambda a, b: a.unionByName(b.select(a.columns)), out)


def living_nodes(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """id of nodes with a row and no tombstone as late as or later than their highest updated_at (ms; without one, any tombstone holds)."""
    n = nodes.select(norm_id("id").alias("id"), "updated_at").filter("id is not null").groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    t = tombstones.select(norm_id("node_id").alias("id"), utc_micros(tombstones, "removed_at").alias("at"))
    t = t.filter("id is not null").groupBy("id").agg(F.max("at").alias("at"))
    gone = n.join(t, "id").filter(F.col("updated_at").isNull() | (F.col("at") >= F.col("updated_at") * 1000)).select("id")
    return n.select("id").join(gone, "id", "left_anti")


def text_id(c: Column) -> Column:
    """The id of a symbol from its unhashed text; a blank text has none."""
    return F.when(F.btrim(c, F.lit(" \t\r\n")) != "", F.substring(F.sha2(c, 256), 1, 32))


def orphan_edges(nodes: DataFrame, edges: DataFrame, tombstones: DataFrame, externals: DataFrame) -> DataFrame:
    """edge_id, month_seen, null_mask of edges that lead nowhere; an edge without target and target_text refers to nothing."""
    refs = edges.select(
        F.col("id").alias("edge_id"),
        norm_id("target").alias("by_id"),
        text_id(F.col("target_text")).alias("by_text"),
        F.coalesce(F.date_format("seen_at", "yyyy-MM"), F.lit("unknown")).alias("month_seen"),
    )
    both = lambda df: df.select(F.col("id").alias("by_id"), F.col("id").alias("by_text"))
    ext = externals.select(norm_id("id").alias("id"))
    found = find_orphans(refs, both(living_nodes(nodes, tombstones)), ["by_id", "by_text"], "first", both(ext))
    return found.select("edge_id", "month_seen", "null_mask").distinct()
