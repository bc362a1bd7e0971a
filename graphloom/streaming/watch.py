"""Changes of files: two listings compared, bursts of events collapsed, and both as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.increment import Published


def poll_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, kind: created, removed, or modified (the times differ) between two listings (path, modified_at), each path once in each; null paths are dropped."""
    before, now = before.filter("path is not null"), now.filter("path is not null")
    a = before.select("path", F.col("modified_at").alias("m1"), F.lit(True).alias("was"))
    b = now.select("path", F.col("modified_at").alias("m2"), F.lit(True).alias("is_"))
    kind = F.when(F.col("was").isNull(), "created").when(F.col("is_").isNull(), "removed").when(~F.col("m1").eqNullSafe(F.col("m2")), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).filter("kind is not null")


def debounce(events: DataFrame) -> DataFrame:
    """path, kind of the last event (path, kind, seq) of each path; of events at one time the largest kind."""
    return events.filter("path is not null").groupBy("path").agg(F.max_by("kind", F.struct("seq", "kind")).alias("kind"))


def debounced_stream(events: DataFrame, gap: str = "300 milliseconds", late: str = "2 seconds", time: str = "at") -> DataFrame:
    """path, first, last, kind, events of each burst in a stream of (path, kind, ``time``): a burst ends after ``gap`` without event; events later than ``late`` are dropped."""
    w = events.withWatermark(time, late).groupBy("path", F.session_window(time, gap).alias("burst"))
    return w.agg(F.max_by("kind", time).alias("kind"), F.count("*").alias("events")).select("path", F.col("burst.start").alias("first"), F.col("burst.end").alias("last"), "kind", "events")


def keep_newest(state: Published) -> Callable[[DataFrame, int], None]:
    """A merge for ``sync_stream``: of each key (key, value) the largest value it ever had is published. A batch that comes twice changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("key", "value").filter("key is not null")
        known = state.read("state")
        if known is not None:
            rows = rows.unionByName(known.select("key", "value"))
        state.run(rows.groupBy("key").agg(F.max("value").alias("value")), lambda changed: changed.select("key", "change"))

    return merge


def sync_stream(listing: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each batch of listing rows to ``merge(batch, batch id)``; the id tells a repeated batch, so a merge can be made idempotent."""
    writer = listing.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
