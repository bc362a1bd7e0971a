"""Processing only new or changed records.

Method: a Merkle tree over ranges of the hashed key. A leaf digests its records in any order (two 64-bit XORs and a
count), a node digests the leaves under it. The tree of the current records is compared with the published one from the top;
only ranges whose digests differ are opened, and only records of differing leaves are read from the published state and compared.

Output, tree and state are published together: each run takes its records once, writes what it derives from that copy into a
new version folder, and one atomic rename of the pointer makes all of it current. A run that fails at any point leaves the last
version in force and is repeated as if it had never been; a source that moves while a run writes is picked up by the next one.
State is kept by top range: a version holds the ranges in which something changed, the pointer names the version of each range.

A record may come without a value but with a weaker sign of its content (``weak``, for files size and time): then the sign is
compared, and the value is taken over where it agrees. Leaves with such records are opened, as no digest can speak for them.

Defined results: repeated rows count once; a record with a null key is no record; an empty saved tree makes every record new.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cluster import cut, norm_kind, shared_dir

#: Records a leaf should hold.
LEAF_RECORDS = 16
STEP = 2  # hex digits a level adds


def depth_for(records: int, leaf_records: int = LEAF_RECORDS) -> int:
    """Hex digits of a leaf's range, a multiple of STEP, 2 to 8."""
    return min(8, max(STEP, STEP * math.ceil(math.log(max(records / leaf_records, 2), 16) / STEP)))


def range_digits(depth: int) -> int:
    """Hex digits of a top range, in which state is kept: 16 ranges for up to a million records, 256 beyond."""
    return 1 if depth <= 2 * STEP else STEP


def key_range(key: Column, digits: int) -> Column:
    return F.substring(F.lpad(F.hex(F.xxhash64(key)), 16, "0"), 1, digits)


def merkle_leaves(records: DataFrame, depth: int) -> DataFrame:
    """``records``: key, digest_of (any column). Out: leaf, a, b, n."""
    return records.groupBy(key_range(F.col("key"), depth).alias("leaf")).agg(
        F.bit_xor(F.xxhash64("key", "value")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "value", "key")).alias("b"), F.count("*").alias("n")
    )


def merkle_level(leaves: DataFrame, digits: int) -> DataFrame:
    return leaves.groupBy(F.substring("leaf", 1, digits).alias("leaf")).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"))


def changed_leaves(now: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """Leaves whose digests differ, found from the top down: a level is compared only under ranges that differ."""
    open_ = None
    for digits in range(STEP, depth + 1, STEP):
        a, b = (t if digits == depth else merkle_level(t, digits) for t in (now, saved))
        if open_ is not None:
            under = open_.withColumnRenamed("leaf", "range")
            a, b = (t.withColumn("range", F.substring("leaf", 1, digits - STEP)).join(under, "range", "left_semi").drop("range") for t in (a, b))
        b = b.select("leaf", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
        same = F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")) & F.col("n").eqNullSafe(F.col("n2"))
        open_ = a.join(b, "leaf", "full_outer").filter(~same).select("leaf")
    return open_


def _full(records: DataFrame) -> DataFrame:
    """key, value, weak of the records that have a key."""
    weak = F.col("weak") if "weak" in records.columns else F.lit(None).cast("string")
    return records.select("key", "value", weak.alias("weak")).filter("key is not null")


def compared(now: DataFrame, saved: DataFrame) -> DataFrame:
    """key, value, weak, change of ``now``: added, changed, or null where ``saved`` has the same."""
    b = saved.select("key", F.col("value").alias("value2"), F.col("weak").alias("weak2"), F.lit(True).alias("was"))
    bare = F.col("value").isNull() & F.col("weak").isNotNull()
    same = F.when(bare, F.col("weak").eqNullSafe(F.col("weak2"))).otherwise(F.col("value").eqNullSafe(F.col("value2")))
    change = F.when(F.col("was").isNull(), "added").when(~same, "changed")
    return now.join(b, "key", "left").select("key", F.when(bare & same, F.col("value2")).otherwise(F.col("value")).alias("value"), "weak", change.alias("change"))


def open_leaves(now: DataFrame, tree: DataFrame, saved_tree: DataFrame, depth: int) -> DataFrame:
    """Leaves to be opened: those whose digests differ, and those with records that bring no value of their own."""
    bare = now.filter("value is null and weak is not null").select(key_range(F.col("key"), depth).alias("leaf"))
    return changed_leaves(tree, saved_tree, depth).unionByName(bare).distinct()


def changed_records(now: DataFrame, saved: DataFrame, depth: int | None = None, saved_tree: DataFrame | None = None) -> DataFrame:
    """Records (key, value, perhaps weak; keys unique) of ``now`` that ``saved`` lacks or has with another value, with change: added or
    changed. ``saved_tree``: the leaves of ``saved``, made with the same depth."""
    now, saved = _full(now), _full(saved)
    depth = depth or depth_for(now.count())
    leaves = open_leaves(now, merkle_leaves(now, depth), merkle_leaves(saved, depth) if saved_tree is None else saved_tree, depth)
    inside = lambda df: df.withColumn("leaf", key_range(F.col("key"), depth)).join(leaves, "leaf", "left_semi").drop("leaf")
    return compared(inside(now), inside(saved)).filter("change is not null").select("key", "value", "change")


def norm_hash(c: str) -> Column:
    """A content hash without algorithm prefix, in lower case; blank is null."""
    h = F.regexp_replace(F.lower(F.btrim(F.col(c))), "^[a-z0-9-]+:", "")
    return F.when(h != "", h)


def norm_seconds(c: str) -> Column:
    """A file time in seconds; values beyond the year 5000 are milliseconds."""
    return F.when(F.col(c) > 100_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c))


def indexed_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """path, content_hash, size, modified_at of the latest row of each path that a successful run wrote.

    Runs join on the days they span, so the join is an equality whatever the number of runs."""
    day = 86_400_000
    ok = runs.filter(norm_kind("status").isin("success", "ok") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull())
    ok = ok.select("started_at", "finished_at", F.explode(F.sequence(F.floor(F.col("started_at") / day), F.floor(F.greatest("finished_at", "started_at") / day))).alias("day"))
    f = files.filter("path is not null").withColumn("day", F.floor(F.col("indexed_at") / day))
    f = f.join(ok, "day").filter("indexed_at between started_at and finished_at")
    row = F.struct("indexed_at", norm_hash("content_hash").alias("content_hash"), "size", norm_seconds("modified_at").alias("modified_at"))
    return f.groupBy("path").agg(F.max(row).alias("r")).select("path", "r.content_hash", "r.size", "r.modified_at")


def current_state(listing: DataFrame) -> DataFrame:
    """path, content_hash, size, modified_at of the row with the highest listed_at of each path."""
    row = F.struct("listed_at", norm_hash("content_hash").alias("content_hash"), "size", norm_seconds("modified_at").alias("modified_at"))
    return listing.filter("path is not null").groupBy("path").agg(F.max(row).alias("r")).select("path", "r.content_hash", "r.size", "r.modified_at")


def file_records(state: DataFrame) -> DataFrame:
    """key, value (16 bytes for the content hash), weak (size and time) of a state of files."""
    return state.select(F.col("path").alias("key"), F.unhex(F.md5("content_hash")).alias("value"), F.concat_ws("@", F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("modified_at").cast("string"), F.lit(""))).alias("weak"))


def paths_to_index(files: DataFrame, runs: DataFrame, listing: DataFrame, depth: int | None = None, folder: str | None = None) -> DataFrame:
    """path, change of what the next run has to index, as that run would publish it into ``folder``.

    Where nothing is published there yet, what successful runs wrote is published first. A listing without hash takes over the
    indexed hash where size and time agree."""
    spark = files.sparkSession
    at = Published(spark, folder or f"{shared_dir(spark)}/increment-{uuid.uuid4().hex}")
    if at.version() is None:
        at.start(file_records(indexed_state(files, runs)), depth)
    at.run(file_records(current_state(listing)), lambda changed: changed.select(F.col("key").alias("path"), "change"), depth)
    return at.read("output")


class Published:
    """Versions of an output, its tree and its state under one folder; ``CURRENT`` names the version in force, and that of each range of the state."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def version(self) -> int | None:
        return (self._current() or {}).get("version")

    def _current(self) -> dict | None:
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, part: str) -> DataFrame | None:
        """``output`` or ``tree`` of the version in force, or the whole ``state``."""
        now = self._current()
        if now is None:
            return None
        return self.state(now) if part == "state" else self.spark.read.parquet(f"{self.folder}/v={now['version']}/{part}")

    def state(self, now: dict, ranges: set[str] | None = None) -> DataFrame | None:
        """key, value, weak of the state, of some of its ranges only; at most 256 folders are named."""
        paths = [f"{self.folder}/v={v}/state/range={r}" for r, v in sorted(now["ranges"].items()) if ranges is None or r in ranges]
        kind = self.spark.createDataFrame([], f"key string, value {now['value']}, weak string")
        return self.spark.read.schema(kind.schema).parquet(*paths) if paths else kind

    def _write(self, version: int, part: str, df: DataFrame) -> None:
        """Whatever an earlier failed run left there is replaced."""
        (df.write.partitionBy("range") if part == "state" else df.write).mode("overwrite").parquet(f"{self.folder}/v={version}/{part}")

    def _switch(self, current: dict) -> None:
        new = self._path(f"{self.folder}/CURRENT.new")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(current).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, self._path(f"{self.folder}/CURRENT"), options)

    def _ranges(self, version: int) -> list[str]:
        """Ranges of the state a version has written."""
        at = self._path(f"{self.folder}/v={version}/state")
        return [x.getPath().getName().removeprefix("range=") for x in self._fs.listStatus(at) if x.getPath().getName().startswith("range=")]

    @staticmethod
    def _placed(records: DataFrame, digits: int) -> DataFrame:
        """Records with their top range; ranges are even whatever the keys are."""
        return records.withColumn("range", key_range(F.col("key"), digits)).repartition("range")

    def start(self, records: DataFrame, depth: int | None = None) -> int:
        """Publish a first state with its tree and no output."""
        records = cut(_full(records))
        depth = depth or depth_for(records.count())
        self._write(1, "tree", merkle_leaves(records, depth))
        digits = range_digits(depth)
        self._write(1, "state", self._placed(records, digits))
        self._switch({"version": 1, "depth": depth, "digits": digits, "value": dict(records.dtypes)["value"], "ranges": {r: 1 for r in self._ranges(1)}, "output": False})
        return 1

    def run(self, records: DataFrame, process: Callable[[DataFrame], DataFrame], depth: int | None = None) -> int:
        """One incremental run over ``records`` (key, value, perhaps weak): ``process`` gets the changed ones (key, value, change), its result is the output."""
        records = cut(_full(records))  # the source is read once, all that is written follows from this copy
        depth = depth or depth_for(records.count())
        digits = range_digits(depth)
        was = self._current() or {"version": 0, "ranges": {}, "depth": None, "digits": digits, "value": dict(records.dtypes)["value"]}
        v = was["version"] + 1
        place = lambda n: key_range(F.col("key"), n)
        saved_tree = self.spark.read.parquet(f"{self.folder}/v={was['version']}/tree") if was["depth"] == depth else merkle_leaves(self.state(was), depth)
        leaves = cut(open_leaves(records, cut(merkle_leaves(records, depth)), saved_tree, depth))
        touched = sorted(r[0] for r in leaves.select(F.substring("leaf", 1, digits)).distinct().collect())  # 256 at most
        # another number of ranges than before: all are written anew
        old = [r for r in was["ranges"] if was["digits"] != digits or r in touched]
        within = place(digits).isin(touched) if was["digits"] == digits else F.lit(True)
        opened = lambda df: df.withColumn("leaf", place(depth)).join(leaves.withColumn("open", F.lit(True)), "leaf", "left")
        saved = opened(self.state(was, set(old))).filter("open").drop("leaf", "open")
        near = opened(records.filter(within))
        seen = compared(near.filter("open").drop("leaf", "open"), saved)
        rest = near.filter("open is null").select("key", "value", "weak", F.lit(None).cast("string").alias("change"))
        # ranges that were opened are written anew: what was compared, and the rest of their records as they are
        seen = cut(seen.unionByName(rest))
        self._write(v, "output", process(seen.filter("change is not null").select("key", "value", "change")))
        self._write(v, "state", self._placed(seen.drop("change"), digits))
        # digests are those of the state: values that were taken over count
        known = seen.drop("change").unionByName(records.filter(~within))
        self._write(v, "tree", merkle_leaves(known, depth))
        ranges = {r: k for r, k in was["ranges"].items() if r not in old} | {r: v for r in self._ranges(v)}
        self._switch({"version": v, "depth": depth, "digits": digits, "value": was["value"], "ranges": ranges})
        return v
