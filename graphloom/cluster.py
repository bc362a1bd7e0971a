"""What every operator needs from the cluster: shared folder, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast on request. Callers pass a lower one where rows are wide.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(sc, "_graphloom_dir", None)
    if made is None:
        made = sc._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return made


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; they need not have it installed, nor share the driver's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom.zip"  # on the driver, which serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._graphloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder, so that a lost executor costs no recomputation of the loop."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query run within are removed when it ends, not when the driver happens to collect its garbage. For results
    that are written or cut; a DataFrame that was itself run within is not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` over as many partitions as the session shuffles into, before work that is heavy for the rows' size; adaptive execution would put small rows together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows, else unchanged (Spark then shuffles)."""
    return F.broadcast(df) if at_most(df, rows) else df


def norm_id(c: Column | str) -> Column:
    """An id without surrounding white space, in lower case; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(s != "", s)


def norm_kind(c: Column | str) -> Column:
    return norm_id(c)


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without zone is read as UTC whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return F.unix_micros(c)
