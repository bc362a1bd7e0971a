"""Source files that do not parse, with rates per repository and language.

Method: error-correcting chart parsing (:mod:`graphloom.llm.syntax`): tokens are nested by brackets, each constituent is
parsed against the language's grammar, and where it does not derive the cheapest insertions, deletions and replacements are
sought, without a bound; who asks for flags alone seeks no repair. A cost above nothing flags the file; where the first edit
lies and what the edits are tells truncation (all at the end), conflict (merge markers), mismatch (the text belongs to another
language) and others apart.

Each text is parsed once, where it is read: the few paths declared in another language than their extension's are looked up
beforehand, in a table that is broadcast if it is small. Only results travel.

Defined results: the language is that of the files row with the highest indexed_at, in any spelling; by extension where the
path has none or it is unknown; a path of no known language is never flagged; a null content is an empty file, which is
valid but in JSON and Go; of several contents of a path one faulty suffices; null paths are dropped.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import small
from graphloom.llm.syntax import check

_OUT = "path string, language string, cost int, exact boolean, cut long, cause string"
_FLAGS = "path string, language string, bad boolean"


def _prepare() -> None:
    sys.setrecursionlimit(1_000_000)  # frames of nested parts live on the heap
    gc.disable()  # charts hold no cycles


def _flag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _prepare()
    for f in frames:
        bad = [check.faulty(t, lang) if lang else False for t, lang in zip(f["content"], f["language"])]
        yield pd.DataFrame({"path": f["path"], "language": f["language"], "bad": bad}).astype({"bad": bool})


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _prepare()
    for f in frames:
        found = [check.check(t, lang) if lang else None for t, lang in zip(f["content"], f["language"])]
        yield pd.DataFrame({
            "path": f["path"],
            "language": f["language"],
            "cost": [r.cost if r else 0 for r in found],
            "exact": [r.exact if r else True for r in found],
            "cut": [float("nan") if r is None or r.offset is None else r.offset for r in found],
            "cause": [r.cause if r else "" for r in found],
        }).astype({"cut": "Int64"})


def _named(names: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.lower(F.btrim(c, F.lit(" \t\r\n")))]


def _by_extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), _named(check.EXTENSIONS, F.substring_index(name, ".", -1)))


def declared(files: DataFrame) -> DataFrame:
    """path, said (language, null if unknown), repo by the newest row of each path."""
    said = files.filter("path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "language", "repo")).alias("r"))
    return said.select("path", _named(check.LANGUAGES, F.col("r.language")).alias("said"), F.col("r.repo").alias("repo"))


def _texts(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, content, language of each row of ``sources``."""
    by_name = _by_extension(F.col("path"))
    other = declared(files).filter(F.col("said").isNotNull() & ~F.col("said").eqNullSafe(by_name)).select("path", "said")
    texts = sources.filter("path is not null").select("path", "content").join(small(other), "path", "left")
    return texts.select("path", "content", F.coalesce("said", by_name).alias("language"))


def checked(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, language, cost, exact, cut (offset of the first edit), cause of each row of ``sources``."""
    return _texts(sources, files).mapInPandas(_run, _OUT)


def flagged(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, language, bad (whether it does not parse) of each row of ``sources``: no repair is sought."""
    return _texts(sources, files).mapInPandas(_flag, _FLAGS)


def unparsable(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, cost, exact, cut, cause, language of files that do not parse, the dearest repair of each path."""
    rows = checked(sources, files).filter("cost > 0")
    return rows.groupBy("path").agg(F.max(F.struct("cost", "exact", "cut", "cause", "language")).alias("r")).select("path", "r.*")


def rates(sources: DataFrame, files: DataFrame) -> DataFrame:
    """repo, language, files, faulty, rate."""
    one = flagged(sources, files).groupBy("path", "language").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    one = one.join(declared(files).select("path", "repo"), "path", "left").withColumn("repo", F.coalesce("repo", F.split("path", "/")[0]))
    return one.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("faulty"), F.round(F.avg("bad"), 6).alias("rate"))
