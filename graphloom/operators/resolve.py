"""Imports resolved to the files and symbols they name, by the module rules of each language.

Each file is known by keys: its path without extension, and every suffix of it (source roots are not declared); a package by its
folder. An import asks for one or more keys in turn: a dotted name for the module, then for the module before its last part and the
symbol behind it; a relative one for the place it leads to from the importing file. Both meet in one equality join on the key;
the first key asked for wins, then a file of the same repository, then the longest key, then the smallest path.

Defined results: imports that ask for nothing (no path, no language with rules) and those no file answers are external if no part of
the corpus begins like them, else unresolved; a symbol that its file does not define leaves the import unresolved; null texts are dropped.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages that name modules alike.
GROUPS = {"python": "python", "java": "java", "javascript": "js", "typescript": "js", "go": "go"}


def wanted(language: str | None, importer: str, text: str) -> list[tuple[str, str | None]]:
    """(key, symbol or None) an import asks for, the best first; keys begin with ``=`` for a whole path, with ``~`` for its end."""
    group, folder = GROUPS.get(language or ""), posixpath.dirname(importer)
    if group == "python":
        dots = len(text) - len(text.lstrip("."))
        parts = [p for p in text[dots:].split(".") if p]
        if dots:
            for _ in range(dots - 1):
                folder = posixpath.dirname(folder)
            at = lambda ps: "=" + posixpath.join(folder, *ps)
        else:
            at = lambda ps: "~" + "/".join(ps)
        if not parts:
            return [("=" + folder, None)]
        return [(at(parts), None)] + ([(at(parts[:-1]), parts[-1])] if len(parts) > 1 or dots else [])
    if group == "java":
        parts = text.split(".")
        out = [("~" + "/".join(parts), None)]
        return out + ([("~" + "/".join(parts[:-1]), parts[-1])] if len(parts) > 1 and parts[-1] != "*" else [])
    if group == "js":
        if not text.startswith("."):
            return []
        path = posixpath.normpath(posixpath.join(folder, text))
        stem, dot, end = path.rpartition(".")
        return [("=" + path, None)] + ([("=" + stem, None)] if dot and end in ("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx") else [])
    if group == "go":
        parts = text.split("/")
        return [("~" + "/".join(parts[k:]), None) for k in range(len(parts)) if len(parts) - k > 1 or len(parts) == 1]
    return []


def _group(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.lower(language)]


def file_keys(files: DataFrame) -> DataFrame:
    """group, key, length, path, id of files (id, file_path, language)."""
    rows = files.filter("file_path is not null").select("id", F.col("file_path").alias("path"), _group(F.col("language")).alias("group")).filter("group is not null")
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    place = F.when(F.col("group") == "go", F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.regexp_replace(stem, "/(?:__init__|index)$", ""))
    parts = F.split(place, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.concat(F.lit("~"), F.array_join(F.slice(parts, -k, k), "/")).alias("key"), k.alias("length")))
    whole = F.array(F.struct(F.concat(F.lit("="), place).alias("key"), F.size(parts).alias("length")))
    keys = rows.select("group", "path", "id", F.explode(F.concat(ends, whole)).alias("k")).select("group", "k.key", "k.length", "path", "id")
    # of a package's files one stands for it
    return keys.groupBy("group", "key", "length", F.split("path", "/")[0].alias("repo")).agg(F.min(F.struct("path", "id")).alias("f")).select("group", "key", "length", "repo", "f.path", "f.id")


def resolve_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target_text, target, provenance (resolved, external, unresolved) of each different import among ``edges``."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(s, x, g, p, n, k, y) for s, x, g, lang, p in zip(f["source"], f["target_text"], f["group"], f["language"], f["path"]) for n, (k, y) in enumerate(wanted(lang, p, x.partition(":")[2]) or [("", None)])]
            yield pd.DataFrame(out, columns=["source", "target_text", "group", "path", "turn", "key", "symbol"])

    from_ = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path"), F.lower("language").alias("language"))
    imports = edges.filter("kind = 'imports' and source is not null and target_text is not null").select("source", "target_text").distinct().join(from_, "source").filter("path is not null")
    asked = imports.withColumn("group", _group(F.col("language"))).mapInPandas(ask, "source string, target_text string, group string, path string, turn int, key string, symbol string")
    keys = file_keys(nodes.filter("kind = 'file'"))
    here = asked.withColumn("own", F.split("path", "/")[0]).drop("path")
    met = here.join(keys.withColumnRenamed("path", "found"), ["group", "key"], "left")
    order = F.struct(F.col("id").isNull().alias("none"), "turn", (F.col("repo") != F.col("own")).alias("other"), (-F.col("length")).alias("length"), F.col("found").alias("path"), "id", "symbol")
    best = met.groupBy("source", "target_text", "group").agg(F.min(order).alias("r"))
    best = best.select("source", "target_text", "group", "r.path", "r.id", "r.symbol")
    symbols = nodes.filter("name is not null and kind <> 'file'").groupBy(F.col("file_path").alias("path"), F.col("name").alias("symbol")).agg(F.min("id").alias("symbol_id"))
    best = best.join(symbols, ["path", "symbol"], "left")
    # does anything in the corpus begin like it?
    first = F.regexp_extract("target_text", r"^[^:]*:([A-Za-z0-9_@-]+)", 1)
    heads = keys.filter("key like '~%'").select("group", F.regexp_extract("key", "^~([^/]+)", 1).alias("head")).distinct().withColumn("inside", F.lit(True))
    best = best.withColumn("head", first).join(heads, ["group", "head"], "left")
    relative = F.regexp_extract("target_text", "^[^:]*:(.*)$", 1).startswith(".")
    target = F.when(F.col("symbol").isNull(), F.col("id")).otherwise(F.col("symbol_id"))
    state = F.when(target.isNotNull(), "resolved").when(relative | F.coalesce("inside", F.lit(False)), "unresolved").otherwise("external")
    return best.select("source", "target_text", target.alias("target"), state.alias("provenance"))
