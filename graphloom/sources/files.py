"""Source files as a table: a folder tree read in parallel, under ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "json": "json",
    "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "lua": "lua", "sh": "bash", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css",
}
# Folders no index wants.
IGNORED = (".git/", "node_modules/", "__pycache__/", ".venv/", "target/")


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def ignore_regex(pattern: str) -> str:
    """A line of an ignore file: a trailing slash names folders, a leading one the root, ``**`` crosses folders."""
    folder, rooted = pattern.endswith("/"), pattern.startswith("/") or "/" in pattern.strip("/")
    body = re.escape(pattern.strip("/"))
    for a, b in ((r"\*\*/", "(?:.*/)?"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]")):
        body = body.replace(a, b)
    return ("^" if rooted else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last line that fits a path ignores it; a line that begins with ``!`` takes it back."""
    out = F.lit(False)
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        out = F.when(path.rlike(ignore_regex(line.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, lines: list[str] | None = None, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """path (below ``root``), content, size, modified_at (s), content_hash of text files; with ``max_bytes`` a larger file keeps its row, without content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    base = "^(?:[a-z]+:)?/*" + re.escape(re.sub(r"^[a-z]+:/*", "", root).strip("/")) + "/?"
    path = F.regexp_replace(F.col("path"), base, "")
    kept = files.select(path.alias("path"), (F.col("content") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.col("content"))).alias("raw"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_at"))
    kept = kept.filter(~ignored(F.col("path"), [*IGNORED, *(lines or [])]))
    return kept.select("path", F.decode("raw", "UTF-8").alias("content"), "size", "modified_at", F.sha2("raw", 256).alias("content_hash"))
