"""File scans and incremental maintenance of stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a scan leaves out.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".next", ".cache", "vendor", ".mypy_cache", ".pytest_cache", ".tox", "coverage", ".idea", ".vscode",
)
IGNORED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock")
LARGEST = 2 * 1024 * 1024


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path, length, modified, content of the source files below root: no hidden or ignored folders, no lock files, none beyond LARGEST."""
    return _sources(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, extensions)


def _sources(files: DataFrame, root: str, extensions: tuple[str, ...]) -> DataFrame:
    relative = F.expr("substring(path, instr(path, '{0}') + {1})".format(root.rstrip("/").replace("'", "''"), len(root.rstrip("/")) + 1))
    rows = files.where(F.col("length") <= LARGEST).withColumn("path", relative)
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    ok = ~F.exists(folders, lambda x: x.isin(*IGNORED_DIRS) | x.startswith(".")) & ~F.element_at(parts, -1).isin(*IGNORED_FILES) & ~F.element_at(parts, -1).startswith(".")
    if extensions:
        ok = ok & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[x.lstrip(".") for x in extensions])
    return rows.where(ok).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def watch(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """A stream of the source files below root as they are written: path, hash, version (time of change), deleted, content; for ingest.apply_changes.

    A file that is written again comes again.  Removed files don't come; they
    are found by comparing a scan with what is stored (`changes`).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    rows = _sources(files, root, extensions)
    return rows.select("path", F.md5("content").alias("hash"), F.unix_micros("modified").alias("version"), F.lit(False).alias("deleted"), "content")


def changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path and status of each file that is stored (path, hash, mtime) or found: new, gone, same, touched or changed."""
    s, f = stored.alias("s"), found.alias("f")
    status = (
        F.when(F.col("s.path").isNull(), "new").when(F.col("f.path").isNull(), "gone")
        .when(F.col("s.mtime") == F.col("f.mtime"), "same").when(F.col("s.hash") == F.col("f.hash"), "touched").otherwise("changed")
    )
    return s.join(f, F.col("s.path") == F.col("f.path"), "full").select(F.coalesce("s.path", "f.path").alias("path"), status.alias("status"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the rows of new in place of those with the same key."""
    return new.unionByName(stored.join(new.select(key).distinct(), key, "left_anti"))
