"""Text logs and exchange formats: commit logs, JSON lines, parse caches, graph exports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, SYMBOL_SCHEMA, CodeGraph

USAGE_SCHEMA = "ts string, repo string, source string, mode string, tool string, query string, file string, symbols int, tokens int, duration_ms int, empty boolean, task_type string"
TASK_SCHEMA = "ts string, task_type string, context_modes array<string>, tokens_used int, success boolean, notes string, session_hash string"


def commits(spark: SparkSession, path: str, separator: str = "COMMIT_SEP") -> DataFrame:
    """commit_id, day, path from the text of `git log --name-only --pretty='COMMIT_SEP %H %ct'`.

    Each block between separators is one row of the scan, so a log of any size is read in splits.
    """
    blocks = spark.read.option("lineSep", separator).text(path).select(F.trim("value").alias("block")).where("block <> ''")
    lines = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    head = F.split(F.get(lines, F.lit(0)), r"\s+")
    files = F.array_distinct(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != ""))
    rows = blocks.select(F.get(head, F.lit(0)).alias("commit_id"), F.to_date(F.timestamp_seconds(F.get(head, F.lit(1)).try_cast("long"))).alias("day"), files.alias("files"))
    return rows.where("day is not null").select("commit_id", "day", F.explode("files").alias("path"))


def json_lines(spark: SparkSession, path: str, schema: str = USAGE_SCHEMA) -> DataFrame:
    """The rows of a JSON-lines log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows to a log as files of JSON lines."""
    rows.write.mode("append").json(path)


def parse_cache(spark: SparkSession, path: str) -> DataFrame:
    """path and hash of a version 2 parse cache, with its symbols, edges and imports; other versions are empty."""
    of_file = f"struct<hash: string, symbols: array<struct<{_struct(SYMBOL_SCHEMA)}>>, edges: array<struct<{_struct(EDGE_SCHEMA)}>>, imports: array<string>>"
    raw = spark.read.schema(f"version int, files map<string, {of_file}>").option("multiLine", "true").json(path)
    return raw.where("version = 2").select(F.explode("files").alias("path", "f")).select("path", "f.*")


def _struct(schema: str) -> str:
    return ", ".join(": ".join(f.split(" ")) for f in schema.split(", "))


def export(g: CodeGraph) -> DataFrame:
    """The graph as JSON lines: what ('file', 'symbol' or 'edge') and json, for text().  One line per row, so no task gathers the graph."""
    def rows(what: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(what).alias("what"), F.to_json(F.struct("*")).alias("json"))

    return rows("file", g.files).unionByName(rows("symbol", g.symbols)).unionByName(rows("edge", g.edges))


def save(g: CodeGraph, path: str) -> None:
    """Write the graph's relations; edges are partitioned by kind, so readers of one kind read it alone."""
    g.symbols.write.mode("overwrite").parquet(f"{path}/symbols")
    g.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    if g.commit_files is not None:
        g.commit_files.write.mode("overwrite").parquet(f"{path}/commit_files")


def load(spark: SparkSession, path: str, history: bool = True) -> CodeGraph:
    """A saved graph; relations that a query doesn't use are never read."""
    read = spark.read.parquet
    return CodeGraph(read(f"{path}/symbols"), read(f"{path}/edges").select("kind", "source_id", "target_id", "line"), read(f"{path}/commit_files") if history else None)


def folder_notes(g: CodeGraph) -> DataFrame:
    """folder and note: a short description of each folder, for one text file each."""
    rows = g.symbols.groupBy(F.regexp_replace("file_path", "/?[^/]*$", "").alias("folder"), "file_path").agg(F.count("*").alias("n"), F.count_if("exported").alias("e"))
    line = F.concat(F.lit("- "), F.col("file_path"), F.lit(": "), F.col("n").cast("string"), F.lit(" symbols, "), F.col("e").cast("string"), F.lit(" exported"))
    return rows.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("note"))


def snapshot_folder(base: str, repo: str) -> str:
    """Where a repository's snapshot lies below a base folder; the name has the form owner/name."""
    parts = repo.strip("/").split("/")
    if len(parts) != 2 or not all(parts) or ".." in parts:
        raise ValueError(f"a repository is named owner/name, not {repo!r}")
    return f"{base.rstrip('/')}/{parts[0]}/{parts[1]}"


def publish(g: CodeGraph, base: str, repo: str) -> None:
    """Save a graph as a repository's snapshot and list it in the registry below the base folder."""
    at = snapshot_folder(base, repo)
    save(g, at)
    row = g.symbols.sparkSession.createDataFrame([(repo.strip("/"), at, g.commit_files is not None)], "repo string, path string, history boolean")
    row.write.mode("append").parquet(f"{base.rstrip('/')}/registry")


def snapshots(spark: SparkSession, base: str) -> DataFrame:
    """repo, path, history of the snapshots that a registry lists."""
    return spark.read.parquet(f"{base.rstrip('/')}/registry").distinct().orderBy("repo")


def snapshot(spark: SparkSession, base: str, repo: str) -> CodeGraph:
    """The graph of a listed repository; a name that isn't listed is an error that tells those that are."""
    known = {r["repo"]: r for r in snapshots(spark, base).collect()}  # a registry has a row for each repository
    if repo.strip("/") not in known:
        raise KeyError(f"no snapshot of {repo!r}; there are {', '.join(sorted(known))}")
    row = known[repo.strip("/")]
    return load(spark, row["path"], row["history"])
