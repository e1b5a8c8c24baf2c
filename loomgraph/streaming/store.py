"""Relations of files that last: a log of deltas below a shared folder, and a manifest that says which of them count.

A batch writes what its files now hold and, for each of its files, a mark that
ends what was stored for it before; nothing older is rewritten.  The manifest is a
small file that names the base and the deltas with their batches; a new version
is written beside it and renamed, so a batch counts as a whole or not at all, a
batch that comes again changes nothing, and whoever opens the folder goes on from
the last version.  Rows lie in buckets by the hash of their first file, or of another
column, so the rows of some files are read from their buckets alone.  Compaction writes a new base of
the rows that count.

A row belongs to the files that its owner columns name (null for none): it ends
with a later mark of any of them.  An edge belongs to the file of its source,
whether the source is the file or lies below it, and to the file that its target
lies below; an edge that points at a file itself stays when that file changes.
Files are compared as a whole, never by prefix.  One writer at a time: a version
that exists already is an error, not overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import file_of

BUCKETS = 32
#: Deltas that a read merges at most before they are compacted.
DELTAS = 16

# Fixed value: the files that a row of each relation belongs to.
OWNERS = {"files": ("path",), "symbols": ("file_path",), "edges": ("source_file", "target_file")}


def with_files(edges: DataFrame) -> DataFrame:
    """edges with source_file, the source or what it lies below, and target_file, what the target lies below."""
    return edges.withColumn("source_file", F.coalesce(file_of(F.col("source_id")), F.col("source_id"))).withColumn("target_file", file_of(F.col("target_id")))


class Store:
    """Relations by name, each with a schema (DDL) and owner columns, kept below folder."""

    def __init__(
        self, spark: SparkSession, folder: str, relations: dict[str, str], owners: dict[str, tuple[str, ...]] | None = None, by: dict[str, str] | None = None,
        buckets: int = BUCKETS, deltas: int = DELTAS,
    ):
        self.spark, self.folder, self.relations, self.buckets, self.deltas = spark, folder.rstrip("/"), relations, buckets, deltas
        self.owners = {name: (owners or OWNERS)[name] for name in relations}
        self.by = {name: (by or {}).get(name, self.owners[name][0]) for name in relations}

    # --- the manifest

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        at = path(f"{self.folder}/manifest")
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v")) if fs.exists(at) else []

    def manifest(self) -> dict:
        """version, last (the last batch), base (a folder or null), deltas (folders and their batches) of the last version."""
        known = self.versions()
        if not known:
            return {"version": 0, "last": -1, "base": None, "deltas": []}
        path, fs = self._fs()
        stream = fs.open(path(f"{self.folder}/manifest/v{known[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        path, fs = self._fs()
        draft, whole = path(f"{self.folder}/manifest/.{uuid.uuid4().hex}"), path(f"{self.folder}/manifest/v{manifest['version']}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(whole) or not fs.rename(draft, whole):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.folder} was written by another writer")

    # --- reading

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _stored(self, name: str, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        schema = f"{self.relations[name]}, _batch long, _bucket int"
        out = self.spark.createDataFrame([], schema)
        for folder in folders:
            rows = self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
            out = out.unionByName(rows if buckets is None else rows.where(F.col("_bucket").isin(buckets)))
        return out

    def _marks(self, manifest: dict) -> DataFrame:
        """path, ended: the last batch that ended what was stored for a file."""
        out = self.spark.createDataFrame([], "path string, _batch long")
        for d in manifest["deltas"]:
            out = out.unionByName(self.spark.read.schema("path string, _batch long").parquet(f"{d['folder']}/marks"))
        return out.groupBy("path").agg(F.max("_batch").alias("_ended"))

    def _live(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{x}/{name}" for x in ([manifest["base"]] if manifest["base"] else []) + [d["folder"] for d in manifest["deltas"]]]
        rows = self._stored(name, folders, buckets)
        if manifest["deltas"]:
            marks = self._marks(manifest)
            for owner in self.owners[name]:
                ended = marks.select(F.col("path").alias(owner), "_ended")
                rows = rows.join(ended, owner, "left").where(F.col("_ended").isNull() | (F.col("_ended") <= F.col("_batch"))).drop("_ended")
        return rows

    def read(self, name: str | None = None, paths: Iterable[str] | None = None) -> DataFrame:
        """The rows of a relation that count; with paths, those with these values of the column that its buckets go by, from their buckets."""
        name = name or next(iter(self.relations))
        buckets = None
        if paths is not None:
            paths = list(paths)
            made = self.spark.createDataFrame([(p,) for p in paths], "p string").select(self._bucket(F.col("p"))).distinct().collect()
            buckets = [r[0] for r in made]
        rows = self._live(name, self.manifest(), buckets)
        rows = rows if paths is None else rows.where(F.col(self.by[name]).isin(paths))
        return rows.drop("_batch", "_bucket").select(*[f"`{c}`" for c in self._columns(name)])

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.relations[name]).columns

    # --- writing

    def _write(self, name: str, rows: DataFrame, folder: str, dealt: bool = True) -> None:
        # sorted, so that the footers of files tell which values lie in them
        rows = rows.withColumn("_bucket", self._bucket(F.col(self.by[name])))
        rows = rows.repartition("_bucket") if dealt else rows
        rows.sortWithinPartitions("_bucket", self.by[name]).write.partitionBy("_bucket").parquet(f"{folder}/{name}")

    def apply(self, number: int, changed: DataFrame, own_files: Iterable[str] = (), **rows: DataFrame) -> bool:
        """Take batch number: what was stored for the files of changed (path) ends, and rows, by relation, come in.  False, and nothing happens, for a batch that is in already.

        Of the relations named in own_files each task writes files of its own to the buckets, so that their rows aren't shuffled.
        """
        manifest = self.manifest()
        if number <= manifest["last"]:
            return False
        folder = f"{self.folder}/delta-{number}-{uuid.uuid4().hex}"
        changed.select("path").distinct().withColumn("_batch", F.lit(number).cast("long")).write.parquet(f"{folder}/marks")
        for name in self.relations:
            made = rows[name] if name in rows else self.spark.createDataFrame([], self.relations[name])
            self._write(name, made.select(*[f"`{c}`" for c in self._columns(name)]).withColumn("_batch", F.lit(number).cast("long")), folder, name not in own_files)
        self._publish(manifest | {"version": manifest["version"] + 1, "last": number, "deltas": [*manifest["deltas"], {"folder": folder, "batch": number}]})
        if len(manifest["deltas"]) + 1 > self.deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the rows that count as a new base; what only older versions name is deleted, but for the version before, which readers may still use."""
        manifest = self.manifest()
        folder = f"{self.folder}/base-{manifest['version'] + 1}-{uuid.uuid4().hex}"
        for name in self.relations:
            self._write(name, self._live(name, manifest).drop("_bucket"), folder)
        self._publish({"version": manifest["version"] + 1, "last": manifest["last"], "base": folder, "deltas": []})
        path, fs = self._fs()
        used = {folder, manifest["base"], *(d["folder"] for d in manifest["deltas"])}
        used = {x.rsplit("/", 1)[-1] for x in used if x}
        for x in fs.listStatus(path(self.folder)):
            if (name := x.getPath().getName()).startswith(("base-", "delta-")) and name not in used:
                fs.delete(x.getPath(), True)
