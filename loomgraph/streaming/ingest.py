"""Incremental ingestion: micro-batches of changed files keep stored relations up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store as lasting


class Store(lasting.Store):
    """A relation of one row a file (path, hash and what else schema has) that lasts below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        super().__init__(spark, folder, {"files": schema})


def newest(batch: DataFrame, key: str = "path") -> DataFrame:
    """The row of each key with the greatest version."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "version").alias("v")).select(key, "v.*")


def apply_changes(store: lasting.Store, on_change: Callable[[DataFrame], None] | None = None, derive: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows (path, hash, deleted, version, ...) replace what is stored for their files, those marked deleted take theirs away.

    Within a batch the last version of a file wins.  A file whose hash is the
    stored one changes nothing.  derive makes the rows of further relations from
    the changed files, such as symbols and edges.  A batch that comes again, after
    a restart too, changes nothing and calls nothing back.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number <= store.manifest()["last"]:
            return
        last = newest(batch)
        stored = store.read("files").select("path", F.col("hash").alias("_h"))
        new = last.join(stored, "path", "left").where("(deleted and _h is not null) or (not deleted and (_h is null or _h <> hash))").drop("_h").persist()
        try:
            if new.isEmpty():
                return
            present = new.where("not deleted")
            store.apply(number, new, files=present, **(derive(present) if derive else {}))
            if on_change:
                on_change(new.select("path", "deleted"))
        finally:
            new.unpersist()

    return run


def follow(changed: DataFrame, store: lasting.Store, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, every: str | None = "2 seconds"):
    """Keep a store up to date with a stream of changed files; changes within every are one batch, so a file saved twice is taken once.  None takes what is there and ends."""
    writer = changed.writeStream.foreachBatch(apply_changes(store, on_change=on_change)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
