"""Shared helpers: shared storage, hot-key joins, Arrow row operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base

#: A group is hot when it holds at least this share of all rows, so there are at most 1 / HOT_SHARE hot groups.
HOT_SHARE = 1 / 1000

#: Bytes of a batch that become Python values at once, about, and result rows that are gathered.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 4096

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ensure_importable(spark: SparkSession) -> None:
    """Put this package on the Python path of workers that the session starts."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; all of an application lie side by side."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what operators of this application have written to the shared folder; frames that aren't written yet can't be read after."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has it."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write df below the shared folder and read it back, so that later jobs neither recompute it nor depend on one executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Successive rows of a batch, of about PIECE_BYTES together."""
    step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows_operator(
    df: DataFrame, columns: Iterable[str | Column], function: Callable[..., Iterator[tuple]], schema: str
) -> DataFrame:
    """Run function(lists of the columns' values) -> tuples on pieces of the Arrow batches.

    function is called with one Python list per column and yields one tuple
    per output row in the order of schema.  A piece has about PIECE_BYTES, or is
    one row; of what function yields, PIECE_ROWS rows are held at most.
    """
    ensure_importable(df.sparkSession)
    out = _arrow_schema(schema)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = iter(function(*(c.to_pylist() for c in piece.columns)))
                while some := list(islice(made, PIECE_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), out.types)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def partition_operator(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run function(iterator of the rows of a partition, in their order) -> tuples in the order of schema; nothing but what function keeps is held."""
    ensure_importable(df.sparkSession)
    out = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = iter(function(row for batch in batches for piece in pieces(batch) for row in zip(*(c.to_pylist() for c in piece.columns))))
        while some := list(islice(made, PIECE_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), out.types)], names=out.names)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to groups (one row per key, holding the number of its rows in column size), safe for hot keys.

    Groups with at least HOT_SHARE of total rows are broadcast: there are at
    most 1 / HOT_SHARE of them whatever the input.  The other groups are each
    smaller than HOT_SHARE of the rows, and meet their rows in a shuffled join.
    A null key matches nothing.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least)
    cold = groups.where(F.col(size) < least)
    extra = [c for c in groups.columns if c != key]
    own, name = [F.col(f"`{c}`") for c in rows.columns], fresh(rows, "_hot")
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*extra).alias(name))), key, "left")
    done = marked.where(F.col(name).isNotNull()).select(*own, f"{name}.*")
    rest = marked.where(F.col(name).isNull()).drop(name).join(cold, key, "left").select(*own, *extra)
    return done.unionByName(rest)


def held_out(column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Memo(dict):
    """A cache of computed flat values in two generations, of about most bytes together: when one is full, values unused since the last was are forgotten.

    Keys longer than LONG are rarely seen again and are computed each time.
    """

    LONG = 64

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most, self.held, self.older = compute, most // 2, 0, {}

    def __missing__(self, key):
        if len(key) > self.LONG:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.held += getsizeof(key) + getsizeof(value) + 100
        if self.held >= self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value
