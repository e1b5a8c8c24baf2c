"""Embedding whitening: distributed centred scatter, cyclic Jacobi on the driver, broadcast projection.

Entries c become whole numbers x = floor(SCALE * c) + SHIFT.  Each task sums its
own rows' x by dimension, then, with the means known, the products of its centred
rows; one row of sums per task and dimension is shuffled.  The covariance, of
which there are as many entries as the square of the dimension whatever the
number of rows, comes to the driver.  Symmetric rotations, in cyclic order, make
its off-diagonal entries vanish against their diagonal entries, which keeps small
eigenvalues accurate.  The scaled eigenvectors are broadcast.

Defined results: rows with a null vector, an empty one or one with a null or
non-finite entry are dropped.  If vectors differ in length, those of the most
common length (of equally common ones the longest) are the table, and the others
are dropped too.  x of entries from 2^43 on stops at SCALE * 2^43, where doubles
no longer hold single units.  Repeated rows count as often as they come, null ids
included.  A component without variance, to double precision, has a null whitened
value and no part in identity_error; explained is 0 where there is no variance at
all.  deviation is null past 38 digits.  Eigenvectors have their largest entry
(the first of equals) positive.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cut, ensure_importable, pieces, shared_dir

# Fixed values of the grid.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_MOST = float(1 << 53)
_EPS = float(np.finfo(float).eps)


def usable(vector: Column) -> Column:
    """True for vectors of at least one entry, all of them finite numbers."""
    odd = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def grid(column: pa.Array) -> np.ndarray:
    """The whole numbers x of a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.clip(np.floor(SCALE * flat), -_MOST, _MOST).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """dims, pos, n, total, low, high of a task's vectors, by their length."""
    seen: dict[int, list] = {}
    for batch in batches:
        for piece in pieces(batch):
            column = piece.column(0)
            sizes = pc.list_value_length(column)
            for d in pc.unique(sizes).to_pylist():
                x = grid(column.filter(pc.equal(sizes, d)))
                # halves of the bits, so that no sum of a piece passes 64 bits
                total = (x >> 27).sum(axis=0).astype(object) * (1 << 27) + (x & ((1 << 27) - 1)).sum(axis=0).astype(object)
                had = seen.get(d)
                low, high = x.min(axis=0), x.max(axis=0)
                seen[d] = [len(x), total, low, high] if had is None else [had[0] + len(x), had[1] + total, np.minimum(had[2], low), np.maximum(had[3], high)]
    for d, (n, total, low, high) in seen.items():
        for i in range(d):
            yield d, i, n, Decimal(int(total[i])), int(low[i]), int(high[i])


@dataclass
class Grid:
    """The number of vectors and, by dimension, the exact sums of x; span bounds |n * x - S|."""

    n: int
    sums: list[int]
    span: int

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with one rounding each."""
        return (x - self.whole) - (self.rest / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S)^2, exactly."""
        if self.span**2 * len(self.sums) < 1 << 63:
            y = self.n * (x - self.whole) - self.rest.astype(np.int64)
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        made = [sum((self.n * int(v - w) - r) ** 2 for v, w, r in zip(row, self.whole, self.rest)) for row in x]
        return pa.array([Decimal(v) if v < 10**38 else None for v in made], pa.decimal128(38, 0))


def jacobi(matrix: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic rotations.

    A pair is rotated as long as its entry isn't negligible against its two
    diagonal entries, or, where these are rounding themselves, against the matrix.
    """
    a = np.array(matrix, float)
    d = len(a)
    v = np.eye(d)
    least = (_EPS * np.abs(a).max(initial=0.0)) ** 2
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off, gap = a[p, q], a[q, q] - a[p, p]
                if off * off <= max(_EPS * _EPS * abs(a[p, p] * a[q, q]), least * _EPS):
                    continue
                turned = True
                theta = gap / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                for m in (a.T, a, v.T):  # columns of a, rows of a, columns of v
                    one, two = m[p].copy(), m[q]
                    m[p], m[q] = c * one - s * two, s * one + c * two
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def _scatter(vectors: DataFrame, fit: Grid) -> np.ndarray:
    """The covariance of x: each task sums products of its centred rows; the sums of a dimension meet in one task in the order of tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(fit)
    d = len(fit.sums)
    parts, rows = _arrow_schema("part int, pos int, products array<double>"), _arrow_schema("pos int, products array<double>")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for piece in pieces(batch):
                y = shared.value.centred(grid(piece.column(0)))
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([*total])], schema=parts)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, row in zip(batch.column("pos").to_pylist(), batch.column("products")):
                total[pos] = total.get(pos, 0.0) + row.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([*total.values()])], schema=rows)

    made = vectors.select("_vector").mapInArrow(products, "part int, pos int, products array<double>")
    found = made.repartition("pos").sortWithinPartitions("pos", "part").mapInArrow(added, "pos int, products array<double>").collect()
    out = np.zeros((d, d))
    for r in found:
        out[r["pos"]] = r["products"]
    return (out + out.T) / 2 / fit.n


@dataclass
class Whitening:
    """Eigenvalues, falling, eigenvectors (columns) and the grid that they were fitted on."""

    values: np.ndarray
    vectors: np.ndarray
    fit: Grid

    @property
    def rank(self) -> int:
        """Eigenvalues above what rounding leaves of none."""
        return int((self.values > max(0.0, self.values[0]) * len(self.values) * _EPS).sum())

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows: the centred ones on the eigenvectors, over the roots of the eigenvalues; NaN without variance."""
        k, rank = min(components, len(self.values)), self.rank
        scaled = np.full((len(self.values), k), np.nan)
        scaled[:, : min(k, rank)] = self.vectors[:, : min(k, rank)] / np.sqrt(self.values[: min(k, rank)])
        return self.fit.centred(x) @ scaled


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    made = rows.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    return made.where(usable(F.col("_vector")))


def train(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    ensure_importable(rows.sparkSession)
    known = _vectors(rows, key, vector)
    schema = _arrow_schema("dims int, pos int, n long, total decimal(38,0), low long, high long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made := [*_sums(batches)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)

    parts = known.select("_vector").mapInArrow(run, "dims int, pos int, n long, total decimal(38,0), low long, high long")
    sums = cut(parts.groupBy("dims", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")), f"{shared_dir(rows.sparkSession)}/sums")
    first = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    if first is None:
        return None
    found = sums.where(F.col("dims") == first[0]).orderBy("pos").collect()
    n, total = found[0]["n"], [int(r["total"]) for r in found]
    fit = Grid(n, total, max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(found, total)))
    return Whitening(*jacobi(_scatter(known.where(F.size("_vector") == first[0]), fit)), fit)


def whiten(rows: DataFrame, model: Whitening | None, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation decimal(38,0) and whitened array<double> of each usable row of the model's dimension."""
    ensure_importable(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>"
    out = _arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x = grid(piece.column(1))
                w = shared.value.project(x, components)
                cells = pa.array(w.ravel(), from_pandas=True)  # NaN becomes null
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), cells)
                yield pa.RecordBatch.from_arrays([piece.column(0), shared.value.fit.deviations(x), lists], schema=out)

    d = len(model.values) if model else -1
    return _vectors(rows, key, vector).where(F.size("_vector") == d).select(F.col("_key").alias(key), "_vector").mapInArrow(run, schema)


def components_of(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first components.

    identity_error is measured on what was written: the largest entry of the
    covariance of all whitened rows less the identity.
    """
    model = train(rows, key, vector)
    made = cut(whiten(rows, model, components, key, vector), f"{shared_dir(rows.sparkSession)}/whitened")
    k = min(components, model.rank) if model else 0
    error, names = F.lit(None).cast("double"), [(i, j) for i in range(k) for j in range(i, k)]
    if names:
        w = [F.col("whitened")[i] for i in range(k)]
        found = made.agg(*[F.covar_pop(w[i], w[j]).alias(f"{i}_{j}") for i, j in names]).first()
        error = F.lit(max(abs(v - (i == j)) for v, (i, j) in zip(found, names)))
    total = float(model.values.sum()) if model else 0.0
    shares = F.array(*[F.lit(float(v) / total if total > 0 else 0.0) for v in (model.values[:components] if model else [0.0])])
    one = made.select(F.col(key), "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return one.select(
        F.col(key), (F.col("_at") + 1).alias("component"), F.lit(model.fit.n if model else 0).cast("long").alias("n"), "deviation", F.col("_value").alias("whitened"), shares[F.col("_at")].alias("explained"), error.alias("identity_error")
    )
