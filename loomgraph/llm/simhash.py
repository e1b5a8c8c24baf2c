"""SimHash near-deduplication by pigeonhole blocks.

A fingerprint's 64 bits are cut into BLOCKS blocks.  Two fingerprints that
differ in at most DISTANCE bits leave BLOCKS - DISTANCE blocks equal, so they
meet under at least one choice of that many blocks.  Distinct fingerprints are
joined on each choice, each pair that meets is verified, and connected
components of the links are found by alternating star contractions.

Bounds.  Only distinct fingerprints are joined, so copies cost nothing.  A
bucket of up to BUCKET fingerprints is verified by one task, which emits a
spanning forest of its links, not its pairs.  A larger bucket is dealt out
again on choices of blocks of the bits that are still free, and so on: 27 bits
at least are equal in the first buckets, 44 in the second and 52 in the third,
which by that hold 4,096 fingerprints at most.  No link is lost at any level.

Defined results: null and empty texts, and texts of white space, have
fingerprint zero and link like any other.  Texts with fewer words than a
shingle have one shingle, their whole sequence.  Repeated rows share a
component; a null id is in no component of its own and never the smallest
unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_importable, fresh, join_groups, rows_operator, shared_dir

WORDS, SEED, DISTANCE = 4, 42, 4
BLOCKS, SUB_BLOCKS = 7, 8
BUCKET = 8192


def _cuts(bits: list[int], blocks: int) -> list[int]:
    """Masks that deal bits, as even as can be, to blocks."""
    ends = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(ends, ends[1:])]


def _choices(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks of which any two fingerprints within distance agree on one at least, if they agree on all other bits."""
    return [sum(c) for c in combinations(_cuts(bits, blocks), blocks - distance)]


#: The masks of the first level.
MASKS = _choices(list(range(64)), BLOCKS, DISTANCE)


@lru_cache(maxsize=None)
def sub_masks(mask: int) -> np.ndarray:
    """The masks of the next level, over bits that mask leaves free."""
    return np.array([mask | s for s in _choices([b for b in range(64) if not mask >> b & 1], SUB_BLOCKS, DISTANCE)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles, each hashed by XXH64 with seed 42."""
    from xxhash import xxh64_intdigest as digest

    w = (text or "").encode().lower().split()  # bytes: A-Z are lower-cased, and words end at ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - words + 1)
    last = ends[words - 1 :] if len(w) >= words else ends[-1:]
    h = np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def text_sum(text: str) -> Column:
    """A digest that tells texts of one id apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, sum (text_sum) and fingerprint, as the signed long of its 64 bits, of each row."""

    def run(keys, sums, texts):
        for k, s, t in zip(keys, sums, texts):
            f = fingerprint(t, words)
            yield k, s, f - (f >> 63 << 64)

    return rows_operator(docs, [key, text_sum(text).alias("_sum"), text], run, f"key {docs.schema[key].dataType.simpleString()}, sum string, fingerprint long")


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (smaller, larger) of a spanning forest of the links between distinct fingerprints."""
    n = len(prints)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    step = max(1, 1 << 20 >> max(0, n.bit_length() - 1))
    for at in range(0, n, step):
        rows = prints[at : at + step, None]
        close = np.argwhere(np.bitwise_count(rows ^ prints[None, at:]) <= distance)
        close = close[close[:, 0] < close[:, 1]]
        for i, j in (close + at).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                x, y = int(prints[i]), int(prints[j])
                edges.append((min(x, y), max(x, y)))
    return edges


def _signed(v: int) -> int:
    return v - (v >> 63 << 64)


def _dealt(rows: DataFrame) -> DataFrame:
    """(mask, bits, fingerprint) with the rows of one bucket side by side within a task."""
    return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits")


def _buckets(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted rows (mask, bits, fingerprint): edges of each bucket (kind 0), or mask and fingerprint of the rows of a bucket beyond limit (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b"]
        held: list[np.ndarray] = []
        at, over = None, False

        def rows(kind: int, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names)

        def close() -> Iterator[pa.RecordBatch]:
            n = sum(map(len, held))
            if n > 1 and not over:
                edges = forest(np.concatenate(held).view(np.uint64))
                if edges:
                    yield rows(0, [_signed(a) for a, _ in edges], [_signed(b) for _, b in edges])

        for batch in batches:
            masks, bits, prints = (batch.column(i).to_numpy() for i in range(3))
            if not len(masks):
                continue
            ends = np.flatnonzero(np.append((masks[1:] != masks[:-1]) | (bits[1:] != bits[:-1]), True)) + 1
            start = 0
            for end in ends.tolist():
                name = (int(masks[start]), int(bits[start]))
                if name != at:
                    yield from close()
                    held, at, over = [], name, False
                held.append(prints[start:end])
                if over or sum(map(len, held)) > limit:
                    over = True
                    for part in held:
                        yield rows(1, np.full(len(part), name[0]), part)
                    held = []
                start = end
        yield from close()

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mask, bits, fingerprint) under each mask of the next level, for rows (mask, fingerprint)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            masks = np.stack([sub_masks(m % (1 << 64)) for m in part.column(0).to_pylist()])
            prints = np.repeat(part.column(1).to_numpy(), masks.shape[1])
            masks = masks.reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(prints & masks), pa.array(prints)], ["mask", "bits", "fingerprint"])


def links(prints: DataFrame, path: str) -> DataFrame:
    """Edges a < b (signed longs) that connect just the fingerprints within DISTANCE of each other; prints: distinct longs in column fingerprint."""
    ensure_importable(prints.sparkSession)
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fingerprint").bitwiseAND(_signed(m)).alias("bits")) for m in MASKS])
    rows = prints.select(F.explode(keys).alias("k"), "fingerprint").select("k.mask", "k.bits", "fingerprint")
    found: DataFrame | None = None
    for level in range(3):
        # buckets of the third level are small by construction
        made = cut(_dealt(rows).mapInArrow(_buckets(BUCKET if level < 2 else 1 << 62), "kind int, a long, b long"), f"{path}/level{level}")
        edges, large = made.where("kind = 0").select("a", "b"), made.where("kind = 1").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        if level == 2 or large.isEmpty():
            return found.distinct()
        rows = large.mapInArrow(_finer, "mask long, bits long, fingerprint long")
    raise AssertionError


def components(edges: DataFrame, path: str) -> DataFrame:
    """node and root (the smallest node it reaches) for each node of edges (a, b), a != b: large-star and small-star steps until nothing moves.

    Each step aggregates the smallest neighbour of a node before its edges are
    joined to it, and is written to the shared folder.
    """
    edges = cut(edges.select("a", "b"), f"{path}/star0")
    for i in range(1, 100):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now a > b: each node is tied to its smallest lower neighbour, and so are that node's other lower neighbours
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{path}/star{i}")
        # both are sets from the second step on, so they are equal if one holds the other and is as large
        done = i > 1 and new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if done:
            break
    else:
        raise RuntimeError("the components haven't settled")
    roots = edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _classes(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """near_classes() with the hash of the text, and the fingerprint as a long."""
    at = shared_dir(docs.sparkSession)
    rows = cut(fingerprints(docs, key, text, words), f"{at}/prints")
    own = cut(rows.groupBy("fingerprint").agg(F.min("key").alias("least"), F.count("*").alias("n")), f"{at}/own")
    roots = components(links(own.select("fingerprint"), at), at)
    tied = own.join(roots, own.fingerprint == roots.node, "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    groups = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    total = rows.count()
    named = join_groups(tied.select("fingerprint", "n", "root"), groups, "root", "group_size", total).select("fingerprint", "n", "component_id", "group_size")
    return join_groups(rows, cut(named, f"{at}/named"), "fingerprint", "n", total)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (smallest key reachable), group_size."""
    print_ = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return _classes(docs, key, text, words).select(F.col("key").alias(key), print_, "component_id", "group_size")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """docs without those that are not the smallest id of their component (all rows of that id and component stay)."""
    names = [fresh(docs, "_gone_id"), fresh(docs, "_gone_sum")]
    told = _classes(docs, key, text, words).where(~F.col("key").eqNullSafe(F.col("component_id")))
    gone = told.select("key", "sum").distinct().toDF(*names)
    # rows of one id may differ in text, so an id alone doesn't name what goes
    return docs.join(gone, F.col(key).eqNullSafe(F.col(names[0])) & (text_sum(text) == F.col(names[1])), "left_anti")
