"""An inverted index that lasts: postings by term, kept up to date by changed documents, read for a query's terms only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..streaming.store import Store
from .search import B, K1


@dataclass(frozen=True)
class Item:
    """What a document is asked for: words in a row, the last of which may be the beginning of one; wanted or not."""

    words: tuple[str, ...]
    prefix: bool = False
    wanted: bool = True


_PART = re.compile(r'\s*(?:"(?P<phrase>[^"]*)"(?P<open>\*?)|(?P<word>\w+)(?P<any>\*?))(?=\s|$)')


def alternatives(query: str) -> list[list[Item]]:
    """Lists of items of which a document must satisfy one: words, words with a star for any ending and quoted phrases, all of them wanted, NOT before what mustn't be there, OR between lists.  None for bad syntax."""
    out: list[list[Item]] = [[]]
    at, wanted = 0, True
    query = query.strip()
    while at < len(query):
        m = _PART.match(query, at)
        if not m:
            return []
        at = m.end()
        if m["word"] in ("OR", "NOT", "AND") and not m["any"]:
            # an operator stands between items; NOT needs something wanted before it
            if not wanted or not out[-1]:
                return []
            if m["word"] == "OR":
                out.append([])
            wanted = m["word"] != "NOT"
            continue
        words = tuple(re.findall(r"\w+", (m["phrase"] or m["word"] or "").lower()))
        if not words:
            return []
        out[-1].append(Item(words, bool(m["open"] or m["any"]), wanted))
        wanted = True
    return out if wanted and all(any(i.wanted for i in items) for items in out) and query.split()[-1:] not in (["AND"], ["OR"]) else []


#: Words that are gathered at a time, about; a document is gathered whole.
WORDS = 1 << 20


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, doc, tf, places of documents with their words (doc, w)."""
    schema = pa.schema([("term", pa.string()), ("doc", pa.string()), ("tf", pa.int32()), ("places", pa.list_(pa.int32()))])
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + WORDS, "right")))
            some, n = batch.slice(first, last - first), sizes[first:last]
            first = last
            coded = some.column(1).flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(codes):
                continue
            at = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
            keys = np.repeat(np.arange(len(n), dtype=np.int64), n) * len(coded.dictionary) + codes
            order = np.argsort(keys, kind="stable")  # places stay in order
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            offsets = np.append(starts, len(keys)).astype(np.int32)
            doc, term = np.divmod(keys[starts], len(coded.dictionary))
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32)))
            rows = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term)).cast(pa.string()), some.column(0).take(pa.array(doc)).cast(pa.string()), pa.array(np.diff(offsets)), places], schema=schema)
            for i in range(0, len(rows), 10_000):
                yield rows.slice(i, 10_000)


class Index:
    """Postings (term, doc, tf, places) in buckets by term, and lengths of documents, below a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.store = Store(
            spark, folder, {"postings": "term string, doc string, tf int, places array<int>", "lengths": "doc string, len int"},
            {"postings": ("doc",), "lengths": ("doc",)}, {"postings": "term"}, buckets,
        )

    def update(self, number: int, docs: DataFrame, gone: DataFrame | None = None, text: str = "text") -> bool:
        """Take batch number: docs (doc, text) replace what the index has of them, gone (doc) go.  A batch that is in changes nothing."""
        words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        rows = docs.select("doc", words.alias("w"))
        ship(self.store.spark)
        # terms of a document are gathered in its task, and each task writes its postings: words aren't shuffled
        places = rows.mapInArrow(_gathered, "term string, doc string, tf int, places array<int>")
        changed = docs.select(F.col("doc").alias("path"))
        changed = changed if gone is None else changed.unionByName(gone.select(F.col("doc").alias("path")))
        return self.store.apply(number, changed, ("postings",), postings=places, lengths=rows.select("doc", F.size("w").alias("len")))

    def postings(self, items: list[Item]) -> DataFrame:
        """Postings of the items' words: from the buckets of whole words, and for beginnings from all buckets, where the files' footers tell which blocks to read."""
        whole = sorted({w for i in items for w in (i.words[:-1] if i.prefix else i.words)})
        rows = self.store.read("postings", whole) if whole else None
        for start in sorted({i.words[-1] for i in items if i.prefix}):
            found = self.store.read("postings").where(F.col("term").startswith(start))
            rows = found if rows is None else rows.unionByName(found)
        return rows.dropDuplicates(["term", "doc"])

    def match(self, query: str, n: int | None = 20) -> DataFrame:
        """doc, score: documents that satisfy a query (alternatives()), by BM25 of what is wanted, each item counted as one term."""
        spark = self.store.spark
        groups = alternatives(query)
        if not groups:
            return spark.createDataFrame([], "doc string, score double")
        items = list(dict.fromkeys(i for g in groups for i in g))
        found = self.postings(items).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_p"))
        counts = found.select("doc", *[_times(F.col("_p"), i).alias(f"_t{k}") for k, i in enumerate(items)])
        lengths = self.store.read("lengths")
        stats = lengths.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg")).join(counts.agg(*[F.count_if(F.col(f"_t{k}") > 0).alias(f"_d{k}") for k in range(len(items))]))
        score, ok = F.lit(0.0), F.lit(False)
        for k, item in enumerate(items):
            tf, df = F.col(f"_t{k}"), F.col(f"_d{k}")
            if item.wanted:
                score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
        for g in groups:
            fits = F.lit(True)
            for item in g:
                fits = fits & ((F.col(f"_t{items.index(item)}") > 0) == F.lit(item.wanted))
            ok = ok | fits
        rows = counts.where(ok).join(lengths, "doc").join(F.broadcast(stats))  # stats is one row
        out = rows.select("doc", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.length("doc"), "doc")
        return out.limit(n) if n else out


def _times(places: Column, item: Item) -> Column:
    """How often an item comes in a document, from the places of its terms."""
    none = F.array().cast("array<int>")
    of = lambda w: F.coalesce(F.element_at(places, w), none)
    starts = of(item.words[0]) if not item.prefix or len(item.words) > 1 else _beginning(places, item.words[0])
    for k, w in enumerate(item.words[1:], 1):
        last = _beginning(places, w) if item.prefix and k == len(item.words) - 1 else of(w)
        starts = F.array_intersect(starts, F.transform(last, lambda x: x - F.lit(k)))
    return F.size(starts)


def _beginning(places: Column, start: str) -> Column:
    """Places of the words that begin so."""
    return F.flatten(F.map_values(F.map_filter(places, lambda term, _: F.startswith(term, F.lit(start)))))
