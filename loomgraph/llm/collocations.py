"""Phrase collocations: exact counts of word n-grams by multiplicity, scored by their weakest cut.

Texts are cut to pieces, and equal pieces of a language become one row with their
number.  A task splits blocks of pieces into words, adds up equal n-grams of a
block with the pieces' multiplicities as weights, and deals them by their hash to
buckets, each bucket's share of a block as one compressed row.  A bucket is
counted in duckdb, which streams these rows through one aggregation and spills it
to Spark's scratch folder beyond MEMORY, so neither the size of a bucket nor a hot
n-gram needs memory.  First come n-grams of one and two words.  A longer one can
only be frequent if all its pairs are, so the second pass counts those three and
four words long whose pairs are all set in a bit map of the frequent pairs' hashes
(MAP_BITS, whatever the input; hashes that meet only cost time).

Candidates then ask for the counts of their parts: requests and counts meet in a
join by phrase, where parts that very many candidates ask for are told apart from
the others (common.join_groups).  What a phrase's longer phrases have at most is
added up in the same way.  The first rows of a language are found within parts of
its candidates, and then among those.

Defined results: a null text counts as empty, a null language as 'und'.  Texts and
pieces of any length are taken whole; pieces of more than LONG bytes are split
into runs of words that overlap.  Scores are compared exactly, in 38 digits.
Repeated rows count as often as they come.  Empty tables give no rows.  Only the
text and lang columns are read.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _arrow_schema, cut, ensure_importable, join_groups, shared_dir

# Least count of a candidate, percent of it that a longer phrase needs, rows of a language, most words, scale of scores.
LEAST, SHARE, FIRST, MOST, SCALE = 30, 80, 2000, 4, 2_000_000
SPLIT = "[.,;:!?\\x0A-\\x0D]"
#: Words of distinct pieces that a bucket is made for, about; parts of a language's candidates that are ranked apart.
BUCKET_WORDS, PARTS = 2_000_000, 64
#: Bytes of text of a block, of dealt n-grams that a task gathers, and of a piece that is split.
BLOCK, GATHERED, LONG = 4 << 20, 24 << 20, 1 << 20
#: duckdb's memory in a task, and bits of the map of frequent pairs (a power of two).
MEMORY, MAP_BITS = "192MB", 1 << 26
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("weight", pa.int64())])


def pieces_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece, times, words: distinct pieces with single spaces between words, how often they come, their numbers of words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
    each = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(lower, SPLIT)).alias("piece"))
    ragged = F.col("piece").contains("  ") | F.col("piece").contains("\t")
    tidy = F.trim(F.when(ragged, F.regexp_replace("piece", "[ \\t]+", " ")).otherwise(F.col("piece")))
    counted = each.select("lang", tidy.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))
    return counted.withColumn("words", (F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("long"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """lang, piece, times, tail in blocks of about BLOCK bytes; tail: words at the end that begin nothing here, as the next row repeats them."""
    held: list[pa.RecordBatch] = []
    size = 0

    def with_tail(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("tail", pa.array(np.zeros(batch.num_rows, np.int64)))

    for batch in batches:
        batch = batch.select(["lang", "piece", "times"])
        long = pc.greater(pc.binary_length(batch.column("piece")), LONG)
        if pc.any(long).as_py():
            for row in batch.filter(long).to_pylist():
                yield from _runs(row)
            batch = batch.filter(pc.invert(long))
        step = max(1, batch.num_rows * BLOCK // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            held.append(with_tail(some))
            size += some.nbytes
            if size >= BLOCK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _runs(row: dict) -> Iterator[pa.Table]:
    """A long piece as runs of words, each but the last followed by the MOST - 1 words that begin the next."""
    words = row["piece"].split(" ")
    step = LONG // 8
    for at in range(0, len(words), step):
        some = words[at : at + step + MOST - 1]
        tail = len(some) - min(step, len(words) - at)
        yield pa.table({"lang": [row["lang"]], "piece": [" ".join(some)], "times": [row["times"]], "tail": [tail]})


def _start(names: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x, 7) for x in names], np.uint64)


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram and one more word."""
    h = (h ^ word) * _MIX
    return h ^ (h >> _TURN)


def hashes(langs: list[str], grams: list[str]) -> list[int]:
    """The hashes of n-grams of languages, signed."""
    lang = dict(zip(names := sorted(set(langs)), _start(names)))
    parts = [g.split(" ") for g in grams]
    word = dict(zip(names := sorted({w for p in parts for w in p}), _start(names)))
    out = np.array([lang[x] for x in langs], np.uint64)
    for k in range(max(map(len, parts), default=0)):
        some = np.array([len(p) > k for p in parts])
        out[some] = _joined(out[some], np.array([word[p[k]] for p in parts if len(p) > k], np.uint64))
    return out.view(np.int64).tolist()


def grams(block: pa.Table, sizes: tuple[int, ...], frequent: np.ndarray | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(lang, gram, weight) and hashes of the distinct n-grams of a block; those longer than two words only where frequent has all their pairs."""
    langs = block.column("lang").combine_chunks().dictionary_encode()
    split = pc.split_pattern(block.column("piece").combine_chunks(), " ")
    ends = split.offsets.to_numpy()
    ends = ends - ends[0]
    coded = split.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    at = np.repeat(np.arange(block.num_rows), np.diff(ends))  # each word's piece
    # how many words from each on belong to its piece, and whether an n-gram may begin there
    room = ends[1:][at] - np.arange(len(code))
    begins = np.flatnonzero(room > block.column("tail").to_numpy()[at])
    lang, times = langs.indices.to_numpy().astype(np.int64)[at], block.column("times").to_numpy()[at]
    first, word = _start(langs.dictionary.to_pylist())[lang], _start(names.to_pylist())[code]
    pair = None
    if max(sizes) > 2:
        h = _joined(_joined(first[:-1], word[:-1]), word[1:])
        bit = (h & np.uint64(MAP_BITS - 1)).astype(np.int64)
        pair = np.append((frequent[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool), False)
    for n in sizes:
        start = begins[room[begins] >= n]
        for k in range(n - 1 if pair is not None else 0):
            start = start[pair[start + k]]
        if not len(start):
            continue
        group = lang[start]
        for k in range(n):
            _, some, group = np.unique(group * len(names) + code[start + k], return_index=True, return_inverse=True)
        weight = np.bincount(group, times[start]).astype(np.int64)
        some = start[some]
        h = first[some]
        for k in range(n):
            h = _joined(h, word[some + k])
        texts = names.take(pa.array(code[some]))
        for k in range(1, n):
            texts = pc.binary_join_element_wise(texts, names.take(pa.array(code[some + k])), " ")
        yield pa.Table.from_arrays([langs.dictionary.take(pa.array(lang[some])), texts, pa.array(weight)], schema=_GRAMS), h


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _dealt(found: Iterator[tuple[pa.Table, np.ndarray]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, rows) of n-grams; GATHERED bytes of them are held before they are handed on."""
    held: list[list[pa.Table]] = [[] for _ in range(buckets)]
    size = 0

    def out() -> Iterator[tuple[int, bytes]]:
        for bucket, tables in enumerate(held):
            if tables:
                yield bucket, _packed(pa.concat_tables(tables).combine_chunks())
                held[bucket] = []

    for table, h in found:
        bucket = ((h >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        table = table.take(pa.array(order))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            held[b].append(table.slice(bounds[b], bounds[b + 1] - bounds[b]))
        size += table.nbytes
        if size >= GATHERED:
            yield from out()
            size = 0
    yield from out()


def _counted(parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """lang, gram, f of the n-grams with at least LEAST occurrences in rows of a bucket, by duckdb."""
    import duckdb

    scratch = tempfile.mkdtemp(prefix="grams-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    try:
        with duckdb.connect(":memory:", config={"threads": "1", "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": "false"}) as db:
            rows = (batch for part in parts for batch in pa.ipc.open_stream(part))
            db.register("rows", pa.RecordBatchReader.from_batches(_GRAMS, rows))
            yield from db.sql(f"SELECT lang, gram, CAST(sum(weight) AS BIGINT) AS f FROM rows GROUP BY ALL HAVING sum(weight) >= {LEAST}").to_arrow_reader(1 << 14)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


_COUNTS = "lang string, gram string, f long, words int, hash long"


def counts(pieces: DataFrame, sizes: tuple[int, ...], buckets: int, frequent: np.ndarray | None = None) -> DataFrame:
    """_COUNTS of the n-grams of these sizes that come LEAST times or more."""
    ensure_importable(pieces.sparkSession)
    shared = pieces.sparkSession.sparkContext.broadcast(frequent)
    blobs, out = _arrow_schema("bucket int, rows binary"), _arrow_schema(_COUNTS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for block in _blocks(batches) for x in grams(block, sizes, shared.value))
        for bucket, rows in _dealt(found, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([rows])], schema=blobs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _counted(row.as_buffer() for batch in batches for row in batch.column("rows")):
            langs, texts = made.column(0).to_pylist(), made.column(1).to_pylist()
            number = pa.array([1 + g.count(" ") for g in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), made.column(2), number, pa.array(hashes(langs, texts), pa.int64())], schema=out)

    dealt = pieces.select("lang", "piece", "times").mapInArrow(deal, "bucket int, rows binary")
    return dealt.repartition(buckets, "bucket").select("rows").mapInArrow(count, _COUNTS)


def bit_map(pairs: DataFrame) -> np.ndarray:
    """Bytes with the bits of the hashes set; what comes to the driver is MAP_BITS / 64 numbers at most."""
    bit = F.col("hash").bitwiseAND(F.lit(MAP_BITS - 1))
    made = pairs.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(hash & {MAP_BITS - 1} & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[made["at"].to_numpy(np.int64)] = made["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def frequent_grams(docs: DataFrame, at: str, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, gram, f, words of all n-grams of 1 to MOST words that come LEAST times or more; lang, n: words of each language."""
    pieces = cut(pieces_of(docs, text, lang), f"{at}/pieces")
    totals = cut(pieces.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n"), F.sum("words").alias("distinct")), f"{at}/totals")
    distinct = totals.agg(F.sum("distinct")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct // BUCKET_WORDS))
    short = cut(counts(pieces, (1, 2), buckets), f"{at}/short")
    long = cut(counts(pieces, tuple(range(3, MOST + 1)), buckets, bit_map(short.where("words = 2"))), f"{at}/long")
    return short.unionByName(long).drop("hash"), totals.drop("distinct")


def _sub(first, number) -> str:
    return F.array_join(F.slice("_w", first, number), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first rows."""
    at = shared_dir(docs.sparkSession)
    known, totals = frequent_grams(docs, at, text, lang)
    candidates = known.where("words > 1").select(F.struct("lang", "gram").alias("_of"), F.col("f").alias("a"), "words", F.split("gram", " ").alias("_w"))

    # requests for the counts of the two parts of each cut; a part has a count, as it comes at least as often as its phrase
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    name = lambda part: F.struct(F.col("_of.lang").alias("lang"), part.alias("gram"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), name(_sub(1, F.col("k"))).alias("part")), F.struct(F.lit(False).alias("left"), name(_sub(F.col("k") + 1, F.col("words") - F.col("k"))).alias("part"))
    )
    requests = cut(cuts.select("_of", "a", "k", F.inline(sides)), f"{at}/requests")
    asked = requests.groupBy("part").agg(F.count("*").alias("asked"))
    answers = asked.join(known.select(F.struct("lang", "gram").alias("part"), "f"), "part")
    answered = join_groups(requests, answers, "part", "asked", requests.count())
    by_cut = answered.groupBy("_of", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = by_cut.groupBy("_of", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_least"))

    # the most that a longer phrase around each has
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _sub(i, n))))
    inner = candidates.where("words > 2").withColumn("_span", F.explode(F.array_distinct(spans)))
    around = inner.select(name(F.col("_span")).alias("_of"), F.col("a").alias("_longer")).groupBy("_of").agg(F.max("_longer").alias("_longer"))
    covered = F.expr(f"100 * cast(_longer as decimal(19,0)) >= {SHARE} * cast(a as decimal(19,0))")
    kept = scored.join(around, "_of", "left").where(F.col("_longer").isNull() | ~covered)
    kept = kept.select("_of.lang", F.col("_of.gram").alias("phrase"), "a", "_least.l", "_least.r", F.col("_least.score").cast("long").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("_part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
