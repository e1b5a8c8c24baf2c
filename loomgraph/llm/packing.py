"""Hierarchical packing of token sequences into windows of several context sizes.

A document's tokens beyond its last full window of the longest size are routed
to the smallest tier that holds them.  Tiers are packed from the longest on: each
of a tier's documents opens a window, whose gap takes the longest documents of
the shorter tiers that fit; where none fits, the shortest one is cut to fill it
and its rest goes back to the tier of its new length.  So a closed window has no
padding, and a pool of documents leaves one open window at most.

A task packs the documents that it tokenises, in pools of at most POOL tokens,
and hands on what its last pool leaves, less than a window.  These rests are
packed in the same way, again and again, until one task holds them all, whose
last window is padded.  So no text and no tokens are shuffled but these rests.
Windows are numbered over all tasks, longest first, and dealt to steps in turn,
which differ by less than the longest window.

Defined results: a null text counts as empty; a document has its ids and the id
END, so each has at least one.  Rows are documents, repeated ones and null ids
too.  Only the key and text columns are read.  An empty table gives no rows.
The packing follows the order of rows in the input's splits, so it is the same
in each run over the same files, whatever executors are lost.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import Memo, cut, partition_operator, shared_dir

#: Context sizes, falling, all powers of two.
TIERS = (4096, 2048, 1024, 512)
#: Tokens and documents that a task packs at once, and tokens of a step.
POOL, POOL_ROWS, STEP = 1 << 20, 1 << 14, 64 * 4096
END = 2
#: Bytes of encoded words that a Python worker remembers, about, for each of two memories.
CACHE_BYTES = 160 << 20
# Fixed value: the public pre-tokeniser pattern of the vocabulary, on lower-case text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Ids:
    """Ids of texts as the tokenizers library gives them, as bytes of 32-bit numbers.

    No token crosses white space, so words are encoded once and remembered.  Words
    of characters from U+0021 to U+017F, which normalise by lower case alone, go to
    the library's merge model directly; all others go through the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.shown = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.pre = regex.compile(PATTERN, regex.V0)
        self.runs = Memo(self._run, CACHE_BYTES)
        self.words = Memo(self._word, CACHE_BYTES)

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.shown)
        return array("i", [t.id for t in self.model.tokenize(run)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._run(word.decode().lower())
        text = word.decode()
        if max(text) >= "ƀ" or min(text) < "!" or any(a in word for a in self.added):
            return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        return self._run(text) if text.isalpha() else b"".join(map(self.runs.__getitem__, self.pre.findall(text)))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


@lru_cache(maxsize=2)
def load(path: str) -> Ids:
    """One instance for each file and worker process."""
    return Ids(path)


def pack(lengths: Iterable[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Full windows (tier, parts (item, start, length)), and the parts of the one that stays open."""
    longest, windows = tiers[0], []
    rest: list[tuple[int, int, int]] = []  # (length, item, start), rising
    for item, n in enumerate(lengths):
        windows += [(longest, [(item, at, longest)]) for at in range(0, n - longest + 1, longest)]
        if n % longest:
            rest.append((n % longest, item, n - n % longest))
    rest.sort()
    for tier, shorter in zip(tiers, (*tiers[1:], 0)):
        while rest and rest[-1][0] > shorter:
            n, item, start = rest.pop()
            parts, gap = [(item, start, n)], tier - n
            while gap and rest:
                at = bisect_right(rest, (gap, 1 << 62, 0))
                if at:
                    n, item, start = rest.pop(at - 1)
                else:
                    n, item, start = rest.pop(0)
                    insort(rest, (n - gap, item, start + gap))
                    n = gap
                parts.append((item, start, n))
                gap -= n
            if gap:
                return windows, parts
            windows.append((tier, parts))
    return windows, []


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task long, place long, ids binary"


def _packed(items: Iterator[tuple], level: int, tiers: tuple[int, ...], last: bool) -> Iterator[tuple]:
    """Rows of _PIECE behind their keys from (key, tokens of the document, start, ids); what stays open has ids in place of a sequence, unless it is the last."""
    number = level << 28 | TaskContext.get().partitionId()
    pool: list[tuple] = []
    held, made, places = 0, 0, Counter()

    def told(window: list, tier: int) -> Iterator[tuple]:
        nonlocal made
        offset = 0
        for item, start, n in window:
            key, tokens, base, ids = pool[item]
            yield key, base + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, number << 30 | made, offset, tier, number, places[tier], None
            offset += n
        made += 1
        places[tier] += 1

    def flush() -> Iterator[tuple]:
        nonlocal pool, held
        windows, left = pack((len(ids) // 4 for *_, ids in pool), tiers)
        for tier, window in windows:
            yield from told(window, tier)
        pool = [(pool[i][0], pool[i][1], pool[i][2] + start, pool[i][3][4 * start : 4 * (start + n)]) for i, start, n in left]
        held = sum(n for *_, n in left)

    for item in items:
        pool.append(item)
        held += len(item[3]) // 4
        if held >= POOL or len(pool) >= POOL_ROWS:
            yield from flush()
    yield from flush()
    if last and pool:
        yield from told([(i, 0, len(ids) // 4) for i, (*_, ids) in enumerate(pool)], tiers[0])
    else:
        for key, tokens, start, ids in pool:
            yield key, start, len(ids) // 4, None, tokens, None, None, None, number, None, ids


def packed(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, encoder: Callable[[str], Callable] = load) -> DataFrame:
    """Pieces of documents in windows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step."""
    at = shared_dir(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, {_PIECE}"

    def first(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids, end = encoder(vocabulary), array("i", [END]).tobytes()
        tokens = ((k, ids(t) + end) for k, t in rows)
        return _packed(((k, len(x) // 4, 0, x) for k, x in tokens), 0, tiers, False)

    made = cut(partition_operator(docs.select(F.col(key).alias("_key"), text), first, schema), f"{at}/level0")
    done, level = made.where(F.col("ids").isNull()), 0
    while True:
        left = made.where(F.col("ids").isNotNull()).select("_key", "doc_tokens", "start", "ids", "task")
        tokens = left.agg(F.sum(F.length("ids") / 4)).first()[0]
        if not tokens:
            break
        level, groups = level + 1, -(-int(tokens) // POOL)
        dealt = left.repartition(groups, "task").sortWithinPartitions("task", "_key", "start", F.crc32("ids")).drop("task")
        made = cut(partition_operator(dealt, lambda rows, n=level, last=groups == 1: _packed(rows, n, tiers, last), schema), f"{at}/level{level}")
        done = done.unionByName(made.where(F.col("ids").isNull()))
    return _in_steps(done).select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


def _in_steps(done: DataFrame) -> DataFrame:
    """done with step: windows of all tasks, longest first, in turn.  What is ordered in one place is a count for each task and tier."""
    counts = done.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("_n"))
    everything = W.orderBy(F.desc("tier"), "task")
    before = F.coalesce(F.sum("_n").over(everything.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(F.col("_n") * F.col("tier")).over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    placed = counts.select("task", "tier", before.alias("_before"), F.ceil(whole / STEP).alias("_steps"))
    return done.join(placed, ["task", "tier"]).withColumn("step", (F.col("_before") + F.col("place")) % F.col("_steps"))
