"""Quality rules by tokeniser fertility.

Public vocabularies measure characters per token, the share of byte-fallback
tokens and the entropy of tokens.  Each script and size class (a power of two of
tokens of the first vocabulary, since entropy depends on length) has rejection
bands about the median of all documents that pass the base rules: so many
quartile distances, and at least a least half-width.  Few characters per token
(gibberish), low entropy (filler and markup) and a high byte-fallback share
(broken or foreign bytes) reject a document when all vocabularies find the same
measure out of its band; the other sides stay open.

Defined results: a null text has no words; documents without words have
measures of 0 and fail the base rules.  A class of a script with fewer than
LEAST documents takes that class's bands of all documents, and keeps all if they
are fewer too.  Repeated rows are judged alike.
Only the id and text columns are read.
"""

from __future__ import annotations

import unicodedata
from base64 import b64decode
from collections import Counter
from functools import lru_cache, reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, rows_operator, shared_dir

#: Base rules: least words, most repeated words in 100.
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5
_SYMBOLS = "[#*$%&|<>]".strip("[]")
_WHITE = " \t\n\x0b\f\r"
#: Bands: the side (-1: low values are rejected), quartile distances, least half-width and cells per unit of each measure.
MEASURES = {"chars_per_token": (-1, 4.0, 0.4, 100), "byte_share": (1, 4.0, 0.05, 1000), "entropy": (-1, 1.75, 0.03, 1000)}
#: Bytes of words and their tokens that a worker remembers, about; longer words are forgotten first.
CACHE_BYTES, LONG = 64 << 20, 64
#: Words that a vocabulary is asked for at once at most, and their bytes, about; tokens are Python numbers only during a call.
CALL_WORDS, CALL_BYTES = 4096, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Documents that a class needs for bands of its own.
LEAST = 50


class Vocabulary:
    """Token ids of single words under a SentencePiece model, a table of byte ranks or a vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            p = SentencePieceProcessor(model_file=path)
            self.size = p.get_piece_size()
            self.fallback = np.fromiter((p.is_byte(i) for i in range(self.size)), bool, self.size)
            self.encode = lambda words: p.encode(words, num_threads=1)
        else:
            if path.endswith(".tiktoken"):
                from tiktoken import Encoding

                from .bpe import PATTERN

                with open(path, "rb") as f:
                    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
                e = Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
                strings, plain = {i: s for s, i in ranks.items()}, e.encode_ordinary
            else:
                from .bpe import load

                b = load(path)
                strings, plain = b.bytes, b.encode
            self.size = max(strings) + 1
            # a byte vocabulary falls back where a token is one byte of a character of several
            self.fallback = np.zeros(self.size, bool)
            self.fallback[[i for i, s in strings.items() if len(s) == 1 and s[0] >= 0x80]] = True
            self.encode = lambda words: [plain(" " + w) for w in words]

    def measure(self, tokens: np.ndarray, bounds: np.ndarray, chars: np.ndarray) -> list[list]:
        """For each text: characters per token, byte-fallback share, entropy as a share of its greatest value, tokens.

        bounds are where the tokens of each text begin, and their end; the tokens of a text are put in order in place.
        """
        n = np.diff(bounds)
        full = n > 0
        back = np.diff(np.append(0, np.cumsum(self.fallback[tokens]))[bounds])
        for a, z in pairwise(bounds.tolist()):
            tokens[a:z].sort()
        first = np.append(tokens[:1] >= 0, tokens[1:] != tokens[:-1])
        first[bounds[:-1][full]] = True
        runs = np.flatnonzero(first)
        each = np.diff(np.append(runs, len(tokens)))
        of = np.searchsorted(runs, bounds)
        some = each / np.repeat(n, np.diff(of))
        entropy = full.astype(float)
        if full.any():
            entropy[full] = -np.add.reduceat(some * np.log2(some), of[:-1][full])
        most = np.maximum(n, 1)
        top = np.log2(np.minimum(most, self.size))
        entropy = np.where(top > 0, entropy / np.where(top > 0, top, 1), full)
        return [x.tolist() for x in (np.where(full, chars / most, 0.0), back / most, entropy, n)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Table:
    """Token ids of words under several vocabularies; about CACHE_BYTES of the words used last are remembered, long ones only while there is room.

    Words are encoded once for many texts: most are in several texts, and calls word by word take longer than the encoding.
    """

    def __init__(self, paths: tuple[str, ...]):
        self.vocabularies = [vocabulary(path) for path in paths]
        self.words = pa.array([], pa.large_string())
        self.ids = [np.empty(0, np.int32) for _ in paths]
        self.lengths = [np.empty(0, np.int32) for _ in paths]
        self.used = np.empty(0, np.int64)
        self.now = 0

    def bytes(self) -> int:
        return self.words.nbytes + sum(x.nbytes for x in (*self.ids, *self.lengths, self.used))

    def rows(self, words: pa.Array) -> np.ndarray:
        """Where distinct words lie in the table, which takes up the new ones; rows change with the next call."""
        if self.bytes() > CACHE_BYTES:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        new, rows = at.is_null().to_numpy(zero_copy_only=False), at.fill_null(-1).to_numpy().astype(np.int64)
        rows[new] = len(self.words) + np.arange(new.sum())
        added = words.filter(pa.array(new))
        self.words = pa.concat_arrays([self.words, added])
        step = max(1, min(CALL_WORDS, len(added) * CALL_BYTES // max(1, added.nbytes)))
        for i, v in enumerate(self.vocabularies):
            ids, lengths = [self.ids[i]], [self.lengths[i]]
            for k in range(0, len(added), step):
                some = v.encode(added.slice(k, step).to_pylist())
                lengths.append(np.fromiter(map(len, some), np.int32, len(some)))
                ids.append(np.fromiter(chain.from_iterable(some), np.int32, lengths[-1].sum(dtype=np.int64)))
            self.ids[i], self.lengths[i] = np.concatenate(ids), np.concatenate(lengths)
        self.now += 1
        self.used = np.append(self.used, np.zeros(len(added), np.int64))
        self.used[rows] = self.now
        return rows

    def forget(self) -> None:
        """Keep the half of the words that was used last, without long ones."""
        kept = np.zeros(len(self.used), bool)
        kept[np.argsort(self.used, kind="stable")[len(kept) // 2 :]] = True
        kept &= pc.binary_length(self.words).to_numpy() <= LONG
        for i, lengths in enumerate(self.lengths):
            self.ids[i], self.lengths[i] = self.ids[i][np.repeat(kept, lengths)], lengths[kept]
        self.words, self.used = self.words.filter(pa.array(kept)), self.used[kept]

    def measures(self, rows: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> list[list]:
        """The measures of texts under each vocabulary, from the rows of their words one after the other and where each text begins."""
        out = []
        for v, ids, lengths in zip(self.vocabularies, self.ids, self.lengths):
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            each = lengths[rows]
            before = np.append(0, np.cumsum(each, dtype=np.int64))
            at = np.repeat(starts[rows] - before[:-1], each)
            at += np.arange(len(at))
            out += v.measure(ids[at], before[offsets], chars)
        return out


@lru_cache(maxsize=2)
def table(paths: tuple[str, ...]) -> Table:
    return Table(paths)


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word of all texts one after the other, and where each text begins, with the end."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words, offsets = split.values, split.offsets.to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves empty strings
    coded = words.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.append(0, np.cumsum(some))[offsets]


def script(text: str) -> str:
    """The script that most letters belong to, by the first word of their Unicode names; '' without letters."""
    kinds = set(text)
    if max(kinds, default="") < "ɐ":
        return "LATIN" if any(map(str.isalpha, kinds)) else ""
    found: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]] += n
    return min(found, key=lambda k: (-found[k], k)) if found else ""


def numbered(words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and the number of each word among them."""
    return np.unique(words, return_inverse=True)


def repeated_words(codes: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows of that many words that the text holds twice or more, the first ones included; words by their numbers."""
    n = len(codes) - window + 1
    if n < 2 or distinct == len(codes):
        return 0
    keys = codes[:n]
    bound = distinct
    for i in range(1, window):
        if bound * distinct >= 1 << 62:  # pack anew: as many keys as windows
            keys = np.unique(keys, return_inverse=True)[1]
            bound = n
        keys = keys * distinct + codes[i : n + i]
        bound *= distinct
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(codes) + 1, np.int64)
    cover[twice] += 1
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeats(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> list[int]:
    """repeated_words of each text; only texts in which windows share a hash are looked into."""
    if len(codes) < window:
        return [0] * (len(offsets) - 1)
    n = len(codes) - window + 1
    hashes = np.zeros(n, np.uint64)
    for i in range(window):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX + codes[i : n + i].astype(np.uint64)
    out = []
    for a, z in pairwise(offsets.tolist()):
        own = np.sort(hashes[a : max(a, z - window + 1)])
        if (own[1:] == own[:-1]).any():
            distinct, local = numbered(codes[a:z])
            out.append(repeated_words(local, len(distinct), window))
        else:
            out.append(0)
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(_WHITE):
            seen.add(line)
    return again


def _named(i: int) -> list[str]:
    """The columns of the measures under the vocabulary with that number."""
    return [m if i == 0 else f"{m}_{i + 1}" for m in (*MEASURES, "n_tokens")]


def measures(docs: DataFrame, paths: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base counts and measures of each row's whole text; those of vocabularies after the first have its number in their names."""

    def run(keys, texts):
        texts = [t or "" for t in texts]
        words, codes, offsets = words_of(texts)
        known = table(tuple(paths))
        chars = [len(t) - sum(map(t.count, _WHITE)) for t in texts]
        rows = known.rows(words)[codes]
        measured = known.measures(rows, offsets, np.array(chars, np.int64))
        repeated = repeats(codes, offsets)
        for k, t, n, c, r, *of in zip(keys, texts, np.diff(offsets).tolist(), chars, repeated, *measured):
            failed = n < MIN_WORDS or 100 * r > MAX_REPEATED * n
            yield (k, n, c, sum(map(t.count, _SYMBOLS)), repeated_lines(t), r, failed, script(t), *of)

    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"{m} {'long' if m.startswith('n_') else 'double'}" for i in range(len(paths)) for m in _named(i))
    return rows_operator(
        docs, [key, text], run,
        f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, {columns}",
    )


def size_class(tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def bands(rows: DataFrame, vocabularies: int = 1) -> DataFrame:
    """_script ('*' for all together), _size, and _<column>: the bound of each measure; one row per script and size class of LEAST documents or more.

    Medians and quartiles are exact on a grid: documents are counted by script,
    class, measure and grid cell before they are ordered.
    """
    grids = {name: of for i in range(vocabularies) for name, of in zip(_named(i), MEASURES.values())}
    cells = F.array(*[F.named_struct(F.lit("m"), F.lit(m), F.lit("cell"), F.round(F.col(m) * grid).cast("long")) for m, (*_, grid) in grids.items()])
    passed = rows.where("not base_failed").select(F.explode(F.array("script", F.lit("*"))).alias("_script"), size_class(F.col("n_tokens")).alias("_size"), cells.alias("c"))
    counted = passed.select("_script", "_size", F.explode("c").alias("c")).groupBy("_script", "_size", "c.m", "c.cell").agg(F.count("*").alias("n"))
    group = W.partitionBy("_script", "_size", "m")
    summed = counted.withColumn("sum", F.sum("n").over(group.orderBy("cell"))).withColumn("all", F.sum("n").over(group))
    quartile = [F.min(F.when(F.col("sum") >= q * F.col("all"), F.col("cell"))) for q in (0.25, 0.5, 0.75)]
    found = summed.where(F.col("all") >= LEAST).groupBy("_script", "_size", "m").agg(F.array(*quartile).alias("q"))
    bounds = []
    for m, (side, width, least, grid) in grids.items():
        q = F.max(F.when(F.col("m") == m, F.col("q")))
        bounds.append((q[1] / grid + side * F.greatest(F.lit(least), width * (q[2] / grid - q[0] / grid))).alias(f"_{m}"))
    return found.groupBy("_script", "_size").agg(*bounds)


def within(rows: DataFrame, table: DataFrame, vocabularies: int = 1) -> DataFrame:
    """rows with in_bands; the bounds that are broadcast number at most the scripts times the size classes."""
    names = [n for i in range(vocabularies) for n in _named(i)[:-1]]
    all_ = table.where("_script = '*'").drop("_script").select(F.col("_size").alias("_any"), *[F.col(f"_{m}").alias(f"_any_{m}") for m in names])
    joined = rows.withColumn("_class", size_class(F.col("n_tokens")))
    joined = joined.join(F.broadcast(table.where("_script <> '*'")), (F.col("script") == F.col("_script")) & (F.col("_class") == F.col("_size")), "left")
    joined = joined.join(F.broadcast(all_), F.col("_class") == F.col("_any"), "left")

    def out(m: str, side: int) -> Column:
        bound = F.coalesce(f"_{m}", f"_any_{m}")
        return F.coalesce(F.col(m) > bound if side > 0 else F.col(m) < bound, F.lit(False))

    rejected = [reduce(Column.__and__, [out(_named(i)[j], of[0]) for i in range(vocabularies)]) for j, of in enumerate(MEASURES.values())]
    return joined.select(*rows.columns, (~reduce(Column.__or__, rejected)).alias("in_bands"))


def judge(docs: DataFrame, *paths: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """measures() with kept: neither a base rule nor the bands of the row's script and size class reject it."""
    at = shared_dir(docs.sparkSession)
    rows = cut(measures(docs, list(paths), key, text), f"{at}/measures")
    table = cut(bands(rows, len(paths)), f"{at}/bands")
    return within(rows, table, len(paths)).withColumn("kept", ~F.col("base_failed") & F.col("in_bands")).drop("in_bands")
