"""Byte-level BPE encoding and decoding with a vocabulary file of the tokenizers library.

Encoding keeps a priority queue of merge ranks over a doubly linked symbol
list and skips queue entries that a later merge has made stale.  Decoding
concatenates vocabulary strings and maps their characters back to bytes.

Defined results: a null text counts as empty, and an empty text has no tokens.
Rows are independent, so repeated rows and ties of ids give repeated results.
Only the key and text columns are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, rows_operator

# Fixed value: the public pre-tokeniser pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of encoded pre-tokens that a Python worker remembers, about.
CACHE_BYTES = 96 << 20


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class BPE:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        #: Ids to the left, to the right and after a merge, by rank; ids of single bytes.
        self.left, self.right, self.merged = ([ids[x] for x in column] for column in zip(*((a, b, a + b) for a, b in merges)))
        to_char = byte_characters()
        self.byte_ids = [ids[to_char[b]] for b in range(256)]
        #: left id * width + right id -> rank
        self.width = 1 + max(ids.values())
        self.ranks = {a * self.width + b: rank for rank, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        back = {c: b for b, c in to_char.items()}
        self.bytes = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for i, s in strings.items()}
        self.decimals = {i: str(i) for i in strings}
        self.pre = regex.compile(PATTERN, regex.V0)
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces = Memo(lambda piece: array("i", self.merge(piece.encode())).tobytes(), CACHE_BYTES)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token: a queue of ranks over a doubly linked list of symbols.

        An entry of the queue is one number, the rank before the position, so
        that the least rank comes first and of equal ranks the leftmost.
        """
        symbols = list(map(self.byte_ids.__getitem__, data))
        n = len(symbols)
        rank_of, width, lefts, rights, merged = self.ranks.get, self.width, self.left, self.right, self.merged
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = [r << shift | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a * width + b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> shift, entry & mask
            j = after[i]
            if symbols[i] != lefts[rank] or j == n or symbols[j] != rights[rank]:
                continue  # stale: one of the two symbols has been merged since
            symbols[i] = new = merged[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new * width + symbols[k])) is not None:
                    heappush(queue, r << shift | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] * width + new)) is not None:
                heappush(queue, r << shift | h)
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> list[int]:
        """The ids of a text, added tokens apart."""
        return array("i", b"".join(map(self.pieces.__getitem__, self.pre.findall(text)))).tolist()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; strings of added tokens become those tokens."""
        text = text or ""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return [i for part in self.split.split(text) for i in ([self.special[part]] if part in self.special else self._plain(part))]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: vocabulary strings are concatenated, then read as UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def written(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> BPE:
    """One instance for each file and worker process."""
    return BPE(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with an array of token ids added in column out."""
    from pyspark.sql.functions import pandas_udf

    from .common import ensure_importable

    ensure_importable(docs.sparkSession)

    @pandas_udf("array<int>")
    def ids(texts):
        return texts.map(lambda t: load(vocabulary).encode(t if isinstance(t, str) else ""))

    return docs.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_tokens, ids_sha256 and decoded_sha256."""

    def run(keys, texts):
        bpe = load(vocabulary)
        for k, t in zip(keys, texts):
            ids = bpe.encode(t)
            yield k, len(ids), hashlib.sha256(bpe.written(ids).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    kind = docs.schema[key].dataType.simpleString()
    return rows_operator(docs, [key, text], run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
