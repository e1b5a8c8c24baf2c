"""Symbol embeddings with an encoder that the caller gives; the default hashes words, as no model is part of this repository."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..model import CodeGraph
from ..session import ship

SIZE = 64


def hashed(texts: list[str], size: int = SIZE) -> list[list[float]]:
    """Unit vectors of signed word counts: texts that share words are near each other."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().replace("_", " ").split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def embed(g: CodeGraph, known: DataFrame | None = None, encode: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """symbol_id, embedding of the symbols that known (symbol_id) doesn't hold yet, in Arrow batches."""
    ship(g.symbols.sparkSession)
    text = F.concat_ws(" | ", F.concat_ws(" ", "kind", "qualified_name"), F.nullif("signature", F.lit("")), F.nullif("doc", F.lit("")), F.concat(F.lit("in "), F.col("file_path")))
    rows = g.symbols.select(F.col("id").alias("symbol_id"), text.alias("text"))
    if known is not None:
        rows = rows.join(known.select("symbol_id"), "symbol_id", "left_anti")

    @pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series(encode(texts.tolist()), index=texts.index)

    return rows.select("symbol_id", run("text").alias("embedding"))
