"""Ranked search: scored symbols, BM25 full text, vector neighbours and reciprocal-rank fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CodeGraph

# Words that a query leaves out, and weights.
STOP_WORDS = frozenset((
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "is", "it", "by", "as", "or", "and", "but", "not", "with", "from", "into", "that", "this", "be", "do", "has",
    "have", "had", "was", "are", "can", "will", "should", "would", "could", "my", "its", "their", "our", "your", "all", "add", "fix", "get", "set", "new", "use", "make",
    "find", "show", "update", "change", "create", "delete", "remove", "support", "implement", "merge", "pull", "request", "pr", "via", "branch", "commit",
))
K1, B, RRF = 1.2, 0.75, 60


def query_tokens(query: str) -> list[str]:
    """Identifier-like tokens of a query, with the parts of CamelCase words."""
    parts = re.split(r"[\s/\-#@]+", query)
    camel = [s.lower() for p in parts if re.search("[a-z][A-Z]", p) for s in re.sub("([a-z])([A-Z])", r"\1 \2", p).split()]
    every = list(dict.fromkeys([p.lower() for p in parts] + camel))
    return [t for t in every if t not in STOP_WORDS and len(t) > 1 and re.match("^[a-z][a-z0-9_]*$", t)] or [t for t in query.lower().split() if len(t) > 1]


def search(g: CodeGraph, query: str, hot: DataFrame | None = None) -> DataFrame:
    """Symbols by score: name, qualified name, signature, doc and path matches, then structural bonuses.

    The tokens' document frequencies are one aggregate, which is joined back as a single row.
    """
    tokens = query_tokens(query)
    low = query.lower()
    rows = g.symbols.withColumns({f"_{c}": F.lower(c) for c in ("name", "qualified_name", "signature", "doc", "file_path")})
    if len(tokens) > 1:
        shares = rows.agg(*[(F.count_if(F.col("_name").contains(t)) / F.count("*")).alias(f"_f{i}") for i, t in enumerate(tokens)])
        rows = rows.join(F.broadcast(shares))  # one row
    score, matched = F.lit(0.0), F.lit(0)
    if re.match("^[a-z][a-z0-9]*$", low):
        same = F.translate("_name", "_-", "") == low
        score, matched = score + F.when(same, 15.0).otherwise(0.0), matched + same.cast("int")
    for i, t in enumerate(tokens):
        weight: Column = F.lit(min(len(t) / 3, 2.0))
        if len(tokens) > 1:
            weight = weight * F.when(F.col(f"_f{i}") > 0.15, 0.3).when(F.col(f"_f{i}") > 0.05, 0.6).otherwise(1.0)
        counted = [(F.col("_name") == t, 10.0), *[(F.col(c).contains(t), w) for c, w in (("_qualified_name", 5.0), ("_signature", 3.0), ("_doc", 1.0))]]
        points, hit = F.when(counted[0][0], 10.0), counted[0][0]
        for test, w in counted[1:]:
            points, hit = points.when(test, w), hit | test
        score = score + points.when(F.col("_file_path").contains(t), 0.3).otherwise(0.0) * weight
        matched = matched + hit.cast("int")
    rows = rows.select("id", "kind", "file_path", "line_start", "exported", score.alias("base"), matched.alias("matched")).where("base > 0")
    cross = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("cross_callers"))
    rows = rows.join(cross, "id", "left").na.fill(0, ["cross_callers"])
    total = F.col("base") + bonus()
    if len(tokens) > 1:
        total = total + F.when(F.col("matched") > 1, F.col("matched") * 4.0).otherwise(0.0)
    if hot is not None:
        rows = rows.join(hot.select(F.col("path").alias("file_path"), F.lit(0.3).alias("_hot")).distinct(), "file_path", "left").na.fill(0.0, ["_hot"])
        total = total + F.col("_hot")
    return rows.select("id", "kind", "file_path", "line_start", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "file_path", "line_start", "id")


def bonus() -> Column:
    """Points for exported, called and prominent symbols."""
    kind = F.when(F.col("kind").isin("component", "hook"), 1.5).when(F.col("kind") == "class", 1.0).otherwise(0.0)
    return F.when(F.col("exported"), 2.0).otherwise(0.0) + F.least(F.col("cross_callers"), F.lit(5)) * 0.5 + kind


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", n: int | None = 20) -> DataFrame:
    """Documents by BM25 of a query's terms: key, score.

    Only the query's terms are counted in each document, so no inverted index
    of all words is shuffled; frequencies and lengths are one aggregate.
    """
    terms = sorted(set(re.findall(r"\w+", query.lower())))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    rows = docs.select(F.col(key), words.alias("w")).select(key, F.size("w").alias("len"), *[_count("w", t).alias(f"_t{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    out = rows.join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key)  # stats is one row
    return out.limit(n) if n else out


def nearest(vectors: DataFrame, query: list[float], n: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The n vectors nearest to a query by Euclidean distance; each task keeps its own n."""
    given = F.array(*[F.lit(float(x)) for x in query])
    squares = F.aggregate(F.zip_with(column, given, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, F.round(F.sqrt(squares), 6).alias("distance")).orderBy("distance", key).limit(n)


def fuse(left: DataFrame, right: DataFrame, key: str, by_left: list, by_right: list, n: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists of bounded length."""
    a = left.select(key, F.row_number().over(W.orderBy(*by_left)).alias("ra"))
    b = right.select(key, F.row_number().over(W.orderBy(*by_right)).alias("rb"))
    score = F.coalesce(1 / (RRF + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("rb")), F.lit(0.0))
    return a.join(b, key, "full").select(key, F.round(score, 9).alias("score")).orderBy(F.desc("score"), key).limit(n)
