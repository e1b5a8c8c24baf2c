"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, in a bounded sample of labelled rows, the documents of either
class that hold a word or one of its prefixes.  A token's log-odds come from a
chain of Dirichlet priors: a word's class shares are smoothed by those of its
longest prefix, that one's by the next shorter, and the shortest by the whole
sample's.  Tokens score their log-odds, positive or negative, less DRIFT, so that
clean text drifts down.  A linear scan (Ruzzo and Tompa) finds all maximal scoring segments.
Segment scores follow an extreme-value law on clean text, P(S >= x) = 1 -
exp(-K n exp(-lambda x)), whose lambda and K are fitted on clean rows; the
significant segments' evidence, in nats, is summed, and a logistic curve fitted
on a calibration fold turns it into a score.

Defined results: null, empty and letterless texts have no segment and score as
documents without evidence do; without any toxic training row all texts score
0.  Repeated rows are scored alike.  Labels that are null or not 0 or 1, and
labels of ids without a document, are left out of training; of several labels
of one id the largest counts.  Scores use texts only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, ensure_importable, held_out, rows_operator, shared_dir

#: Labelled rows that training takes at most, by hash order of their ids; what comes to the driver are features of these.
MAX_ROWS = 20_000
#: Bytes of tokens' scores that a worker remembers, about, and cells of a nat of the calibration's scores.
CACHE_BYTES, GRID = 48 << 20, 1000
#: A feature leans to toxic when its share of toxic documents is at least so many times the sample's; it leans away when that of so many documents is so many nats below.
LEAN, AWAY = 1.5, (10, 0.5)
PREFIXES, STRENGTH, DRIFT, FLOOR = (3, 4, 5, 6), 5.0, 0.6, -3.0
#: A segment is significant when its chance in clean text of the same length is at most this.
P_VALUE = 0.05
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The chain of a lower-cased word: its prefixes from short to long, each marked by *, then the word."""
    return [word[:n] + "*" for n in PREFIXES if len(word) >= n] + [word]


@dataclass
class Model:
    """Log-odds of features where they differ from what the chain above them says, and the calibration."""

    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (-50.0, 0.0)

    def token(self, raw: bytes) -> float:
        """The score of a white-space token: the most that a word in it has, above or below 0; tokens without words are neutral."""
        found = []
        for word in _LETTERS.findall(raw.decode("utf-8", "replace").lower()):
            odds = 0.0
            for f in features(word):
                odds = self.odds.get(f, odds)
            found.append(odds)
        return max(FLOOR, max(found, default=0.0)) - DRIFT

    def __post_init__(self):
        self.memo = Memo(self.token, CACHE_BYTES)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """The maximal scoring segments (first token, end, score) of a text, and its number of tokens."""
        raw = (text or "").encode().split()
        scores = np.fromiter(map(self.memo.__getitem__, raw), np.float64, len(raw))
        return maximal_segments(scores), len(raw)

    def significant(self, text: str | None) -> tuple[list[tuple[int, int, float]], float]:
        """The significant segments of a text, and their evidence in nats."""
        found, n = self.segments(text)
        if not found:
            return [], 0.0
        expected, least = self.log_k + math.log(n), -math.log(-math.log1p(-P_VALUE))
        found = [x for x in found if self.lam * x[2] - expected >= least]
        return found, sum(self.lam * s - expected for _, _, s in found)

    def judge(self, text: str | None) -> tuple[float, int]:
        """The score of a text and its number of significant segments."""
        found, evidence = self.significant(text)
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(evidence))))), len(found)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Character spans and scores of the significant segments."""
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        return [(spans[a][0], spans[z - 1][1], s) for a, z, s in self.significant(text)[0]]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time: (first, end, score), left to right.

    Segments begin and end at positive scores, so only these are visited;
    cumulative sums stand for what lies between.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    lows = (total[positive] - scores[positive]).tolist()
    highs = total[positive].tolist()
    # a stack of candidates, each with the nearest earlier one whose left sum is smaller
    stack: list[tuple[int, int, float, float, int]] = []
    for i, low, high in zip(positive.tolist(), lows, highs):
        first, end = i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, end, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, z, high - low) for a, z, low, high, _ in stack]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def chain_odds(counts: dict[str, tuple[int, int]], rows: tuple[int, int]) -> dict[str, float]:
    """Log-odds of each feature against the sample's, by the chain of priors; those that say nothing new are left out."""
    base = (rows[1] + 0.5) / (sum(rows) + 1.0)
    odds: dict[str, float] = {}

    def share(parent: float, f: str) -> float:
        clean, toxic = counts.get(f, (0, 0))
        return (toxic + STRENGTH * parent) / (clean + toxic + STRENGTH)

    shares: dict[str, float] = {}
    for f in sorted(counts, key=lambda f: (not f.endswith("*"), len(f))):
        word = f[:-1] if f.endswith("*") else f
        above = base
        for up in features(word):
            if up == f:
                break
            above = shares.get(up, above)
        shares[f] = share(above, f)
        if abs(_logit(shares[f]) - _logit(above)) > 0.02:
            odds[f] = _logit(shares[f]) - _logit(base)
        elif abs(_logit(above) - _logit(base)) > 0.02:
            odds[f] = _logit(above) - _logit(base)
    return odds


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """About rows labelled documents at most, outside the held-out fifth: _label, _fold, _text.

    At most rows ids of labels are taken and broadcast.  Where ids repeat among the
    documents, so that they bring more rows, these are drawn one by one, by a hash
    of id, text and their number.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    some = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))
    fold = (F.crc32(F.col("_id").cast("string").cast("binary")) % 5).cast("int")
    found = docs.select(F.col(key).alias("_k")).join(some, F.col("_k") == F.col("_id")).count()
    unit = F.pmod(F.xxhash64("_k", F.xxhash64("_text"), F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).withColumn("_unit", unit)
    return drawn.join(some, F.col("_k") == F.col("_id")).where(F.col("_unit") * found < rows).select("_label", fold.alias("_fold"), "_text")


def count_features(rows: DataFrame) -> DataFrame:
    """feature, _fold, clean, toxic: numbers of documents; each task sums its own rows first."""

    def run(labels, folds, texts):
        seen: dict[int, list[Counter]] = {}
        for y, fold, t in zip(labels, folds, texts):
            found = {f for raw in set((t or "").lower().split()) for w in _LETTERS.findall(raw) for f in features(w)}
            seen.setdefault(fold == 4, [Counter(), Counter()])[y].update(found)
        for fold, (clean, toxic) in seen.items():
            for f in clean.keys() | toxic.keys():
                yield f, fold, clean[f], toxic[f]

    parts = rows_operator(rows, ["_label", "_fold", "_text"], run, "feature string, calibrates boolean, clean long, toxic long")
    return parts.groupBy("feature").agg(
        *[F.sum(F.when(~F.col("calibrates"), F.col(c)).otherwise(0)).alias(f"{c}_fit") for c in ("clean", "toxic")], F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )


def leaning(table: DataFrame, base: float) -> DataFrame:
    """The features (feature, clean, toxic) that decide a score: those that lean to toxic, those below a prefix that does, which may take it back, and those that lean away.

    All others are as common among toxic documents as among all, and have log-odds near 0.
    """
    kept = table.where("clean + toxic >= 2").withColumn("leans", (F.col("toxic") >= 2) & (F.col("toxic") > LEAN * base * (F.col("clean") + F.col("toxic"))))
    own = kept.where("leans")
    word = F.regexp_replace("feature", r"\*$", "")
    ups = F.array(*[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES])
    prefixes = own.where("feature like '%*'").select(F.col("feature").alias("_up"))
    below = kept.where("not leans").withColumn("_up", F.explode(F.array_compact(ups))).join(prefixes, "_up", "left_semi").drop("_up").distinct()
    share = (F.col("toxic") + STRENGTH * base) / (F.col("clean") + F.col("toxic") + STRENGTH)
    away = kept.where("not leans").where((F.col("clean") + F.col("toxic") >= AWAY[0]) & (F.log(share / (1 - share)) < _logit(base) - AWAY[1]))
    return own.unionByName(below.unionByName(away).distinct()).drop("leans")


def _fitted(table: DataFrame, rows: tuple[int, int]) -> dict[str, float]:
    """Log-odds from counts (feature, clean, toxic) in so many clean and toxic rows."""
    found = leaning(table, rows[1] / sum(rows)).collect() if all(rows) else []
    return chain_odds({r["feature"]: (r["clean"], r["toxic"]) for r in found}, rows)


def _extreme_value(model: Model, maxima: list[tuple[float, int]], scores: np.ndarray, counts: np.ndarray) -> None:
    """lambda from the scores of clean tokens and their numbers (E exp(lambda s) = 1), K from the maxima of clean documents."""
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if np.average(np.exp(np.minimum(mid * scores, 50.0)), weights=counts) < 1:
            lo = mid
        else:
            hi = mid
    model.lam = lo if np.any(scores > 0) else 1.0
    if maxima:
        model.log_k = -math.log(max(1e-12, sum(n * math.exp(-model.lam * s) for s, n in maxima) / len(maxima)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a small ridge."""
    w = np.zeros(2)
    z = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0]), float(max(w[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on folds 1 to 3 and calibrate on fold 4 of the sample, which doesn't choose features for this; the final log-odds count all four."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    rows = cut(training_rows(docs, labels, key, text, label, max_rows), f"{at}/train")
    sizes = {}
    for r in rows.groupBy((F.col("_fold") == 4).alias("c"), "_label").count().collect():
        sizes[r["c"], r["_label"]] = r["count"]
    total = tuple(sizes.get((False, y), 0) + sizes.get((True, y), 0) for y in (0, 1))
    if not total[1]:
        return Model()
    counted = cut(count_features(rows), f"{at}/features")
    fit = Model(_fitted(counted.select("feature", F.col("clean_fit").alias("clean"), F.col("toxic_fit").alias("toxic")), tuple(sizes.get((False, y), 0) for y in (0, 1))))
    shared = spark.sparkContext.broadcast(fit)

    def best(labels_, texts):
        m = shared.value
        for y, t in zip(labels_, texts):
            raw = (t or "").encode().split()
            s = np.fromiter(map(m.memo.__getitem__, raw), np.float64, len(raw))
            found = [float(x) for _, _, x in maximal_segments(s)]
            cells, numbers = np.unique(np.rint(s * GRID).astype(np.int64), return_counts=True)
            yield y, len(raw), max(found, default=0.0), cells.tolist(), numbers.tolist(), found

    schema = "y int, n long, top double, cells array<long>, numbers array<long>, segments array<double>"
    made = cut(rows_operator(rows.where("_fold = 4"), ["_label", "_text"], best, schema), f"{at}/calibration")
    shared.destroy()
    clean = made.where("y = 0 and n > 0")
    cells = clean.select(F.explode(F.map_from_arrays("cells", "numbers"))).groupBy("key").agg(F.sum("value").alias("n")).collect()
    if cells:
        maxima = [(r["top"], r["n"]) for r in clean.select("top", "n").collect()]
        _extreme_value(fit, maxima, np.array([r["key"] / GRID for r in cells]), np.array([r["n"] for r in cells], float))
    evidence = F.aggregate(
        "segments", F.lit(0.0), lambda a, s: a + F.when((e := fit.lam * s - fit.log_k - F.log("n")) >= -math.log(-math.log1p(-P_VALUE)), e).otherwise(0.0)
    )
    told = made.select("y", evidence.alias("e")).collect()
    curve = _curve(np.log1p(np.array([r["e"] for r in told], float)), np.array([r["y"] for r in told], float)) if told else (-50.0, 0.0)
    return Model(_fitted(counted.select("feature", "clean", "toxic"), total), fit.lam, fit.log_k, curve)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted and n_passages for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys, outs, texts):
        m = shared.value
        for k, out, t in zip(keys, outs, texts):
            s, n = m.judge(t)
            yield k, out, s, int(s >= 0.5), n if s >= 0.5 else 0

    kind = docs.schema[key].dataType.simpleString()
    return rows_operator(docs, [key, held_out(key).alias("_out"), text], run, f"`{key}` {kind}, held_out boolean, score double, predicted int, n_passages int")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, in one pass over the texts."""
    from pyspark.sql.functions import arrow_udf

    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.judge(t.as_py())[0] < 0.5 for t in texts], pa.bool_())

    return docs.where(clean(F.coalesce(F.col(text), F.lit(""))))
