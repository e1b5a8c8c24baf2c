"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words.  A document is taken a whole number
of times, floor(target / source size), and once more with the fractional rest as
its inclusion probability.  The cube method moves these probabilities through
the null space of the constraints (document total and word total) until at most
as many as there are constraints stay fractional; groups of at most about GROUP
rows of a source fly on their own, what they leave undecided flies again
together.  Rows with more than LARGE of their source's words are settled first,
each along a direction that spreads its counter-move over all other open rows of
its group (a row that outweighs what the others could give or take goes the only
way there is); of the others three fly at a time.  The last few rows of a source
(with LANDING of its smaller ones of all sizes, kept back for this from its first
flight on) land on one of the choices that miss the source's words by NEAR of
them at most (else on the nearest), drawn by how likely their probabilities make
it.  Each source lands when it is down to one group, whatever the others do.

Defined results: a null text has size 0; null sources are one source, the last.
A source of size 0 has target 0 and its rows are taken no times.  Rows that agree
in id, source and text are alike: they are counted as one group and then told
apart by a number, and randomness is a hash of SEED, id, text and that number.
So reruns agree, null ids included, and a group of any size is dealt to many
tasks; which of several alike rows are taken is open.  Only the id, text and
source columns decide.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, ensure_importable, fresh, join_groups, shared_dir

# Fixed values of the mix: weights by the sources' order, words to take as a share of all, the most copies of a source.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SEED, GROUP, LANDING = 20240607, 4000, 14
#: Share of a source's words from which a row is large, and share of its target that a landing may miss.
LARGE, NEAR = 0.03, 0.002
#: Share of what the other units could give or take that a large unit may use.
ROOM = 0.9
#: Alike rows that one task tells apart at once.
BLOCK = 4096
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _ranked(rows: DataFrame, order: Column, name: str, path: str) -> DataFrame:
    """rows with their number, from 0, in a total order: sorted by range, numbered within each partition, and moved by the rows before it."""
    sorted_ = cut(rows.orderBy(order).withColumn(name, F.monotonically_increasing_id()), path)
    part = F.shiftright(name, 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = sorted_.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return moved.withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame, path: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, one row per source) with target.

    Sources share by weight, those above cap * size stop there and the excess is
    shared anew, until none is above.  Each round sums over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = cut(_ranked(sizes, F.col("source").asc_nulls_last(), "_n", f"{path}/sorted").withColumn("_w", weight), f"{path}/ranked")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, most = 0.0, -1
    while True:
        full = (F.col("_w") * level >= cap * F.col("source_size")) if most >= 0 else F.lit(False)
        number, stopped, open_weight = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_w")))).first()
        if number == most or not open_weight:
            break
        level, most = (total - cap * (stopped or 0)) / open_weight, number
    target = F.least(F.col("_w") * level, cap * F.col("source_size")) if open_weight else cap * F.col("source_size")
    return rows.withColumn("target", target).drop("_n", "_w")


def flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Inclusion probabilities moved through the null space of [sum of p, sum of p * x] until at most two are fractional.

    u: one uniform number in [0, 1) per unit, for the steps' directions.
    """
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    u = u.tolist()
    waiting = [i for i in range(len(p) - 1, -1, -1) if _EPS < p[i] < 1 - _EPS]
    live: list[int] = []
    while True:
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) < 3:
            return np.clip(np.round(p, 12), 0, 1)
        a, b, c = live
        # a vector orthogonal to (1, 1, 1) and to the sizes; units of equal size leave more than one, of which it is the first
        v = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / s if s > 0 else -p[i] / s for i, s in zip(live, v) if s)
        down = min(p[i] / s if s > 0 else (p[i] - 1) / s for i, s in zip(live, v) if s)
        step = up if u[a] * (up + down) < down else -down
        u[a] = u[a] * 7919.0 % 1.0
        for i, s in zip(live, v):
            p[i] += step * s
        live = [i for i in live if _EPS < p[i] < 1 - _EPS]


def settle(p: np.ndarray, x: np.ndarray, u: np.ndarray, large: np.ndarray) -> np.ndarray:
    """p with the large units made whole, the largest first.

    The other open units take the counter-move in shares a + b * size, by which
    both totals stay, if that settles the unit in one step whichever way it goes.
    Else, as a large unit stands for many documents, they take it evenly, by which
    the words stay.  A unit whose counter-move the others can't make isn't moved
    that way.
    """
    p = p.astype(float).copy()
    for i in large[np.argsort(-x[large], kind="stable")]:
        draw = u[i]
        while _EPS < p[i] < 1 - _EPS:
            open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS) & (x > 0))
            open_ = open_[open_ != i]
            q, y = p[open_], x[open_]
            can = (1 - p[i]) * x[i] <= ROOM * (q @ y), p[i] * x[i] <= ROOM * ((1 - q) @ y)
            if not len(y) or not any(can):
                break
            about = y - y.mean()
            spread = float(about @ about)
            ways = [(1.0 / len(y) + (x[i] - y.mean()) / spread * about)] if spread > _EPS else []
            for share in (*ways, np.full(len(y), x[i] / y.sum())):
                # how far the unit can go up and down before another one is whole
                rate = np.maximum(np.abs(share), 1e-15)
                up = min(1 - p[i], (np.where(share > 0, q, 1 - q) / rate).min())
                down = min(p[i], (np.where(share > 0, 1 - q, q) / rate).min())
                if up >= 1 - p[i] - _EPS and down >= p[i] - _EPS:
                    break
            step = up if not can[1] or can[0] and draw * (up + down) < down else -down
            p[i] += step
            p[open_] = q - step * share
            p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
            draw = draw * 7919.0 % 1.0
    return p


def landing(p: np.ndarray, x: np.ndarray, near: float = 0.0, draw: float = 0.5) -> np.ndarray:
    """0 or 1 for each of a few fractional units.

    Of all choices that miss the expected words by near at most, one by its
    likelihood; if there is none, that with the words nearest to expectation, then
    the documents.
    """
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    out = np.round(p)
    if len(left):
        choices = np.array(list(product((0, 1), repeat=len(left))), float)
        off = np.abs((choices - p[left]) @ np.stack([x[left], np.ones(len(left))], axis=1))
        some = np.flatnonzero(off[:, 0] <= near)
        if len(some):
            likely = np.cumsum(np.where(choices[some] > 0, p[left], 1 - p[left]).prod(axis=1))
            best = some[min(np.searchsorted(likely, draw * likely[-1], side="right"), len(some) - 1)]
        else:
            best = np.lexsort((off[:, 1], off[:, 0]))[0]
        out[left] = choices[best]
    return out


def group(p: np.ndarray, x: np.ndarray, u: np.ndarray, kept: np.ndarray, size: float, near: float, keeps: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after the flight of one group of a source of size words, and which of its units are kept for the landing; last: the units land, missing near words at most."""
    kept = kept.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if keeps and not kept.any():
        small = left[x[left] <= LARGE * size]
        small = small[np.argsort(x[small], kind="stable")]
        # a group of few units lands as it is
        kept[small[np.unique(np.linspace(0, len(small) - 1, LANDING).astype(int))] if len(small) > LANDING else left if len(left) <= LANDING + 2 else small] = True
    own, flies = p.copy(), ~kept
    own[flies] = settle(p[flies], x[flies], u[flies], np.flatnonzero(x[flies] > LARGE * size))
    own[flies] = flight(own[flies], x[flies], u[flies])
    return (landing(own, x, near, float(u[0])) if last else own), kept


def _group(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_u", "size"], kind="stable").reset_index(drop=True)
        last = bool(rows["_last"].iloc[0])
        # one group of a source keeps units for the landing
        keeps = last or level == 0 and rows["_g"].iloc[0] == 0
        p, x, u = (rows[c].to_numpy(float) for c in ("_p", "size", "_u"))
        p, kept = group(p, x, u, rows["_kept"].to_numpy(bool), float(rows["source_size"].iloc[0]), NEAR * float(rows["target"].iloc[0]), keeps, last)
        return rows.assign(_p=p, _kept=kept)

    return run


def _units(alike: DataFrame) -> DataFrame:
    """A row for each of the _n rows of a group, told apart by _i; large groups are dealt out in blocks first."""
    small, large = alike.where(F.col("_n") <= BLOCK), alike.where(F.col("_n") > BLOCK)
    blocks = large.withColumn("_b", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {BLOCK}")))).repartition("_key", "_sum", "_b")
    last = F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK) - 1
    dealt = blocks.withColumn("_i", F.explode(F.sequence(F.col("_b") * BLOCK, last))).drop("_b")
    return small.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).unionByName(dealt)


def _mixed(docs: DataFrame, key: str, text: str, source: str, weights, share: float, cap: float, at: str) -> DataFrame:
    """One row per row of docs: _key, _sum (hash of the text), source, size, source_size, target and copies."""
    ensure_importable(docs.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    read = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), name.alias("_name"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_sum"), words(F.col(text)).alias("size"))
    alike = cut(read.groupBy("_key", "_sum", "source", "_name", "size").agg(F.count("*").alias("_n")), f"{at}/alike")
    totals = cut(alike.groupBy("_name", "source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("_docs")), f"{at}/totals")
    goals = cut(targets(totals, at, weights, share, cap).drop("source"), f"{at}/goals")
    sums = totals.agg(F.max("_docs"), F.sum("_docs")).first()
    state = join_groups(_units(alike), goals, "_name", "_docs", sums[1] or 0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = state.withColumn("_whole", F.floor(ratio + _EPS)).withColumn("_p", F.greatest(F.lit(0.0), ratio - F.col("_whole")))
    state = state.withColumn("_u", F.pmod(F.xxhash64("_key", "_sum", "_i", F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)).drop("_name", "_n", "_i").withColumn("_kept", F.lit(False))
    names, done, level, most = state.columns, None, 0, sums[0] or 0
    fractional = (F.col("_p") > _EPS) & (F.col("_p") < 1 - _EPS)
    while True:
        # each source is dealt to groups of about GROUP rows; a flight leaves two of a group at most, and those kept back
        groups = F.ceil(F.col("_docs") / GROUP)
        dealt = state.withColumn("_g", F.pmod(F.xxhash64("_u", F.lit(level)), groups)).withColumn("_last", groups == 1).withColumn("_docs", 2 * groups + LANDING)
        flown = dealt.groupBy("source", "_g").applyInPandas(_group(level), dealt.schema)
        flown = cut(flown.select(*names), f"{at}/flight{level}")
        if most <= GROUP:
            done = flown if done is None else done.unionByName(flown)
            break
        settled = flown.where(~fractional)
        done = settled if done is None else done.unionByName(settled)
        state, most, level = flown.where(fractional), 2 * -(-most // GROUP) + LANDING, level + 1
    return done.withColumn("copies", (F.col("_whole") + F.round("_p")).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, copies and taken (copies * size)."""
    made = _mixed(docs, key, text, source, weights, share, cap, shared_dir(docs.sparkSession))
    return made.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with each row as many times as the mix takes it; alike rows share what it takes of them as evenly as can be."""
    at = shared_dir(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in docs.columns]
    alike, n, copies, row = (fresh(docs, x) for x in ("_alike", "_alike_n", "_alike_copies", "_alike_row"))
    made = _mixed(docs, key, text, source, weights, share, cap, at)
    per = made.groupBy(F.struct("_key", "source", "_sum").alias(alike)).agg(F.count("*").alias(n), F.sum("copies").alias(copies))
    per = cut(per, f"{at}/copies")
    same = F.struct(F.col(key).alias("_key"), F.col(source).alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_sum"))
    rows = join_groups(docs.withColumn(alike, same), per.where(F.col(copies) > 0), alike, n, per.agg(F.sum(n)).first()[0] or 0).where(F.col(n) >= 1)
    times = lambda number: F.explode(F.sequence(F.lit(1).cast("long"), number)).alias(row)
    single = rows.where(F.col(n) == 1).select(*own, times(F.col(copies))).drop(row)
    if per.where(F.col(n) > 1).isEmpty():
        return single
    # alike rows are numbered within the partitions that they were written in, and moved by the rows of partitions before
    several = cut(rows.where(F.col(n) > 1).withColumn(row, F.monotonically_increasing_id()), f"{at}/several")
    part = fresh(several, "_alike_part")
    several = several.withColumn(part, F.shiftright(row, 33))
    counts = several.groupBy(alike, part).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(alike).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = several.select(alike, part, row, (F.row_number().over(W.partitionBy(alike, part).orderBy(row)) - 1).alias("i"))
    place = place.join(counts.select(alike, part, before.alias("before")), [alike, part]).select(row, (F.col("i") + F.col("before")).alias(alike))
    told = several.drop(alike, part).join(place, row)
    number = F.expr(f"`{copies}` div `{n}`") + F.when(F.col(alike) < F.col(copies) % F.col(n), 1).otherwise(0)
    return single.unionByName(told.withColumn(copies, number).where(F.col(copies) > 0).select(*own, times(F.col(copies)).alias(part)).drop(part))
