"""Usage logs: sessions, Markov transitions, reports and token budgets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

#: A session ends when the next event is more than so many seconds later.
GAP = 1200
# Least counts of the transitions that are kept.
BIGRAMS, TRIGRAMS = 5, 3


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def sessions(usage: DataFrame, by: str | None = None) -> DataFrame:
    """usage with session, a number per log; without by all events are one log.

    One log is one sequence.  Days are numbered apart first: within a day the
    gaps are found side by side, and only the first and last event of each day
    meet in one task, so a log of any length is spread over its days.
    """
    order = ["ts", "event_id"]
    keys = ([by] if by else []) + ["day"]
    rows = usage.withColumn("day", F.to_date("ts"))
    within = W.partitionBy(*keys).orderBy(*order)
    start = (_seconds(F.col("ts")) - _seconds(F.lag("ts").over(within)) > GAP).cast("int")
    rows = rows.withColumn("_start", start)
    days = rows.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.sum(F.coalesce("_start", F.lit(0))).alias("_inside"))
    over_days = W.partitionBy(*([by] if by else [])).orderBy("day")
    opens = F.coalesce((_seconds(F.col("_first")) - _seconds(F.lag("_last").over(over_days)) > GAP).cast("int"), F.lit(1))
    days = days.withColumn("_opens", opens)
    before = F.sum(F.col("_inside") + F.col("_opens")).over(over_days.rowsBetween(W.unboundedPreceding, -1))
    days = days.withColumn("_base", F.coalesce(before, F.lit(0)) + F.col("_opens"))
    out = rows.join(days.select(*keys, "_base"), keys)
    number = F.col("_base") + F.sum(F.coalesce("_start", F.lit(0))).over(within.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("session", number.cast("long")).drop("day", "_start", "_base")


def _stamps(batches):
    """session, hash: the first 8 digits of the MD5 of each session's times, joined by |; rows come in order, so one session's state is held at a time."""
    at, state = None, None

    def made(done):
        return pa.RecordBatch.from_pydict({"session": [x for x, _ in done], "hash": [h.hexdigest()[:8] for _, h in done]}, pa.schema([("session", pa.int64()), ("hash", pa.string())]))

    for batch in batches:
        sessions_, times = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(sessions_[1:] != sessions_[:-1]) + 1).tolist(), len(times)] if len(times) else []
        done = []
        for i, j in zip(cuts, cuts[1:]):
            text = "|".join(map(str, times[i:j].tolist()))
            if sessions_[i] == at:
                state.update(f"|{text}".encode())
                continue
            if state:
                done.append((at, state))
            at, state = int(sessions_[i]), hashlib.md5(text.encode())
        if done:
            yield made(done)
    if state:
        yield made([(at, state)])


def session_summary(usage: DataFrame) -> DataFrame:
    """Events, modes in order of first use, tokens, failures, success and a hash of the times of each session.

    Modes come from their first uses; times are sorted, on disk where they are many,
    and hashed as they come, so that no session is held whole.
    """
    rows = sessions(usage)
    sizes = rows.groupBy("session").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.count_if("empty").alias("empties"))
    first = rows.groupBy("session", "mode").agg(F.min(F.struct("ts", "event_id")).alias("_at")).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("_at", "mode"))).alias("_m"))
    ship(usage.sparkSession)
    # times alone are in order: equal ones look the same
    times = rows.where("ts is not null").select("session", F.unix_micros("ts").alias("_us")).repartition("session").sortWithinPartitions("session", "_us")
    hashes = times.mapInArrow(_stamps, "session long, hash string")
    modes = F.array_join(F.transform("_m", lambda x: x["mode"]), ",")
    return sizes.join(first, "session").join(hashes, "session", "left").select(
        "session", "events", "tokens", "empties", modes.alias("modes"), (F.col("empties") < 0.5 * F.col("events")).alias("success"), "hash"
    )


def _ordered(usage: DataFrame, steps: int) -> DataFrame:
    """mode and the modes of the next steps, in the log's order.

    The order is global; events are cut to days, and the last events of each
    day look at the first of the next by a join of day ends.
    """
    order = ["ts", "event_id"]
    rows = usage.select("ts", "event_id", "mode").withColumn("day", F.to_date("ts"))
    within = W.partitionBy("day").orderBy(*order)
    rows = rows.withColumns({f"m{i}": F.lead("mode", i).over(within) for i in range(1, steps + 1)}).withColumn("_left", F.count("*").over(W.partitionBy("day")) - F.row_number().over(within))
    heads = rows.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= steps).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("_r", "mode"))).alias("_h"))
    # the first events of all following days, as far as steps reaches: one short row a day
    following = W.orderBy("day").rowsBetween(1, steps)
    heads = heads.withColumn("_next", F.flatten(F.collect_list("_h").over(following))).select("day", "_next")
    out = rows.join(heads, "day")
    for i in range(1, steps + 1):
        out = out.withColumn(f"m{i}", F.when(F.col("_left") >= i, F.col(f"m{i}")).otherwise(F.get(F.col("_next"), (i - 1 - F.col("_left")).cast("int"))["mode"]))
    return out


def markov1(usage: DataFrame, least: int = BIGRAMS) -> DataFrame:
    """state, next, n, p: moves between differing modes, as shares of the state's uses."""
    rows = _ordered(usage, 1)
    uses = usage.groupBy(F.col("mode").alias("state")).agg(F.count("*").alias("uses"))
    moves = rows.where("m1 is not null and m1 <> mode").groupBy(F.col("mode").alias("state"), F.col("m1").alias("next")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return moves.join(uses, "state").select("state", "next", "n", F.round(F.col("n") / F.col("uses"), 6).alias("p"))


def markov2(usage: DataFrame, least: int = TRIGRAMS) -> DataFrame:
    """first, second, next, n, p: moves after two differing modes, as shares of that pair."""
    rows = _ordered(usage, 2).where("m1 is not null and m1 <> mode")
    pairs = rows.groupBy(F.col("mode").alias("first"), F.col("m1").alias("second")).agg(F.count("*").alias("pairs"))
    moves = rows.where("m2 is not null and m2 <> m1").groupBy(F.col("mode").alias("first"), F.col("m1").alias("second"), F.col("m2").alias("next")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return moves.join(pairs, ["first", "second"]).select("first", "second", "next", "n", F.round(F.col("n") / F.col("pairs"), 6).alias("p"))


def predict(usage: DataFrame, n: int = 3, threshold: float = 0.2) -> DataFrame:
    """The n likeliest next modes after each pair of modes; pairs without any fall back on their second mode."""
    second = markov2(usage).where(F.col("p") >= threshold)
    first = markov1(usage).where(F.col("p") >= threshold)
    # pairs that the log holds, not all that its modes could make
    states = _ordered(usage, 1).where("m1 is not null and m1 <> mode").select(F.col("mode").alias("first"), F.col("m1").alias("second")).distinct()
    known = second.select("first", "second").distinct()
    fallback = states.join(known, ["first", "second"], "left_anti").join(first.withColumnRenamed("state", "second"), "second").select("first", "second", "next", "n", "p", F.lit(1).alias("order"))
    rows = second.select("first", "second", "next", "n", "p", F.lit(2).alias("order")).unionByName(fallback)
    rank = F.row_number().over(W.partitionBy("first", "second").orderBy(F.desc("p"), "next"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def report(usage: DataFrame) -> DataFrame:
    """Uses, mean tokens and share of empty results of each mode."""
    return usage.groupBy("mode").agg(
        F.count("*").alias("uses"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.round(100.0 * F.count_if("empty") / F.count("*"), 6).alias("empty_pct"), F.countDistinct("repo").alias("repos")
    )


def token_stats(usage: DataFrame) -> DataFrame:
    """Tokens in all, useful and wasted, and the budget that follows from useful ones."""
    useful, count = F.sum(F.when(~F.col("empty"), F.col("tokens")).otherwise(0)), F.count_if(~F.col("empty"))
    rows = usage.groupBy("mode").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), useful.alias("useful"), F.sum(F.when(F.col("empty"), F.col("tokens")).otherwise(0)).alias("wasted"), count.alias("_c"))
    # per event, floored before and truncated after the margin
    per = F.floor(F.floor(1.2 * F.col("useful")) / F.greatest("_c", F.lit(1)))
    budget = F.when(F.col("_c") < 3, 4000).otherwise(F.greatest(F.lit(500), F.least(F.lit(8000), per)))
    return rows.select("mode", "total", "n", "useful", "wasted", budget.cast("long").alias("budget"))


def feedback(events: DataFrame) -> DataFrame:
    """Helpful or not, from purchases and errors."""
    return events.where("mode in ('purchase', 'error')").select("event_id", "ts", "repo", "mode", (F.col("mode") == "purchase").alias("helpful"))


def effectiveness(usage: DataFrame, least: int = 3) -> DataFrame:
    """Helpful rate of each repository with enough feedback, beside its mean tokens."""
    rates = feedback(usage).groupBy("repo").agg(F.count("*").alias("n"), F.round(F.count_if("helpful") / F.count("*"), 6).alias("rate")).where(F.col("n") >= least)
    tokens = usage.groupBy("repo").agg(F.round(F.avg("tokens"), 6).alias("avg_tokens"))
    return rates.join(tokens, "repo", "full")


def near_session_end(usage: DataFrame, seconds: int = 3600) -> DataFrame:
    """Feedback within so many seconds of a session's end: session, n.

    Times are cut to buckets of that many seconds, so each feedback meets the
    three buckets about it and not every session.
    """
    ends = sessions(usage).groupBy("session").agg(F.max("ts").alias("end"))
    ends = ends.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(_seconds(F.col("end")) / seconds) + d)))
    said = feedback(usage).select("event_id", "ts", F.floor(_seconds(F.col("ts")) / seconds).alias("_b"))
    close = F.abs(_seconds(F.col("ts")) - _seconds(F.col("end"))) <= seconds
    return ends.join(said, "_b").where(close).groupBy("session").agg(F.count("*").alias("n"))


def windows(usage: DataFrame, width: str = "7 days", slide: str | None = None) -> DataFrame:
    """Events and tokens of each window and mode."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return usage.groupBy(w.alias("w"), "mode").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.unix_micros("w.start").alias("start_us"), "mode", "n", "tokens")


def tail(usage: DataFrame, n: int = 50) -> DataFrame:
    """The last n events of the log."""
    return usage.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "mode", "tokens")


def insights(usage: DataFrame, least: int = 5) -> DataFrame:
    """task_type, best_modes, avg_tokens, success_rate, n: what sessions of each kind had in common.

    A session's kind is its most frequent mode (the least of equals); the best
    modes are the most frequent mode list of successful sessions.
    """
    rows = sessions(usage)
    kind = rows.groupBy("session", "mode").agg(F.count("*").alias("c")).groupBy("session").agg(F.min(F.struct((-F.col("c")).alias("c"), "mode"))["mode"].alias("task_type"))
    each = session_summary(usage).join(kind, "session")
    all_ = each.groupBy("task_type").agg(F.count("*").alias("n"), F.floor(F.sum("tokens") / F.count("*")).cast("long").alias("avg_tokens"), F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"))
    best = each.where("success").groupBy("task_type", "modes").agg(F.count("*").alias("c")).groupBy("task_type").agg(F.min(F.struct((-F.col("c")).alias("c"), "modes"))["modes"].alias("best_modes"))
    return all_.where(F.col("n") >= least).join(best, "task_type", "left").select("task_type", "best_modes", "avg_tokens", "success_rate", "n")
