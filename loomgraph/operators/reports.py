"""Reports over usage and feedback logs: own and shared logs merged, counts by repository and mode, helpfulness of modes.

usage: event_id, ts, repo, repo_path, mode, tokens, empty, duration_ms;
feedback: ts, repo, repo_path, mode, helpful, note.  Any column may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import step_folder, written
from .telemetry import sessions

# Marks of repositories that tests made, modes that aren't work, and the gates of the comparison of modes.
SCRATCH, SCRATCH_PATHS = "tmp", ("/tmp/", "pytest")
TEST_PATHS = ("pytest-of-", "/tmp/", "/T/pytest-", "test_telemetry_", "pytest-")
INTERNAL, NO_WORK = "stats", ("stats", "report", "plugins", "serve")
SESSIONS, RATED, REPOSITORIES, NOTES, NOTE = 10, 3, 5, 5, 100


def merged(own: DataFrame, shared: DataFrame) -> DataFrame:
    """own, and the rows of shared whose time own doesn't have; a row without a time counts as one time."""
    known = own.select(F.col("ts").alias("_ts")).distinct()
    return own.unionByName(shared.join(known, F.col("ts").eqNullSafe(F.col("_ts")), "left_anti").select(*own.columns))


def real(log: DataFrame) -> DataFrame:
    """Rows that no test run left: neither a short repository name that begins with tmp nor a scratch path."""
    repo, path = F.coalesce("repo", F.lit("")), F.coalesce("repo_path", F.lit(""))
    scratch = repo.startswith(SCRATCH) & (F.length(repo) < 20)
    return log.where(~reduce(lambda a, b: a | b, (path.contains(p) for p in SCRATCH_PATHS), scratch))


def usage_report(usage: DataFrame, feedback: DataFrame) -> DataFrame:
    """section, item, n, value: the rows of a report.

    repo: uses; total: uses and how many internal ones are left out; mode: uses and mean tokens
    (whole, null without any); empty: empty results and their share in percent; duration: the
    longest and the mean (whole); feedback: helpful or unhelpful; unhelpful: by mode; note: the
    last five, n from 1 for the oldest.  The logs are read once each; all but the notes comes
    from their sums by repository and mode.
    """
    at = step_folder(usage.sparkSession)
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    by = usage.groupBy(unknown("repo").alias("repo"), unknown("mode").alias("mode")).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("told"), F.count_if(F.coalesce("empty", F.lit(False))).alias("empty"),
        F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("timed"), F.max("duration_ms").alias("longest"),
    )
    by = written(by, f"{at}/usage")
    said = written(feedback.groupBy(unknown("mode").alias("mode"), F.coalesce("helpful", F.lit(False)).alias("helpful")).agg(F.count("*").alias("n")), f"{at}/feedback")
    work = F.col("mode") != INTERNAL

    def rows(df: DataFrame, section: str, item: Column, n: Column | str = "n", value: Column | None = None) -> DataFrame:
        value = F.lit(None) if value is None else value
        return df.select(F.lit(section).alias("section"), item.alias("item"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("n"), F.round(value.cast("double"), 6).alias("value"))

    modes = by.where(work).groupBy("mode").agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "told", "empty")])
    totals = by.agg(F.sum(F.when(work, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(work, 0).otherwise(F.col("n"))).alias("out"), F.sum("ms").alias("ms"), F.sum("timed").alias("timed"), F.max("longest").alias("longest"))
    tally = said.groupBy("helpful").agg(F.sum("n").alias("n"))
    sign = F.when(F.coalesce("helpful", F.lit(False)), "[+] ").otherwise("[-] ")
    notes = feedback.where("note <> ''").select("ts", F.concat(sign, F.coalesce("mode", F.lit("?")), F.lit(": "), F.substring("note", 1, NOTE)).alias("item"))
    notes = notes.orderBy(F.desc("ts"), F.desc("item")).limit(NOTES).agg(F.array_sort(F.collect_list(F.struct("ts", "item"))).alias("_l")).select(F.posexplode("_l"))  # NOTES rows
    parts = (
        rows(by.groupBy("repo").agg(F.sum("n").alias("n")), "repo", F.col("repo")),
        rows(totals.where("n is not null"), "total", F.lit(""), "n", F.col("out")),
        rows(modes, "mode", F.col("mode"), "n", F.floor(F.col("tokens") / F.when(F.col("told") > 0, F.col("told")))),
        rows(modes.where("empty > 0"), "empty", F.col("mode"), "empty", 100 * F.col("empty") / F.col("n")),
        rows(totals.where("timed > 0"), "duration", F.lit(""), "longest", F.floor(F.col("ms") / F.col("timed"))),
        rows(tally, "feedback", F.when(F.col("helpful"), "helpful").otherwise("unhelpful")),
        rows(said.where("not helpful"), "unhelpful", F.col("mode")),
        rows(notes, "note", F.col("col.item"), F.col("pos") + 1),
    )
    return reduce(DataFrame.unionByName, parts)


def mode_effectiveness(usage: DataFrame, feedback: DataFrame) -> DataFrame:
    """section, item, n, rate, avg_tokens: modes with at least three ratings, their share of helpful ones and mean tokens; and the five repositories with most sessions.

    Nothing below ten sessions in all.  Modes that aren't work and repositories of
    test runs don't count; a session belongs to the repository of its first event;
    events without a time are in none; mean tokens leave out events without tokens.
    """
    at = step_folder(usage.sparkSession)
    tests = lambda c: reduce(lambda a, b: a | b, (F.coalesce(c, F.lit("")).contains(p) for p in TEST_PATHS))
    place = F.coalesce("repo_path", "repo", F.lit(""))
    log = usage.where(~F.coalesce("mode", F.lit("")).isin(*NO_WORK) & ~tests(place) & F.col("ts").isNotNull())
    starts = sessions(log).groupBy("session").agg(F.min(F.struct("ts", "event_id", F.coalesce("repo_path", "repo", F.lit("unknown")).alias("item")))["item"].alias("item"))
    repos = written(starts.groupBy("item").agg(F.count("*").alias("n")), f"{at}/repos")
    enough = repos.agg((F.coalesce(F.sum("n"), F.lit(0)) >= SESSIONS).alias("_enough"))  # one row
    tokens = log.where("tokens <> 0").groupBy("mode").agg(F.floor(F.sum("tokens") / F.count("*")).cast("long").alias("avg_tokens"))
    rated = feedback.where(F.col("mode").isNotNull() & (F.col("mode") != "") & ~tests("repo_path"))
    rates = rated.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.count_if(F.coalesce("helpful", F.lit(False))) / F.count("*"), 6).alias("rate")).where(F.col("n") >= RATED)
    modes = rates.join(tokens, "mode", "left").select(F.lit("mode").alias("section"), F.col("mode").alias("item"), "n", "rate", F.coalesce("avg_tokens", F.lit(0)).alias("avg_tokens"))
    top = repos.orderBy(F.desc("n"), "item").limit(REPOSITORIES).select(F.lit("repo").alias("section"), "item", "n", F.lit(None).cast("double").alias("rate"), F.lit(None).cast("long").alias("avg_tokens"))
    return modes.unionByName(top).join(F.broadcast(enough)).where("_enough").drop("_enough")  # enough is one row
