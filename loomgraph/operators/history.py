"""Operators over commits: co-change, velocity and age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_test_history
from ..model import CodeGraph

#: Commits with fewer or more files say nothing about coupling; so many files also bound the pairs of a commit.
FEWEST, MOST = 2, 50
DECAY = 0.01


def coupled_commits(g: CodeGraph) -> DataFrame:
    """commit_id, day, path of commits with FEWEST to MOST files."""
    sizes = g.commit_files.groupBy("commit_id").agg(F.count("*").alias("n"))
    return g.commit_files.join(sizes.where(F.col("n").between(FEWEST, MOST)), "commit_id").drop("n")


def pair_counts(g: CodeGraph) -> DataFrame:
    """a < b, together, last (day) of files that share a commit; at most MOST ** 2 / 2 pairs a commit."""
    files = coupled_commits(g)
    a, b = files.select("commit_id", "day", F.col("path").alias("a")), files.select("commit_id", F.col("path").alias("b"))
    return a.join(b, "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"), F.max("day").alias("last"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnRenamed("a", "path").withColumnRenamed("b", "partner").unionByName(pairs.withColumnRenamed("b", "path").withColumnRenamed("a", "partner"))


def cochange(g: CodeGraph, n: int = 10) -> DataFrame:
    """The n partners of each file that change with it most: path, partner, together, frequency, rank."""
    counts = coupled_commits(g).groupBy("path").agg(F.count("*").alias("n"))
    ca, cb = (counts.select(F.col("path").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = pair_counts(g).where("together >= 2").join(ca, "a").join(cb, "b")
    pairs = pairs.withColumn("frequency", F.round(F.col("together") / F.least("n_a", "n_b"), 6)).select("a", "b", "together", "frequency")
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("frequency"), "partner"))
    return _both(pairs).withColumn("rank", rank).where(F.col("rank") <= n)


def cochange_recency(g: CodeGraph, now: str, n: int = 10) -> DataFrame:
    """Co-change decayed by the days since the last common commit."""
    counts = coupled_commits(g).groupBy("path").agg(F.count("*").alias("n"))
    ca, cb = (counts.select(F.col("path").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = pair_counts(g).where("together >= 2").join(ca, "a").join(cb, "b")
    days = F.greatest(F.lit(0), F.date_diff(F.lit(now).cast("date"), "last"))
    decayed = F.col("together") / F.least("n_a", "n_b") * F.exp(-DECAY * days)
    pairs = pairs.select("a", "b", F.round(decayed, 6).alias("score"), days.alias("days"))
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "partner"))
    return _both(pairs).withColumn("rank", rank).where(F.col("rank") <= n)


def cochange_of(g: CodeGraph, path: str, n: int = 3, least: int = 3) -> DataFrame:
    """Files other than tests that change with one file, by number of commits."""
    commits = coupled_commits(g)
    own = commits.where(F.col("path") == path).select("commit_id")
    return (
        commits.join(own, "commit_id", "left_semi").where((F.col("path") != path) & ~is_test_history(F.col("path")))
        .groupBy("path").agg(F.count("*").alias("together")).where(F.col("together") >= least).orderBy(F.desc("together"), "path").limit(n)
    )


def cochange_ratio(g: CodeGraph, path: str, least: int = 3, n: int = 10) -> DataFrame:
    """Files in at least half of one file's commits; commits of any size count."""
    own = g.commit_files.where(F.col("path") == path).select("commit_id").distinct()
    total = own.agg(F.count("*").alias("total"))
    return (
        g.commit_files.join(own, "commit_id", "left_semi").where(F.col("path") != path).groupBy("path").agg(F.count("*").alias("together"))
        .join(F.broadcast(total)).where(F.col("total") >= least)  # total is one row
        .withColumn("ratio", F.round(F.col("together") / F.col("total"), 6)).where((F.col("together") >= least) & (F.col("ratio") >= 0.5))
        .select("path", "together", "ratio").orderBy(F.desc("ratio"), "path").limit(n)
    )


def missing_partners(g: CodeGraph, changed: DataFrame, least: float = 0.5) -> DataFrame:
    """Frequent partners of changed files that aren't changed themselves."""
    return cochange(g).join(changed, "path", "left_semi").where(F.col("frequency") >= least).join(changed.select(F.col("path").alias("partner")), "partner", "left_anti").select("path", "partner", "frequency")


def commit_counts(g: CodeGraph) -> DataFrame:
    return g.commit_files.groupBy("path").agg(F.countDistinct("commit_id").alias("commits"))


def velocity(g: CodeGraph, now: str, days: int) -> DataFrame:
    """Commits per week in the last days."""
    since = F.date_sub(F.lit(now).cast("date"), days)
    return g.commit_files.where(F.col("day") >= since).groupBy("path").agg((F.countDistinct("commit_id") * 7.0 / days).alias("per_week"))


def ages(g: CodeGraph, now: str, horizon: int = 730) -> DataFrame:
    """Days since the last commit of files that have one within the horizon, with a label."""
    days = F.date_diff(F.lit(now).cast("date"), F.max("day"))
    label = F.when(F.col("days") <= 7, "HOT").when(F.col("days") <= 30, "WARM").otherwise("STABLE")
    return g.commit_files.groupBy("path").agg(days.alias("days")).where(F.col("days") <= horizon).withColumn("label", label)


def recent_files(g: CodeGraph, commits: int = 20) -> DataFrame:
    """Files of the latest commits."""
    latest = g.commit_files.select("commit_id", "day").distinct().orderBy(F.desc("day"), F.desc("commit_id")).limit(commits)
    return g.commit_files.join(F.broadcast(latest.select("commit_id")), "commit_id", "left_semi").select("path").distinct()


def newest_change(g: CodeGraph, least: int = 5) -> DataFrame:
    """Paths of the newest commit with at least so many files: the stand-in for a working diff."""
    sizes = g.commit_files.groupBy("commit_id", "day").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("day"), F.desc("commit_id")).limit(1)
    return g.commit_files.join(F.broadcast(sizes.select("commit_id")), "commit_id", "left_semi").select("path")
