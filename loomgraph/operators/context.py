"""What goes into a prepared context: gates on the files that a task's keywords find, and a budget carried over sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files of a keyword that are all kept, that are kept in part, of a precise context, of a context by path, of a baseline that has a say; the shortest keyword that paths are searched for.
ALL, PART, PRECISE, BY_PATH, BASELINE, SHORTEST = 8, 15, 4, 5, 2, 4


def gate(found: DataFrame, fallback: DataFrame, baseline: DataFrame | None = None, precise: bool = False) -> DataFrame:
    """task, how, n, files of each task of found or fallback: the files that its context names, by the gates in their order.

    found: task, keyword, k (the keyword's place), file, rank: files of a focus on
    the keyword.  fallback: the same for files found otherwise, with way (0 by
    path, 1 by definitions).  baseline: task, file, what was predicted without
    context.

    Breadth: a keyword of up to ALL files is a focus; of up to PART files the
    first PART - n are kept for the case that nothing else is found; of more none.
    The first keyword without a focus that has files by path, else by definitions
    (of broad keywords only), else of those kept, gives the fallback files.  They
    come before those of the focus, or stand alone, BY_PATH at most.  A precise
    context of more than PRECISE files is dropped, and one that shares no file with
    a baseline of BASELINE files or more.
    """
    sizes = found.groupBy("task", "keyword").agg(F.count_distinct("file").alias("_n"))
    sized = found.join(sizes, ["task", "keyword"])
    focus = sized.where(F.col("_n") <= ALL).select("task", "k", "rank", "file")
    kept = sized.where(F.col("_n").between(ALL + 1, PART) & (F.col("rank") <= F.greatest(F.lit(1), PART - F.col("_n")))).select("task", "k", F.lit(2).alias("way"), "rank", "file")
    other = fallback.where(F.length("keyword") >= SHORTEST).join(sizes, ["task", "keyword"], "left").where(F.col("_n").isNull() | (F.col("_n") > ALL))
    other = other.where((F.col("way") == 0) | (F.col("_n") > ALL)).select("task", "k", "way", "rank", "file")
    ways = kept.unionByName(other)
    first = ways.groupBy("task").agg(F.min(F.struct("k", "way")).alias("_first"))
    instead = ways.join(first, "task").where((F.col("k") == F.col("_first.k")) & (F.col("way") == F.col("_first.way"))).select("task", F.lit(0).alias("part"), "k", "rank", "file")
    every = instead.unionByName(focus.select("task", F.lit(1).alias("part"), "k", "rank", "file"))
    # each file once, at its first place
    places = every.groupBy("task", "file").agg(F.min(F.struct("part", "k", "rank")).alias("_at"))
    order = W.partitionBy("task").orderBy("_at", "file")
    has_focus = F.max(F.col("_at.part")).over(W.partitionBy("task")) == 1
    placed = places.withColumn("_r", F.row_number().over(order)).withColumn("_focus", has_focus | F.lit(False))
    if baseline is not None:
        predicted = baseline.select("task", "file").distinct()
        placed = placed.join(predicted.withColumn("_told", F.lit(True)), ["task", "file"], "left")
        said = predicted.groupBy("task").agg(F.count("*").alias("_said"))
        placed = placed.join(said, "task", "left")
    else:
        placed = placed.withColumns({"_told": F.lit(None).cast("boolean"), "_said": F.lit(0)})
    shown = F.when(F.col("_focus") | (F.col("_r") <= BY_PATH), F.struct("_r", "file"))
    # gathered are a focus of up to ALL files a keyword, or BY_PATH files
    rows = placed.groupBy("task").agg(
        F.count("*").alias("n"), F.first("_focus").alias("_focus"), F.count_if("_told").alias("_shared"), F.coalesce(F.first("_said"), F.lit(0)).alias("_said"), F.array_sort(F.collect_list(shown)).alias("_files")
    )
    far = (F.col("_said") >= BASELINE) & (F.col("_shared") == 0)
    many = F.lit(precise) & (F.col("n") > PRECISE)
    how = F.when(many, "too broad").when(far, "off the baseline").when(F.col("_focus"), "focus").otherwise("path")
    tasks = found.select("task").unionByName(fallback.select("task")).distinct()
    files = F.when(how.isin("focus", "path"), F.array_join(F.transform("_files", lambda x: x["file"]), " ")).otherwise("")
    return tasks.join(rows.select("task", how.alias("how"), "n", files.alias("files")), "task", "left").na.fill({"how": "nothing", "n": 0, "files": ""})


def carried(sections: Column, budget: int) -> Column:
    """Tokens that the sections of a context get, in order: each what it needs, up to its share of what is left for it; what one doesn't use the next ones may.

    sections: array of (needs, share), share being a part of the budget that is left then.
    """
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("given"))

    def take(done: Column, s: Column) -> Column:
        given = F.least(s["needs"].cast("long"), F.floor(done["left"] * s["share"]).cast("long"))
        return F.struct((done["left"] - given).alias("left"), F.concat(done["given"], F.array(given)).alias("given"))

    return F.aggregate(sections, start, take, lambda done: done["given"])
