"""Families of names, and how exposed a change of a symbol is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_test
from ..model import CodeGraph

# Shortest base of a series and stem of a family, least siblings; and from where a factor of exposure counts.
BASE, STEM, SIBLINGS = 5, 5, 3
CALLER_FILES, HOT_CALLEES, HOT_CALLERS, CALLEES, GAP = 8, 2, 3, 3, 0.5
_VARIANT = r"^(.+)_([a-z]|[0-9]+)$"


def _bare(name: Column) -> Column:
    return F.length(F.regexp_replace(name, "^_+", ""))


def variants(g: CodeGraph) -> DataFrame:
    """Functions and methods outside tests that end in a single letter or a number: id, file_path, base, series (A/B or numeric), at (its place in the series)."""
    base, end = F.regexp_extract("name", _VARIANT, 1), F.regexp_extract("name", _VARIANT, 2)
    rows = g.symbols.where(F.col("kind").isin("function", "method") & ~is_test(F.col("file_path")) & (_bare(base) >= BASE))
    numeric = end.rlike("^[0-9]+$")
    return rows.select("id", "name", "file_path", base.alias("base"), F.when(numeric, "numeric series").otherwise("A/B series").alias("series"), F.when(numeric, end.try_cast("long")).otherwise(F.ascii(end)).alias("at"))


def variant_groups(g: CodeGraph) -> DataFrame:
    """file_path, base, series, total, longest_run: names of a file that differ by their last letter or number, and the most of them that follow each other without a gap.

    Of a series in order, a name begins a run where the one before it isn't the
    next lower letter or number; names in the same run share the number of such
    beginnings up to them.
    """
    rows = variants(g).select("file_path", "base", "series", "at", "name").distinct()
    key = ["file_path", "base", "series"]
    order = W.partitionBy(*key).orderBy("at", "name")
    begins = F.when(F.col("at") - F.lag("at").over(order) <= 1, 0).otherwise(1)
    runs = rows.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*key, "_run").agg(F.count("*").alias("total"), F.count_distinct("at").alias("_long"))
    return runs.groupBy(*key).agg(F.sum("total").alias("total"), F.max("_long").alias("longest_run")).where("total >= 2")


def unbroken_series(g: CodeGraph, least: int = 3) -> DataFrame:
    """The groups of which at least so many follow each other: a, b, c or 1, 2, 3, but not 1, 3, 7."""
    return variant_groups(g).where(F.col("longest_run") >= least)


def stem_of_name(name: Column) -> Column:
    """The first word of a name with a leading underscore, if that has four letters; null for none and for names like __this__."""
    first = F.regexp_extract(name, r"^_*([^_]+)", 1)
    return F.when(~name.rlike("^__.*__$") & (F.length(first) >= 4), F.concat(F.when(name.startswith("_"), "_").otherwise(""), first))


def sibling_families(g: CodeGraph) -> DataFrame:
    """id, stem, siblings: names of other files of a symbol's folder that begin with its stem, three of them or more.

    Of the names of a folder and stem all count but those that the symbol's own
    file alone has, so no pairs of siblings are made.
    """
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    rows = g.symbols.where(~is_test(F.col("file_path"))).select("id", "name", "file_path", folder.alias("folder"), stem_of_name(F.col("name")).alias("stem")).where(_bare(F.col("stem")) >= STEM)
    named = rows.where(F.col("name").startswith(F.concat("stem", F.lit("_"))))
    places = named.groupBy("folder", "stem", "name").agg(F.min("file_path").alias("_one"), F.count_distinct("file_path").alias("_files"))
    all_ = places.groupBy("folder", "stem").agg(F.count("*").alias("_all"))
    own = places.where("_files = 1").groupBy("folder", "stem", F.col("_one").alias("file_path")).agg(F.count("*").alias("_own"))
    counted = rows.join(all_, ["folder", "stem"]).join(own, ["folder", "stem", "file_path"], "left")
    return counted.withColumn("siblings", F.col("_all") - F.coalesce("_own", F.lit(0))).where(F.col("siblings") >= SIBLINGS).select("id", "stem", "siblings")


def exposure(g: CodeGraph, hot: DataFrame) -> DataFrame:
    """id, caller_files, hot_callees, hot_callers, callees, untested, in_hot, factors and level of each symbol that a change exposes; hot: paths of files that change now.

    Five factors count once each: callers in 8 files, 2 hot callees, 3 hot callers,
    half of at least 3 callees in other files without a test that calls them, and
    the symbol's own file being hot.  Callers and callees are those outside tests.
    """
    warm = hot.select("path").distinct().withColumn("_hot", F.lit(True))
    named = lambda end: warm.select(F.col("path").alias(end), F.col("_hot").alias(f"_{end}"))
    cross = g.calls.where("source_file <> target_file").join(named("source_file"), "source_file", "left").join(named("target_file"), "target_file", "left")
    tested = g.calls.where(is_test(F.col("source_file"))).select("target_id").distinct().withColumn("_tested", F.lit(True))
    up = cross.where(~is_test(F.col("source_file"))).groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_file").alias("caller_files"), F.count_if("_source_file").alias("hot_callers"))
    down = cross.where(~is_test(F.col("target_file"))).join(tested, "target_id", "left").groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("callees"), F.count_if("_target_file").alias("hot_callees"), F.count_if(F.col("_tested").isNull()).alias("untested")
    )
    own = g.symbols.select("id", "file_path").join(warm.withColumnRenamed("path", "file_path"), "file_path", "left").select("id", F.coalesce("_hot", F.lit(False)).alias("in_hot"))
    rows = own.join(up, "id", "left").join(down, "id", "left").na.fill(0, ["caller_files", "hot_callers", "callees", "hot_callees", "untested"])
    gap = (F.col("callees") >= CALLEES) & (F.col("untested") >= GAP * F.col("callees"))
    tests = [F.col("caller_files") >= CALLER_FILES, F.col("hot_callees") >= HOT_CALLEES, F.col("hot_callers") >= HOT_CALLERS, gap, F.col("in_hot")]
    factors = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    level = F.when(factors >= 3, "CRITICAL").when(factors == 2, "HIGH").otherwise("MEDIUM")
    return rows.withColumn("factors", factors).withColumn("level", level).where("factors > 0").select("id", "caller_files", "hot_callees", "hot_callers", "callees", "untested", "in_hot", "factors", "level")
