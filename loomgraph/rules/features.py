"""Feature tables: one row per symbol, file, changed file and pair of files that import each other, and one for the top hotspot and the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, is_test, module_of
from ..model import CodeGraph
from ..operators.history import ages, commit_counts, newest_change
from ..operators.scoring import dead_confidence
from .totals import CODE_LANGUAGES, PATHS

_INTERFACE = ("function", "method", "class", "constant")


def _grandparents(g: CodeGraph) -> DataFrame:
    """id, grandparents: bases of bases.  A class names few bases, so a popular base's own row is met once by each heir."""
    base = g.pairs("inherits")
    above = base.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("above"))
    return base.join(above, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("grandparents"))


def symbols(g: CodeGraph) -> DataFrame:
    test = is_test(F.col("source_file"))
    up = g.calls.groupBy(F.col("target_id").alias("id")).agg(
        F.count("*").alias("callers"), F.count_if(test).alias("test_callers"), F.countDistinct(F.when(F.col("source_file") != F.col("target_file"), F.col("source_file"))).alias("cross_files"),
        F.countDistinct(F.when((F.col("source_file") != F.col("target_file")) & ~test, F.col("source_file"))).alias("src_files"),
    )
    down = g.calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    kids = g.of_kind("contains").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("children"))
    subs = g.pairs("inherits", "implements").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("subtypes"))
    rend = g.pairs("renders").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("renderers"))
    own = g.symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind").isin("function", "method")).alias("member_fns"))
    rows = g.symbols.select(
        "id", "name", F.lower("name").alias("low"), "kind", "file_path", (F.col("line_end") - F.col("line_start") + 1).alias("lines"), "complexity", "exported", "doc", "signature", "parent_id", "byte_size",
        is_test(F.col("file_path")).alias("is_test"), F.col("language").isin(*CODE_LANGUAGES).alias("code"),
    )
    for more in (up, down, kids, subs, rend, own, _grandparents(g)):
        rows = rows.join(more, "id", "left")
    importers = g.imports.groupBy(F.col("target_id").alias("file_path")).agg(F.count("*").alias("file_importers"))
    rows = rows.join(importers, "file_path", "left").na.fill(0, ["file_importers", "callers", "test_callers", "cross_files", "src_files", "callees", "children", "subtypes", "renderers", "methods", "member_fns", "grandparents"])
    return rows.join(dead_confidence(g).select("id", "confidence"), "id", "left")


def files(g: CodeGraph, now: str) -> DataFrame:
    importers = g.imports.groupBy(F.col("target_id").alias("file_path")).agg(F.count("*").alias("importers"), F.count_if(is_test(F.col("source_id"))).alias("test_importers"))
    outside = g.imports.where(module_of(F.col("source_id")) != module_of(F.col("target_id"))).groupBy(F.col("target_id").alias("file_path")).agg(F.count("*").alias("outside_importers"))
    imports = g.imports.groupBy(F.col("source_id").alias("file_path")).agg(F.count("*").alias("imports"), F.count_if(~is_test(F.col("target_id"))).alias("src_imports"))
    own = g.symbols.groupBy("file_path").agg(
        F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.count_if(F.col("exported") & F.col("kind").isin("function", "method")).alias("exported_fns"),
        F.count_if(F.col("exported") & F.col("kind").isin("function", "method", "class", "interface")).alias("exported_api"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "constant").alias("constants"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.max("complexity").alias("max_cx"), F.sum("complexity").alias("cx"), F.max("line_end").alias("lines"),
        F.min("language").alias("language"), F.count_if(F.col("name").startswith("test_")).alias("test_named"), F.count_if(F.lower("name").startswith("test_")).alias("low_test_named"),
        F.count_if(F.col("kind").isin("function", "method", "class")).alias("definitions"), F.count_if(F.col("kind").isin(*_INTERFACE)).alias("interface"), F.count_if(F.col("exported") & F.col("kind").isin(*_INTERFACE)).alias("interface_exported"),
        F.count_if(F.col("kind").isin("constant", "variable")).alias("consts"), F.count_if(F.col("parent_id").isNull() & ~F.col("name").startswith("_")).alias("public_top"),
        F.count_if(F.col("parent_id").isNull() & ~F.col("kind").isin("constant", "variable", "unknown", "module")).alias("top_others"),
        F.count_if(F.col("parent_id").isNull()).alias("top_symbols"), F.count_if(F.col("parent_id").isNull() & (F.col("kind") == "function")).alias("top_functions"),
    )
    history = commit_counts(g).join(ages(g, now), "path", "left").select(F.col("path").alias("file_path"), "commits", "days")
    rows = own
    for more in (importers, outside, imports, history):
        rows = rows.join(more, "file_path", "left")
    rows = rows.na.fill(0, ["importers", "test_importers", "outside_importers", "imports", "src_imports", "commits"])
    rows = rows.withColumn("stem", F.regexp_replace(F.lower(basename(F.col("file_path"))), "[.][^.]*$", ""))
    return rows.withColumns({"base": F.lower(basename(F.col("file_path"))), "is_test": is_test(F.col("file_path")), "module": module_of(F.col("file_path")), "code": F.col("language").isin(*CODE_LANGUAGES), "depth": F.size(F.split("file_path", "/")) - 1, "folder": F.regexp_replace("file_path", "/?[^/]*$", "")})


OF_CHANGED = ("symbols", "lines", "importers", "test_importers", "classes", "consts", "public_top", "top_others")


def changed_paths(g: CodeGraph) -> DataFrame:
    """file_path: the newest change of five files or more."""
    return newest_change(g).select(F.col("path").alias("file_path")).distinct()


def changed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of a change with their parts and counts; a path that the graph doesn't know has counts of 0."""
    rows = paths.join(files.select("file_path", *OF_CHANGED, F.lit(True).alias("known")), "file_path", "left").na.fill(0, list(OF_CHANGED)).na.fill(False, ["known"])
    return rows.withColumns({n: F.expr(e) for n, e in PATHS.items()} | {"is_test": is_test(F.col("file_path"))})


def touched(symbols: DataFrame, paths: DataFrame, g: CodeGraph) -> DataFrame:
    """The symbols rows of changed files with far_files: caller files outside of the change."""
    far = g.calls.join(paths.select(F.col("file_path").alias("source_file")), "source_file", "left_anti").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_file").alias("far_files"))
    return symbols.join(paths, "file_path", "left_semi").join(far, "id", "left").na.fill(0, ["far_files"])


def users(paths: DataFrame, g: CodeGraph) -> DataFrame:
    """file_path: files outside of the change that call symbols of its sources."""
    calls = g.calls.where(~is_test(F.col("target_file"))).join(paths.select(F.col("file_path").alias("target_file")), "target_file", "left_semi")
    return calls.select(F.col("source_file").alias("file_path")).distinct().join(paths, "file_path", "left_anti")


# What the callers of the top hotspot are, over calls with the folder and first part of both files.
CALLERS = {
    "cross_callers": "count(*) FILTER (WHERE source_file <> target_file)", "src_cross_callers": "count(*) FILTER (WHERE source_file <> target_file AND NOT is_test)", "self_calls": "count(*) FILTER (WHERE source_id = target_id)",
    "outer_callers": "count(*) FILTER (WHERE source_folder <> target_folder)", "caller_files": "count(DISTINCT source_file)", "src_folders": "count(DISTINCT CASE WHEN NOT is_test THEN source_folder END)",
    "src_roots": "count(DISTINCT CASE WHEN NOT is_test THEN split_part(source_file, '/', 1) END)", "far_roots": "count(DISTINCT CASE WHEN NOT is_test AND instr(source_file, '/') > 0 THEN split_part(source_file, '/', 1) END)",
    "cross_roots": "count(DISTINCT CASE WHEN source_file <> target_file AND instr(source_file, '/') > 0 THEN split_part(source_file, '/', 1) END)",
}


def leaders(symbols: DataFrame, hot: DataFrame) -> DataFrame:
    """The symbols rows of the first hotspots, a few rows."""
    return symbols.join(hot.select("id"), "id", "left_semi")


def top(symbols: DataFrame, files: DataFrame, hot: DataFrame, g: CodeGraph) -> DataFrame:
    """The symbols row of the first hotspot with the names and counts of its file and what its callers are; no row where nothing scores."""
    first = leaders(symbols, hot.orderBy(F.desc("score"), "id").limit(1)).join(files.select("file_path", "base", "stem", F.col("symbols").alias("file_symbols"), F.col("functions").alias("file_functions")), "file_path")
    folder = {f"{side}_folder": F.regexp_replace(f"{side}_file", "/?[^/]*$", "") for side in ("source", "target")}
    calls = g.calls.join(first.select(F.col("id").alias("target_id")), "target_id", "left_semi").withColumns(folder | {"is_test": is_test(F.col("source_file"))})
    return first.join(calls.groupBy(F.col("target_id").alias("id")).agg(*[F.expr(e).alias(n) for n, e in CALLERS.items()]), "id", "left").na.fill(0, list(CALLERS))


def mutual(g: CodeGraph) -> DataFrame:
    """file_path, partner: sources that import each other, each pair both ways."""
    own = g.imports.where(~is_test(F.col("source_id")) & ~is_test(F.col("target_id")) & (F.col("source_id") != F.col("target_id"))).select(F.col("source_id").alias("file_path"), F.col("target_id").alias("partner"))
    return own.join(own.select(F.col("partner").alias("file_path"), F.col("file_path").alias("partner")), ["file_path", "partner"], "left_semi")
