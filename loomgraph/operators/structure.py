"""Roll-ups of files, folders and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import basename, is_test, module_of, trunc
from ..model import CodeGraph
from ..session import step_folder, written
from .history import ages, cochange, commit_counts
from .scoring import dead_confidence


def _lines() -> Column:
    return F.col("line_end") - F.col("line_start") + 1


def stats(g: CodeGraph) -> DataFrame:
    """Counts of the whole graph, its kinds and its edge kinds in one table: what, name, n."""
    def rows(what: str, name: Column, df: DataFrame) -> DataFrame:
        return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")

    all_ = F.lit("all")
    return (
        rows("files", all_, g.files).unionByName(rows("symbols", all_, g.symbols)).unionByName(rows("edges", all_, g.edges))
        .unionByName(rows("kind", F.col("kind"), g.symbols)).unionByName(rows("edge_kind", F.col("kind"), g.edges)).unionByName(rows("language", F.col("language"), g.symbols))
    )


def folders(g: CodeGraph) -> DataFrame:
    """Files, lines, symbols and kinds of each folder."""
    folder = module_of(F.col("file_path"))
    return g.symbols.groupBy(folder.alias("folder")).agg(
        F.countDistinct("file_path").alias("files"), F.sum(_lines()).alias("lines"), F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )


def file_health(g: CodeGraph) -> DataFrame:
    """dead, hotspot, healthy or stable, by the share of dead symbols and mean complexity."""
    dead = dead_confidence(g).groupBy("file_path").agg(F.count("*").alias("n_dead"))
    rows = g.symbols.groupBy("file_path").agg(F.count("*").alias("n"), F.avg("complexity").alias("cx")).join(dead, "file_path", "left").na.fill(0, ["n_dead"])
    share = trunc(100 * F.col("n_dead") / F.col("n"))
    health = F.when(share > 80, "dead").when(F.col("cx") > 50, "hotspot").when((F.col("n") > 0) & (share < 20) & (F.col("cx") < 20), "healthy").otherwise("stable")
    return rows.select("file_path", F.col("n").alias("symbols"), share.alias("dead_pct"), F.round("cx", 6).alias("avg_cx"), health.alias("health"))


def file_edges(g: CodeGraph, n: int = 2000) -> DataFrame:
    """Undirected weights between files of known symbols, the heaviest first."""
    known = g.symbols.select(F.col("id"), F.col("file_path"))
    rows = (
        g.edges.join(known.select(F.col("id").alias("source_id"), F.col("file_path").alias("x")), "source_id")
        .join(known.select(F.col("id").alias("target_id"), F.col("file_path").alias("y")), "target_id").where("x <> y")
    )
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(n)


def key_files(g: CodeGraph, n: int = 12) -> DataFrame:
    score = F.sum(_lines()) + 3 * F.sum("complexity")
    return g.symbols.groupBy("file_path").agg(score.alias("score")).orderBy(F.desc("score"), "file_path").limit(n)


def hot_symbols(g: CodeGraph, least: int = 3) -> DataFrame:
    """Symbols that at least so many other files, tests aside, call; and whether a test calls them."""
    test = is_test(F.col("source_file"))
    rows = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(
        F.countDistinct(F.when(~test, F.col("source_file"))).alias("files"), F.max(test).alias("tested")
    )
    return rows.where(F.col("files") >= least)


def stable_core(g: CodeGraph, now: str, importers: int = 5, days: int = 30) -> DataFrame:
    """Files that many sources import and that haven't changed for long."""
    used = g.imports.where(~is_test(F.col("source_id"))).groupBy(F.col("target_id").alias("path")).agg(F.count("*").alias("importers"))
    return used.where(F.col("importers") >= importers).join(ages(g, now), "path").where(F.col("days") >= days).select("path", "importers", "days")


def stem_of(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def holders(stems: DataFrame, names: DataFrame) -> DataFrame:
    """stem, name: the names that hold each stem, wherever in them; both columns distinct.

    A substring join over blocks: a stem looks only at names that hold the
    rarest of its runs of three characters (or the whole stem, if shorter).
    """
    def runs(c: str) -> Column:
        size = F.least(F.lit(3), F.length(c))
        every = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
        return F.when(size == 3, every(3)) if c == "stem" else F.array_distinct(F.concat(every(1), every(2), every(3)))

    held = names.select("name", F.explode(runs("name")).alias("run"))
    common = held.groupBy("run").agg(F.count("*").alias("n"))
    own = stems.where(F.length("stem") > 0).select("stem", F.explode(F.coalesce(runs("stem"), F.array("stem"))).alias("run")).distinct()
    rarest = own.join(common, "run").groupBy("stem").agg(F.min(F.struct("n", "run"))["run"].alias("run"), F.count("*").alias("found"))
    return rarest.join(held, "run").where(F.col("name").contains(F.col("stem"))).select("stem", "name")


def risky_untested(g: CodeGraph, commits: int = 5) -> DataFrame:
    """Often changed source files whose stem no test's base name holds."""
    files = g.files.select("file_path", stem_of(F.col("file_path")).alias("stem"), basename(F.col("file_path")).alias("name"))
    tests = files.where(is_test(F.col("file_path"))).select("name").distinct()
    busy = commit_counts(g).where(F.col("commits") >= commits).select(F.col("path").alias("file_path"), "commits")
    own = files.where(~is_test(F.col("file_path"))).join(busy, "file_path")
    return own.join(holders(own.select("stem").distinct(), tests), "stem", "left_anti").select("file_path", "commits")


def modules(g: CodeGraph) -> DataFrame:
    """Files, symbols and lines of each module, and the largest exports."""
    module = module_of(F.col("file_path"))
    rows = g.symbols.withColumn("module", module)
    top = rows.where("exported").withColumn("r", F.row_number().over(W.partitionBy("module").orderBy(F.desc(_lines()), "id"))).where("r <= 5")
    names = top.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("exports"))
    languages = F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")
    return rows.groupBy("module").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"), F.sum(_lines()).alias("lines"), languages).join(names, "module", "left")


def module_uses(g: CodeGraph) -> DataFrame:
    """Imports and calls between modules: source, target, imports, calls."""
    def pairs(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        return df.select(module_of(F.col(a)).alias("source"), module_of(F.col(b)).alias("target")).where("source <> target").groupBy("source", "target").agg(F.count("*").alias(name))

    return pairs(g.imports, "source_id", "target_id", "imports").join(pairs(g.calls, "source_file", "target_file", "calls"), ["source", "target"], "full").na.fill(0)


def module_edges(g: CodeGraph) -> DataFrame:
    """Imports and calls between modules: source, target, imports, calls, mutual."""
    rows = module_uses(g)
    back = rows.select(F.col("source").alias("target"), F.col("target").alias("source"), F.lit(True).alias("mutual"))
    return rows.join(back, ["source", "target"], "left").na.fill(False, ["mutual"])


def module_hubs(g: CodeGraph, modules: int = 2, edges: int = 10) -> DataFrame:
    """Modules that at least so many others use by at least so many imports and calls: module, dependents, edges."""
    rows = module_edges(g).groupBy(F.col("target").alias("module")).agg(F.count("*").alias("dependents"), F.sum(F.col("imports") + F.col("calls")).alias("edges"))
    return rows.where((F.col("dependents") >= modules) & (F.col("edges") >= edges))


def live_coupling(g: CodeGraph, share: float = 0.5) -> DataFrame:
    """Pairs of modules with two or more pairs of files that change together at least that share of the time: a, b, pairs, leads.

    Files are those of the graph, modules those that use or are used by another;
    leads: the module that the other one uses, whose changes ask for the other's;
    null where both use each other or neither does.
    """
    at = step_folder(g.edges.sparkSession)
    held = g.files.select("file_path")
    rows = cochange(g).where(F.col("frequency") >= share).select(F.least("path", "partner").alias("a"), F.greatest("path", "partner").alias("b")).distinct()
    for end in "ab":
        rows = rows.join(held.withColumnRenamed("file_path", end), end, "left_semi")
    rows = rows.select(module_of(F.col("a")).alias("x"), module_of(F.col("b")).alias("y")).where("x <> y")
    rows = rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("pairs")).where("pairs >= 2")
    # read four times: written, so that imports and calls are counted once
    uses = written(module_uses(g).select("source", "target"), f"{at}/uses")
    used = uses.select(F.explode(F.array("source", "target")).alias("module")).distinct()
    for end in "ab":
        rows = rows.join(used.withColumnRenamed("module", end), end, "left_semi")
    rows = rows.join(uses.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("_ab")), ["a", "b"], "left")
    rows = rows.join(uses.select(F.col("source").alias("b"), F.col("target").alias("a"), F.lit(True).alias("_ba")), ["a", "b"], "left")
    leads = F.when(F.col("_ab").isNotNull() & F.col("_ba").isNull(), F.col("b")).when(F.col("_ba").isNotNull() & F.col("_ab").isNull(), F.col("a"))
    return rows.select("a", "b", "pairs", leads.alias("leads"))


def noisy_modules(g: CodeGraph) -> DataFrame:
    """Modules with many files and few edges to others, and how they look."""
    files = g.files.groupBy(module_of(F.col("file_path")).alias("module")).agg(F.count("*").alias("files"))
    known = g.calls.select(module_of(F.col("source_file")).alias("x"), module_of(F.col("target_file")).alias("y")).where("x <> y")
    cross = known.select(F.explode(F.array("x", "y")).alias("module")).groupBy("module").agg(F.count("*").alias("edges"))
    total = files.agg(F.sum("files").alias("total"))
    rows = files.join(cross, "module", "left").na.fill(0, ["edges"]).join(F.broadcast(total))  # total is one row
    noisy = ((F.col("files") >= 10) & (F.col("edges") == 0)) | ((F.col("files") >= 20) & (F.col("edges") < 3) & (F.col("files") > 0.2 * F.col("total")))
    return rows.select("module", "files", "edges", noisy.alias("noisy"))


# Folders that a quality score leaves out, and the style of function names by language.
ASIDE = ("archive/", "bench/", "node_modules/", ".git/", "dist/", "build/")
STYLES = {"python": "snake", "typescript": "camel", "javascript": "camel"}


def naming(g: CodeGraph) -> DataFrame:
    """language, functions, conforming: functions of languages with a style that keep to it: snake_case in lower case, or a small first letter and a capital later."""
    name = F.col("name")
    snake = name.contains("_") & (name == F.lower(name))
    camel = name.rlike(r"^\p{Ll}") & F.substring(name, 2, 1 << 20).rlike(r"\p{Lu}")
    rows = g.symbols.where((F.col("kind") == "function") & F.col("language").isin(*STYLES))
    return rows.groupBy("language").agg(F.count("*").alias("functions"), F.count_if(F.when(F.col("language").isin(*[x for x, s in STYLES.items() if s == "snake"]), snake).otherwise(camel)).alias("conforming"))


def quality(g: CodeGraph) -> DataFrame:
    """One row of scores of 0 to 100: minimality by dead code, simplicity by mean complexity (of symbols that have any), independence by files with more than 20 importers, convention by names, and their mean, rounded down.

    Dead and exported symbols of folders put aside don't count; languages of fewer
    than three functions have no say on names, and without any the score is 80.
    """
    aside = F.lit(False)
    for folder in ASIDE:
        aside = aside | F.col("file_path").startswith(folder)
    dead = dead_confidence(g).where("confidence >= 50").join(g.symbols.where(~aside).select("id"), "id", "left_semi").agg(F.count("*").alias("dead"))
    own = g.symbols.agg(F.count_if(F.col("exported") & ~aside).alias("exported"), F.avg(F.when(F.col("complexity") > 0, F.col("complexity"))).alias("cx"))
    used = g.imports.groupBy("target_id").count().agg(F.count_if(F.col("count") > 20).alias("busy"))
    files = g.files.agg(F.count("*").alias("files"))
    share = F.when(F.col("functions") >= 3, F.col("conforming") / F.col("functions"))
    names = naming(g).agg(F.avg(share).alias("share"))
    less = lambda x: F.greatest(F.lit(0), 100 - trunc(x)).cast("long")
    row = dead.join(own).join(used).join(files).join(names)  # each is one row
    row = row.select(
        less(200.0 * F.col("dead") / F.greatest("exported", F.lit(1))).alias("minimality"), less(3.0 * F.coalesce("cx", F.lit(0.0))).alias("simplicity"),
        less(500.0 * F.col("busy") / F.greatest("files", F.lit(1))).alias("independence"), F.coalesce(F.least(F.lit(100), trunc(110.0 * F.col("share"))), F.lit(80)).cast("long").alias("convention"),
    )
    return row.withColumn("score", F.expr("(minimality + simplicity + independence + convention) div 4"))


def families(g: CodeGraph, n: int = 20) -> DataFrame:
    """Functions and methods by the first part of their names."""
    prefix = F.regexp_extract("name", "^([A-Za-z]+)_", 1)
    rows = g.symbols.where(F.col("kind").isin("function", "method")).withColumn("prefix", prefix).where("prefix <> ''")
    return rows.groupBy("prefix").agg(F.count("*").alias("members"), F.countDistinct("name").alias("names")).where("members >= 2 and names > 1").orderBy(F.desc("members"), "prefix").limit(n)


def size_classes(g: CodeGraph) -> DataFrame:
    """Functions and methods by length, with their mean complexity."""
    size = F.when(_lines() <= 5, "tiny").when(_lines() <= 20, "small").when(_lines() <= 50, "medium").when(_lines() <= 150, "large").otherwise("huge")
    return g.symbols.where(F.col("kind").isin("function", "method")).groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 6).alias("avg_cx"))


def top_symbols(g: CodeGraph, n: int = 8) -> DataFrame:
    """The first symbols of each file, classes first, then by line."""
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "component", 1).otherwise(2)
    order = W.partitionBy("file_path").orderBy(rank, "line_start", "id")
    return g.symbols.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("file_path", "r", "id")


def token_budget(g: CodeGraph, budget: int = 4000) -> DataFrame:
    """Files in path order for as long as a running estimate of their tokens, one each at least, stays within a budget, for each module.

    So a module shows at most as many files as the budget has tokens; the others
    are left out before its files meet in one task.
    """
    tokens = F.greatest(F.ceil(F.coalesce("byte_size", F.lit(0)) / 400), F.lit(1)).cast("long")
    order = W.partitionBy("module").orderBy("file_path")
    rows = g.files.select("file_path", module_of(F.col("file_path")).alias("module"), tokens.alias("tokens"))
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget).drop("_r")
    running = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("running", running).where(F.col("running") <= budget)


def complexity_distribution(g: CodeGraph) -> DataFrame:
    """n, mean, median, p90, most: complexity of functions outside of tests; top_share: what the three densest files hold of all."""
    rows = g.symbols.where(~is_test(F.col("file_path")) & (F.col("complexity") >= 1))
    files = rows.groupBy("file_path").agg(F.sum("complexity").alias("cx"))
    top = files.orderBy(F.desc("cx"), "file_path").limit(3).agg(F.sum("cx").alias("_top")).crossJoin(files.agg(F.sum("cx").alias("_all")))  # one row each
    points = {"median": F.percentile("complexity", F.lit(0.5)), "p90": F.percentile("complexity", F.lit(0.9)), "mean": F.avg("complexity")}
    own = rows.where(F.col("kind").isin("function", "method")).agg(F.count("*").alias("n"), F.max("complexity").alias("most"), *[F.round(e, 6).alias(n) for n, e in points.items()])
    return own.crossJoin(top).withColumn("top_share", F.round(F.col("_top") / F.col("_all"), 6)).drop("_top", "_all")  # one row each
