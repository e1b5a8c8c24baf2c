"""What changes touch and whom they reach, for any number of changes (change, path) at once.

Files have numbers in the order of their paths, and each file and symbol is summed
up once.  The files of changes are dealt out by change, a bounded number to a task;
what files hold is brought to them, so that nothing that a file multiplies is
shuffled.  Calls within a change are found by its pairs of files, and of what is
listed only those files are opened that the first rows lie in.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import basename, is_test, module_of
from ..model import CodeGraph
from ..session import ship, step_folder, written
from .structure import holders, stem_of

# Kinds listed by name, kinds that want tests, and the points of a change's risk.
NAMED, TESTED = ("function", "method", "class", "interface"), ("function", "method", "class")
HIGH, MEDIUM, EACH = 16, 6, 3
#: Rows of changes in a task, rows of a table that is brought to all tasks at most, and files of a change whose pairs are made.
PART, HELD, WIDE = 25_000, 250_000, 64
#: Words of 64 files that a row of bits has, and rows of a few numbers that are brought to all tasks at once.
WORDS, NARROW = 8, 500_000
#: Numbers of a matrix that a Python worker holds at most.
DENSE = 2_000_000


def _table(df: DataFrame, at: str) -> DataFrame:
    """df, written; brought to all tasks where it has HELD rows at most."""
    rows = written(df, at)
    return F.broadcast(rows) if rows.count() <= HELD else rows


def _numbered(g: CodeGraph, at: str) -> DataFrame:
    """f, file_path, test: files with numbers without gaps in the order of their paths."""
    rows = g.files.select("file_path").where("file_path is not null").orderBy("file_path").withColumn("_m", F.monotonically_increasing_id())
    # the number holds its task above 33 bits, and the row within it below
    rows = written(rows.select("file_path", F.shiftright("_m", 33).alias("_task"), F.expr("_m & 8589934591L").alias("_row")), f"{at}/by_task")
    before = rows.groupBy("_task").agg(F.count("*").alias("_k")).select("_task", (F.sum("_k").over(W.orderBy("_task")) - F.col("_k")).alias("_before"))
    return _table(rows.join(F.broadcast(before), "_task").select((F.col("_before") + F.col("_row")).cast("int").alias("f"), "file_path", is_test(F.col("file_path")).alias("test")), f"{at}/files")


class _Changes:
    """The files (change, f) of changes that the graph holds, dealt out by change; small ones have WIDE files at most."""

    def __init__(self, changes: DataFrame, files: DataFrame, at: str):
        rows = changes.where("change is not null").select("change", F.col("path").alias("file_path")).join(files, "file_path").select("change", "f").distinct()
        rows = written(rows, f"{at}/known")
        self.parts = parts = max(1, math.ceil(rows.count() / PART))
        self.all = rows.repartition(parts, "change")
        sizes = rows.groupBy("change").agg(F.count("*").alias("_k")).where(F.col("_k") > WIDE).select("change")
        large = written(sizes, f"{at}/large")
        self.some_large = not large.isEmpty()
        self.large = rows.join(large, "change", "left_semi")
        self.small = rows.join(large, "change", "left_anti").repartition(parts, "change") if self.some_large else self.all

    def sets(self) -> DataFrame:
        """change, _fs: the files of small changes in one row."""
        return self.small.groupBy("change").agg(F.collect_list("f").alias("_fs"))

    def whole(self, ties: DataFrame, at: str, how: str = "inner") -> DataFrame:
        """change, f, whole: how many of its items ties (f, g, ord, n, every, by) tie to files g of the change only, for files with such items, or all (how: left); by: the files that an item is tied to, every: the sum of n.

        Items of a file that are tied to the same files are one row.  It is looked up by the first
        of these files, so that a pair of files gives a row for each such set and not for each item.
        """
        alike = ties.where(F.col("by") <= WIDE).groupBy("f", "ord").agg(F.sort_array(F.collect_list("g")).alias("_g")).groupBy("f", "_g").agg(F.count("*").alias("n"))
        alike = written(alike.select("f", F.get("_g", F.lit(0)).alias("g"), F.slice("_g", 2, WIDE).alias("more"), "n"), f"{at}/alike")
        parts = max(1, math.ceil(alike.count() / NARROW))
        each = self.sets().select("change", "_fs", F.explode("_fs").alias("f"))
        second = F.get("more", F.lit(0))
        rest = second.isNull() | F.array_contains("_fs", second) & (F.size(F.array_except("more", "_fs")) == 0)

        def part(k: int) -> DataFrame:
            mine = F.pmod(F.hash("f"), F.lit(parts)) == k
            pairs = each.where(mine).select("change", "_fs", "f", F.explode("_fs").alias("g"))
            rows = pairs.join(F.broadcast(alike.where(mine)), ["f", "g"], how).withColumn("n", F.when(rest, F.col("n")))
            return (rows.where("n is not null") if how == "inner" else rows).groupBy("change", "f").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))

        found = part(0) if parts == 1 else reduce(DataFrame.unionByName, [written(part(k), f"{at}/whole{k}") for k in range(parts)])
        if self.some_large:
            tied = self.large.withColumnRenamed("f", "g").join(ties.select("f", "g", "ord", "n", "every"), "g").groupBy("change", "f", "ord").agg(F.sum("n").alias("n"), F.max("every").alias("every"))
            tied = tied.where("n >= every").groupBy("change", "f").agg(F.count("*").alias("whole"))
            found = found.unionByName(self.large.join(tied, ["change", "f"], how).select("change", "f", F.coalesce("whole", F.lit(0)).alias("whole")))
        return found

    def listed(self, own: DataFrame, items: DataFrame, most: int, at: str, ties: DataFrame | None = None) -> DataFrame:
        """change, item, n, r, total: the first items (f, ord, item, every) of each change that aren't whole within it; own: f and the number of its items, from 1 in ord.

        A change opens most files at most, and of a file the first items are looked at:
        most, and as many more as are whole in any change.
        """
        rows, deep = self.all.withColumn("whole", F.lit(0)), F.lit(0)
        if ties is not None:
            rows = written(self.whole(ties, at, "left"), f"{at}/whole")
            deepest = F.broadcast(rows.groupBy("f").agg(F.max("whole").alias("_deep")).where("_deep > 0"))
            items, ties = (_table(x.join(deepest, "f", "left").where(F.col("ord") <= most + F.coalesce("_deep", F.lit(0))).drop("_deep"), f"{at}/first_{k}") for k, x in enumerate((items, ties)))
            rows = rows.repartition(self.parts, "change")
        rows = rows.join(own, "f").withColumn("_left", F.col("own") - F.col("whole")).where("_left > 0")
        by = W.partitionBy("change")
        rows = rows.withColumn("total", F.sum("_left").over(by)).withColumn("_before", F.coalesce(F.sum("_left").over(by.orderBy("f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.where(F.col("_before") < most).select("change", "f", "whole", "total", "_before")
        n, shift = F.col("every"), F.lit(0)
        if ties is not None:
            kept = [F.first(c).alias(c) for c in ("whole", "total", "_before")]
            each = rows.join(self.all.select("change", F.col("f").alias("g")), "change").join(ties.select("f", "g", "ord", "n", "every"), ["f", "g"], "left")
            each = each.groupBy("change", "f", "ord").agg(F.sum("n").alias("n"), F.max("every").alias("every"), *kept)
            item = F.when(F.col("ord").isNotNull(), F.struct("ord", "n", (F.col("n") >= F.col("every")).alias("whole")))
            rows = each.groupBy("change", "f").agg(F.collect_list(item).alias("ins"), *kept)
            mine = F.get(F.filter("ins", lambda x: x["ord"] == F.col("ord")), F.lit(0))
            some = F.size("ins") > 0
            n = F.when(some, n - F.coalesce(mine["n"], F.lit(0))).otherwise(n)
            shift = F.when(some, F.size(F.filter("ins", lambda x: x["whole"] & (x["ord"] < F.col("ord"))))).otherwise(0)
        rows = rows.join(items, "f").where(F.col("ord") <= most - F.col("_before") + F.col("whole"))
        rows = rows.select("change", "item", n.alias("n"), (F.col("_before") + F.col("ord") - shift).cast("int").alias("r"), "total")
        return rows.where((F.col("r") <= most) & (F.col("n") > 0))


def _importers(g: CodeGraph, files: DataFrame) -> DataFrame:
    """f, i: files of the graph that import a file, itself aside."""
    rows = g.imports.where("source_id <> target_id").join(files.select(F.col("f"), F.col("file_path").alias("target_id")), "target_id")
    return rows.join(files.select(F.col("f").alias("i"), F.col("file_path").alias("source_id")), "source_id").select("f", "i")


def _bits(pairs: DataFrame, at: str) -> DataFrame:
    """The files i of each f of pairs (f, i) as bits: f, block of WORDS words, w0, w1 and so on."""
    word = lambda j: F.bit_or(F.when(F.shiftright("i", 6) % WORDS == j, F.expr("shiftleft(1L, i & 63)"))).alias(f"w{j}")
    return _table(pairs.groupBy("f", F.floor(F.col("i") / (64 * WORDS)).cast("int").alias("block")).agg(*[word(j) for j in range(WORDS)]), at)


def _outside(sets: _Changes, bits: DataFrame, files: DataFrame, most: int, at: str) -> DataFrame:
    """change, i, r, total: the first files i outside of a change that bits has for its files."""
    words, own = ([f"{c}{j}" for j in range(WORDS)] for c in "wo")
    either = [F.bit_or(c).alias(c) for c in words + own]
    # a file's row has its own bit too, among those that don't count
    mine = [F.when(F.shiftright("f", 6) % WORDS == j, F.expr("shiftleft(1L, f & 63)")).alias(o) for j, o in enumerate(own)]
    table = bits.unionByName(files.select("f", F.floor(F.col("f") / (64 * WORDS)).cast("int").alias("block"), *mine), allowMissingColumns=True).groupBy("f", "block").agg(*either)
    rows = sets.all.join(_table(table, at), "f").groupBy("change", "block").agg(*either)
    left = [F.coalesce(w, F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce(o, F.lit(0)))).alias(w) for w, o in zip(words, own)]
    rows = rows.select("change", "block", *left).withColumn("_n", sum(F.bit_count(w) for w in words))
    by = W.partitionBy("change")
    rows = rows.where("_n > 0").withColumn("total", F.sum("_n").over(by)).withColumn("_before", F.sum("_n").over(by.orderBy("block")) - F.col("_n")).where(F.col("_before") < most)
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.col(w).alias("w"), sum((F.bit_count(x) for x in words[:j]), F.col("_before")).alias("before")) for j, w in enumerate(words)])
    rows = rows.select("change", "block", "total", F.inline(each)).where((F.col("w") != 0) & (F.col("before") < most))
    # a bit's place is the number of bits below it
    at, place = F.expr("w & shiftleft(1L, bit) <> 0"), F.expr("before + bit_count(w & ~shiftleft(-1L, bit)) + 1")
    rows = rows.join(F.broadcast(bits.sparkSession.range(64).select(F.col("id").cast("int").alias("bit"))), at & (place <= most))
    return rows.select("change", ((F.col("block") * WORDS + F.col("j")) * 64 + F.col("bit")).alias("i"), place.cast("int").alias("r"), "total")


def _most(sets: _Changes, counts: DataFrame, most: int) -> DataFrame:
    """change, i, n, r, total: the i of most n in sum over the files of a change, of counts (f, i, _n).

    Where files and their i make a matrix of DENSE numbers at most, the rows of small changes
    are added up in it; else, and for large changes, the counts are joined.
    """

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.join(counts, "f").groupBy("change", "i").agg(F.sum("_n").alias("n")).withColumn("total", F.count("*").over(W.partitionBy("change")))
        return _first(rows, most, F.desc("n"), "i").select("change", "i", "n", "r", "total")

    r = counts.agg(F.count("*"), F.count_distinct("f"), F.count_distinct("i")).first()
    if not r[0] or r[0] > HELD or r[1] * r[2] > DENSE:
        return joined(sets.all)
    held = counts.select("f", "i", F.col("_n").cast("long")).toArrow()
    f, i, n = (held.column(k).to_numpy() for k in range(3))
    known, at_f = np.unique(f, return_inverse=True)
    tests, at_i = np.unique(i, return_inverse=True)

    def summed(batches):
        table = np.zeros((len(known) + 1, len(tests)), np.int64)  # the last row: files without counts
        table[at_f, at_i] = n
        step = max(1, DENSE // (WIDE * len(tests)))
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                fs, sizes = part.column(1).flatten().to_numpy(), part.column(1).value_lengths().to_numpy()
                at = np.searchsorted(known, fs)
                at = np.where(known[np.minimum(at, len(known) - 1)] == fs, at, len(known))
                sums = np.add.reduceat(table[at], np.cumsum(sizes) - sizes, axis=0)
                key = sums * len(tests) + np.arange(len(tests))[::-1]
                if len(tests) > most:
                    key = np.partition(key, len(tests) - most, axis=1)[:, -most:]
                key = -np.sort(-key, axis=1)
                found, total = key // len(tests), (sums > 0).sum(axis=1)
                row, place = np.nonzero(found)
                item = tests[len(tests) - 1 - key[row, place] % len(tests)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(item, pa.int32()), pa.array(found[row, place]), pa.array(place + 1, pa.int32()), pa.array(total[row], pa.int64())], ["change", "i", "n", "r", "total"])

    ship(counts.sparkSession)
    kind = sets.all.schema["change"].dataType.simpleString()
    rows = sets.sets().mapInArrow(summed, f"change {kind}, i int, n long, r int, total long")
    return rows.unionByName(joined(sets.large)) if sets.some_large else rows


def _called(g: CodeGraph, files: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exported symbols that are called: items (f, ord, item, every: calls), how many each file has (f, own), and ties to the files of their callers (by: how many)."""
    calls = g.calls.groupBy(F.col("target_id").alias("id"), F.col("source_file").alias("file_path")).agg(F.count("*").alias("n"))
    calls = written(calls.join(files.select("file_path", F.col("f").alias("g")), "file_path").select("id", "g", "n"), f"{at}/called")
    items = g.symbols.where("exported").select("id", "file_path", "line_start").join(files.select("f", "file_path"), "file_path").join(calls.groupBy("id").agg(F.sum("n").alias("every"), F.count("*").alias("by")), "id")
    items = _table(items.select("f", F.row_number().over(W.partitionBy("f").orderBy("line_start", "id")).alias("ord"), F.col("id").alias("item"), "every", "by"), f"{at}/items")
    ties = _table(calls.join(items.withColumnRenamed("item", "id"), "id").select("f", "g", "ord", "n", "every", "by"), f"{at}/ties")
    return items, _table(items.groupBy("f").agg(F.count("*").alias("own")), f"{at}/own"), ties


def _first(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """rows with r: the first n rows of each change."""
    return rows.withColumn("r", F.row_number().over(W.partitionBy("change").orderBy(*order))).where(F.col("r") <= n)


def _listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """change and the items of few rows with r, in their order, joined by commas."""
    made = F.array_sort(F.collect_list(F.struct("r", item.alias("i"))))
    return rows.groupBy("change").agg(F.array_join(F.transform(made, lambda x: x["i"]), ", ").alias(name))


def summaries(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """One row a change that touches a file of the graph: change, symbols, exported (outside of tests), names, blast, called, risk, folders, scope, top.

    names: exported functions and classes, where there are 2 to 8; blast: files that import a
    changed one; called: exported symbols with callers outside of the change; risk: HIGH
    from 16 points of blast and three times called, MEDIUM from 6, null below; scope: from
    three top folders on, the first five; top: the three most imported files, where two
    have two importers or more.  Null where nothing is to be said.
    """
    at = step_folder(g.edges.sparkSession)
    files = _numbered(g, f"{at}/files")
    sets = _Changes(changes, files, at)
    importers = written(_importers(g, files), f"{at}/importers")
    sizes = importers.groupBy("f").agg(F.count("*").alias("n"))
    _, called_own, ties = _called(g, files, at)
    named = F.col("exported") & F.col("kind").isin(*NAMED)
    counts = g.symbols.groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.count_if(named).alias("_named"))
    facts = files.join(counts, "file_path").join(sizes, "f", "left").join(called_own, "f", "left")
    facts = _table(facts.select("f", "file_path", "test", module_of(F.col("file_path")).alias("folder"), "symbols", "exported", "_named", "n", "own"), f"{at}/facts")
    known = sets.all.join(facts, "f")
    source = lambda c: F.coalesce(F.sum(F.when(~F.col("test"), F.col(c))), F.lit(0)).alias(c)
    own = known.groupBy("change").agg(*[source(c) for c in ("symbols", "exported", "_named", "own")])
    few = own.where("_named between 2 and 8").select("change")
    listed = sets.all.join(facts.where("not test and _named between 1 and 8").select("f", "file_path"), "f").join(few, "change", "left_semi")
    listed = listed.join(_table(g.symbols.where(named).select("file_path", "name", "line_start", "id"), f"{at}/named"), "file_path")
    names = _listed(_first(listed, 8, "file_path", "line_start", "id"), F.col("name"), "names")
    whole = sets.whole(ties, at).join(files.where("not test").select("f"), "f", "left_semi").groupBy("change").agg(F.sum("whole").alias("whole"))
    words = [f"w{j}" for j in range(WORDS)]
    near = sets.all.join(_bits(importers, f"{at}/bits"), "f").groupBy("change", "block").agg(*[F.bit_or(w).alias(w) for w in words])
    blast = near.groupBy("change").agg(F.sum(sum(F.coalesce(F.bit_count(w), F.lit(0)) for w in words)).alias("blast"))
    folders = known.where("not test").groupBy("change", "folder").agg(F.count("*").alias("_n"))
    wide = folders.groupBy("change").agg(F.count("*").alias("folders"))
    scope = _listed(_first(folders.join(wide.where("folders >= 3").select("change"), "change", "left_semi"), 5, "folder"), F.col("folder"), "_scope")
    blasts = known.where("n >= 2").withColumn("_c", F.count("*").over(W.partitionBy("change"))).where("_c >= 2")
    tops = _first(blasts.select("change", "file_path", "n"), 3, F.desc("n"), "file_path")
    top = _listed(tops, F.concat(basename(F.col("file_path")), F.lit(" (blast:"), F.col("n").cast("string"), F.lit(")")), "top")
    rows = own.drop("_named")
    for part in (names, blast, whole, wide, scope, top):
        rows = rows.join(part, "change", "left")
    rows = rows.na.fill(0, ["symbols", "exported", "blast", "whole", "folders"]).withColumn("called", F.col("own") - F.col("whole"))
    points = F.col("blast") + EACH * F.col("called")
    risk = F.when(F.col("symbols") > 0, F.when(points >= HIGH, "HIGH").when(points >= MEDIUM, "MEDIUM"))
    more = F.when(F.col("folders") > 5, F.concat(F.lit(" +"), (F.col("folders") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("change", "symbols", "exported", "names", "blast", "called", risk.alias("risk"), "folders", F.concat("_scope", more).alias("scope"), "top")


def sections(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """change, section, r, item, n, total: the first items of each section of a change, and how many it has.

    external: exported symbols with callers outside (10; n: callers); importer: files outside
    that import a changed one (10); component: changed components and who renders them
    outside (5, by files; total: those listed); test: test files that call a changed symbol
    (5, by calls; n: calls); untested: functions, methods and classes outside of tests that
    no test calls (6); unchanged: tests named after a changed file that aren't changed (3,
    the first by path for each file).
    """
    at = step_folder(g.edges.sparkSession)
    files = _numbered(g, f"{at}/files")
    sets = _Changes(changes, files, at)
    place = files.select("f", "file_path")
    by = W.partitionBy("change")

    def section(name: str, rows: DataFrame, n: Column = F.lit(None), total: Column = F.col("total")) -> DataFrame:
        return rows.select("change", F.lit(name).alias("section"), "r", "item", n.cast("long").alias("n"), total.cast("long").alias("total"))

    def pathed(rows: DataFrame) -> DataFrame:
        """rows with item, the path of file i."""
        return rows.join(place.select(F.col("f").alias("i"), F.col("file_path").alias("item")), "i")

    items, own, ties = _called(g, files, at)
    out = section("external", sets.listed(own, items, 10, f"{at}/external", ties), F.col("n"))

    near = _outside(sets, _bits(_importers(g, files), f"{at}/importers"), files, 10, f"{at}/bits")
    out = out.unionByName(section("importer", pathed(near)))

    syms = g.symbols.select("id", "file_path", "line_start", "kind").join(place, "file_path")
    drawn = g.pairs("renders").select(F.col("target_id").alias("id"), F.col("source_id").alias("by")).join(syms.where("kind = 'component'").select("id", "f", "line_start"), "id")
    drawn = drawn.join(syms.select(F.col("id").alias("by"), F.col("f").alias("g")), "by")
    drawn = drawn.withColumn("ord", F.row_number().over(W.partitionBy("f").orderBy("line_start", "id", "g", "by"))).withColumn("item", F.concat("by", F.lit(" renders "), "id"))
    drawn = _table(drawn.select("f", "g", "ord", "item", *[F.lit(1).cast("long").alias(c) for c in ("n", "every", "by")]), f"{at}/drawn")
    shown = sets.listed(drawn.groupBy("f").agg(F.count("*").alias("own")), drawn.select("f", "ord", "item", "every"), 5, f"{at}/component", drawn.drop("item"))
    out = out.unionByName(section("component", shown, total=F.least("total", F.lit(5))))

    tested = g.calls.where(is_test(F.col("source_file")))
    runs = tested.groupBy(F.col("target_file").alias("file_path"), F.col("source_file").alias("_run")).agg(F.count("*").alias("_n")).join(place, "file_path")
    runs = _table(runs.join(place.select(F.col("f").alias("i"), F.col("file_path").alias("_run")), "_run").select("f", "i", "_n"), f"{at}/runs")
    out = out.unionByName(section("test", pathed(_most(sets, runs, 5)), F.col("n")))

    bare = syms.where(F.col("kind").isin(*TESTED) & ~is_test(F.col("file_path"))).join(tested.select(F.col("target_id").alias("id")), "id", "left_anti")
    bare = written(bare.select("f", F.row_number().over(W.partitionBy("f").orderBy("line_start", "id")).alias("ord"), F.col("id").alias("item"), F.lit(1).alias("every")), f"{at}/bare")
    bare = sets.listed(_table(bare.groupBy("f").agg(F.count("*").alias("own")), f"{at}/bare_own"), _table(bare.where("ord <= 6"), f"{at}/bare_first"), 6, f"{at}/untested")
    out = out.unionByName(section("untested", bare))

    known = files.select("f", "file_path", "test", stem_of(F.col("file_path")).alias("stem"), basename(F.col("file_path")).alias("name"))
    tests = known.where("test").groupBy("name").agg(F.min("file_path").alias("item"))
    first = holders(known.where("not test").select("stem").distinct(), tests.select("name")).join(tests, "name").groupBy("stem").agg(F.min("item").alias("item"))
    named = known.where("not test").join(first, "stem").join(place.select(F.col("f").alias("i"), F.col("file_path").alias("item")), "item").select("f", "i", F.lit(False).alias("own"))
    named = written(named, f"{at}/by_name")
    named = _table(named.unionByName(named.select("i").distinct().select(F.col("i").alias("f"), "i", F.lit(True).alias("own"))), f"{at}/named")
    left = sets.all.join(named, "f").groupBy("change", "i").agg(F.max("own").alias("_own"), F.collect_list("f").alias("_f")).where("not _own").select("change", "i", F.explode("_f").alias("f"))
    left = left.withColumn("total", F.count("*").over(by))
    return out.unionByName(section("unchanged", pathed(_first(left, 3, "f"))))
