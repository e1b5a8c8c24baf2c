"""Iterative graph operators: layers, cycles, cascades, reach and focus."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_test
from ..model import CodeGraph
from ..session import step_folder, written
from .components import peeled

# Files whose names are brought to all tasks, and imports for each task that halves of cycles meet in.
HELD, MET = 250_000, 1_000


def layers(g: CodeGraph) -> DataFrame:
    """file_path, layer: files without imports are layer 0, others one above the highest that they import; files in or above cycles share one last layer."""
    return peeled(g.imports).select(F.col("node").alias("file_path"), "layer")


def cycles(g: CodeGraph, longest: int = 4) -> DataFrame:
    """Elementary import cycles of up to longest files, each from its smallest file: cycle, length.

    Paths only go through files greater than that one, so each cycle is found
    once.  A cycle is the way out, half of it rounded up, and the way back; they
    meet by first and last file, so no path longer than half a cycle is shuffled,
    and that as numbers in the order of paths.  Halves are named where they meet.
    """
    at = step_folder(g.edges.sparkSession)
    rows = written(g.imports.where("source_id <> target_id").select(F.col("source_id").alias("x"), F.col("target_id").alias("y")), f"{at}/edges")
    names = rows.select(F.col("x").alias("name")).union(rows.select("y")).distinct().orderBy("name").withColumn("k", F.monotonically_increasing_id())
    names = written(names, f"{at}/names")
    names = F.broadcast(names) if names.count() <= HELD else names
    for c in "xy":
        rows = rows.join(names.select(F.col("name").alias(c), F.col("k").alias(f"{c}k")), c)
    edges = written(rows.select(F.col("xk").alias("x"), F.col("yk").alias("y")), f"{at}/numbers")
    parts = max(1, math.ceil(edges.count() / MET))

    def free(c: str, *used: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c) != F.col(u) for u in used], F.lit(True))

    def met(half: DataFrame, *given: str) -> DataFrame:
        """half dealt out by its ends, with the names of given columns."""
        half = half.repartition(parts, "first", "last")
        for c in given:
            half = half.join(names.select(F.col("k").alias(c), F.col("name").alias(f"{c}_")), c)
        return half

    # inner files of the ways in their order: o1, o2, ... and b1, b2, ...
    inner = lambda c, n: [f"{c}{i}" for i in range(1, n)]
    out = {1: edges.where("y > x").select(F.col("x").alias("first"), F.col("y").alias("last"))}
    back = {1: edges.where("x > y").select(F.col("y").alias("first"), F.col("x").alias("last"))}
    for n in range(2, (longest + 1) // 2 + 1):
        on = out[n - 1].join(edges, F.col("last") == F.col("x")).where((F.col("y") > F.col("first")) & free("y", *inner("o", n - 1)))
        out[n] = on.select("first", *inner("o", n - 1), F.col("last").alias(f"o{n - 1}"), F.col("y").alias("last"))
        on = back[n - 1].join(edges, F.col("last") == F.col("y")).where((F.col("x") > F.col("first")) & free("x", *inner("b", n - 1)))
        back[n] = on.select("first", F.col("last").alias("b1"), *[F.col(f"b{i}").alias(f"b{i + 1}") for i in range(1, n - 1)], F.col("x").alias("last"))
    found = None
    for n in range(2, longest + 1):
        o, b = inner("o", n - n // 2), inner("b", n // 2)
        both = met(out[n - n // 2], "first", *o, "last").join(met(back[n // 2], *b), ["first", "last"])
        both = both.where(reduce(lambda a, c: a & c, [free(c, *o) for c in b], F.lit(True)))
        rows = both.select(F.concat_ws(" > ", *[f"{c}_" for c in ("first", *o, "last", *b)]).alias("cycle"), F.lit(n).alias("length"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _spread(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, node, hops: nodes within depth steps of each root along edges (x, y), at their least number of hops."""
    at = step_folder(edges.sparkSession)
    edges = written(edges, f"{at}/edges")
    seen = written(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")), f"{at}/seen0")
    front = seen
    for i in range(1, depth + 1):
        new = front.join(edges, F.col("node") == F.col("x")).select("root", F.col("y").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(i))
        front = written(new, f"{at}/front{i}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _reached(edges: DataFrame, depth: int, most: int) -> DataFrame:
    """root, node, hops: what each root reaches along edges (x, y) within depth steps, exactly as long as it is fewer than most nodes, and at least most else.

    Each node holds what it reaches in exactly so many hops, the first by id; a
    node's next ones are its neighbours' last ones that it hasn't seen.  So a hop
    reads each edge once with most + 2 rows at most, whatever the hubs.  Nodes that
    hold enough grow no more: whoever points at them has enough with what they hold.
    """
    at = step_folder(edges.sparkSession)
    room = most + 2
    edges = written(edges.where("x <> y").distinct(), f"{at}/edges")
    first = W.partitionBy("root").orderBy("node")
    limited = lambda rows: rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= room).drop("_r")
    seen = front = written(limited(edges.select(F.col("x").alias("root"), F.col("y").alias("node"))).withColumn("hops", F.lit(1)), f"{at}/hop1")
    for i in range(2, depth + 1):
        full = seen.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") >= room).select(F.col("root").alias("x"))
        pulled = edges.join(full, "x", "left_anti").join(front.select(F.col("root").alias("y"), "node"), "y").where("node <> x")
        next_ = pulled.select(F.col("x").alias("root"), "node").distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = written(limited(next_).withColumn("hops", F.lit(i)), f"{at}/hop{i}")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), f"{at}/seen{i}")
    return seen


def cascade(g: CodeGraph, depth: int = 5, most: int | None = None) -> DataFrame:
    """Files that import a file, directly or not: root, hops, files.

    With most, nearest first and most of them at most, and only of files that have importers of importers.
    """
    edges = g.imports.select(F.col("target_id").alias("x"), F.col("source_id").alias("y"))
    if most is None:
        return _spread(g.files.select(F.col("file_path").alias("root")), edges, depth).where("hops > 0").groupBy("root", "hops").agg(F.count("*").alias("files"))
    levels = _reached(edges, depth, most).groupBy("root", "hops").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("root").orderBy("hops").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = levels.withColumn("files", F.least("n", most - before)).where("files > 0")
    return rows.withColumn("_deep", F.max("hops").over(W.partitionBy("root"))).where("_deep > 1").select("root", "hops", "files")


def upstream(g: CodeGraph, depth: int = 4, most: int = 200) -> DataFrame:
    """Callers outside tests within depth hops: root, direct, reach (most at most), capped, and whether few direct callers (up to 8) stand for a wide reach (20 symbols and four times the direct ones)."""
    edges = g.calls.where(~is_test(F.col("source_file"))).select(F.col("target_id").alias("x"), F.col("source_id").alias("y"))
    direct = edges.where("x <> y").groupBy(F.col("x").alias("root")).agg(F.count("*").alias("direct"))
    reach = _reached(edges, depth, most).groupBy("root").agg(F.least(F.count("*"), F.lit(most)).alias("reach"))
    rows = direct.join(reach, "root").withColumn("capped", F.col("reach") >= most)
    return rows.withColumn("shown", (F.col("direct") <= 8) & (F.col("reach") >= 20) & (F.col("reach") >= 4 * F.col("direct")))


def inheritance_depth(g: CodeGraph, most: int = 60) -> DataFrame:
    """id, depth: the longest chain of supertypes above each class; chains are cut at most steps."""
    at = step_folder(g.edges.sparkSession)
    edges = written(g.pairs("inherits").select(F.col("source_id").alias("id"), F.col("target_id").alias("base")), f"{at}/edges")
    level = edges.select("id").distinct().withColumn("depth", F.lit(1))
    front = edges
    out = level
    for i in range(2, most + 1):
        step = edges.select(F.col("id").alias("_m"), F.col("base").alias("_b"))
        front = written(front.join(step, F.col("base") == F.col("_m")).select("id", F.col("_b").alias("base")).distinct(), f"{at}/front{i}")
        if front.isEmpty():
            break
        out = out.unionByName(front.select("id").distinct().withColumn("depth", F.lit(i)))
    return out.groupBy("id").agg(F.max("depth").alias("depth"))


def call_triangles(g: CodeGraph) -> DataFrame:
    """Three differing symbols outside tests that call each other in a ring, from the smallest: a, b, c."""
    e = g.calls.where("source_id <> target_id").where(~is_test(F.col("source_file")) & ~is_test(F.col("target_file"))).select("source_id", "target_id")
    ab, bc, ca = (e.select(F.col("source_id").alias(x), F.col("target_id").alias(y)) for x, y in ("ab", "bc", "ca"))
    return ab.where("b > a").join(bc, "b").where("c > a and c <> b").join(ca, ["c", "a"]).select("a", "b", "c")


def mutual_recursion(g: CodeGraph) -> DataFrame:
    """Symbols that call themselves, or each other: a, b."""
    e = g.calls.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return e.where("a <= b").join(back, ["a", "b"], "left_semi")


def brokers(g: CodeGraph) -> DataFrame:
    """Symbols between files: non-test callers and callees in other files, and the role that their numbers make."""
    cross = g.calls.where("source_file <> target_file")
    up = cross.where(~is_test(F.col("source_file"))).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    down = cross.where(~is_test(F.col("target_file"))).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    rows = up.join(down, "id", "full").na.fill(0)
    role = F.when((F.col("callers") >= 5) & (F.col("callees") >= 5), "broker").when((F.col("callees") >= 6) & F.col("callers").between(1, 4), "orchestrator")
    return rows.withColumn("role", role).where("role is not null")


def sole_use(g: CodeGraph) -> DataFrame:
    """Functions and methods with one caller outside tests: id, caller."""
    callers = g.calls.where(~is_test(F.col("source_file"))).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"), F.min("source_id").alias("caller"))
    return g.symbols.where(F.col("kind").isin("function", "method")).select("id").join(callers.where("n = 1"), "id").select("id", "caller")


def hub_callees(g: CodeGraph, least: int = 3) -> DataFrame:
    """Callees with at least so many distinct caller files outside tests."""
    return g.calls.where((F.col("source_file") != F.col("target_file")) & ~is_test(F.col("source_file"))).groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_file").alias("files")).where(F.col("files") >= least)


def apex(g: CodeGraph, depth: int = 5, fan: int = 8) -> DataFrame:
    """The nearest caller up the chain that nothing outside tests calls, for functions and methods: root, hops, apex, path (ids from root to it) and line.

    A symbol that nothing calls is its own entry; one that only tests call has no
    row; where none is found within depth hops, hops is null.  Of each symbol's
    callers the first fan by id are followed; of equally near ends the first by id
    counts, and of equal ways to it the first caller.  The ends pass their names
    down, so each hop reads each call once, whatever the number of roots.
    """
    at = step_folder(g.edges.sparkSession)
    every = g.calls.select("target_id", "source_id", is_test(F.col("source_file")).alias("_test"))
    called = every.groupBy(F.col("target_id").alias("id")).agg(F.bool_or(~F.col("_test")).alias("_real"))
    nodes = written(g.symbols.select("id", "name", "kind").join(called, "id", "left"), f"{at}/nodes")
    order = W.partitionBy("target_id").orderBy("source_id")
    edges = written(every.where(~F.col("_test")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fan).select("target_id", "source_id"), f"{at}/edges")
    front = nodes.where(~F.coalesce("_real", F.lit(False))).select("id", F.col("id").alias("apex"), F.array("id").alias("path"), F.lit(0).alias("hops"))
    seen = front = written(front, f"{at}/hop0")
    for i in range(1, depth + 1):
        told = edges.join(front.select(F.col("id").alias("source_id"), "apex", "path"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min(F.struct("apex", "source_id", "path")).alias("_b"))
        new = told.join(seen.select("id"), "id", "left_anti").select("id", "_b.apex", F.concat(F.array("id"), "_b.path").alias("path"), F.lit(i).alias("hops"))
        front = written(new, f"{at}/hop{i}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    # symbols that only tests call end no chain that they begin
    roots = nodes.where(F.col("kind").isin("function", "method") & F.coalesce("_real", F.col("_real").isNull())).select(F.col("id").alias("root"), "_real")
    rows = roots.join(seen.withColumnRenamed("id", "root"), "root", "left").join(nodes.select(F.col("id").alias("apex"), F.col("name").alias("_name")), "apex", "left")
    said = F.when(F.col("_real").isNull(), "self [entry]").when(F.col("hops").isNull(), F.lit(f"{depth}+ hops"))
    said = said.otherwise(F.concat("_name", F.lit(" ["), F.col("hops").cast("string"), F.when(F.col("hops") == 1, " hop]").otherwise(" hops]")))
    return rows.select("root", "hops", "apex", "path", F.concat(F.lit("apex: "), said).alias("line"))


def orphan_cascade(g: CodeGraph, least: int = 2) -> DataFrame:
    """Symbols whose only-theirs callees have only-theirs callees in turn, least of them or more: root, helpers (both together), deeper, via (the first three of the callees, by name)."""
    real = g.calls.where(~is_test(F.col("source_file")))
    sole = real.groupBy(F.col("target_id").alias("id"), F.col("target_file")).agg(F.count("*").alias("_n"), F.min("source_id").alias("owner")).where("_n = 1")
    kinds = g.symbols.where(F.col("kind").isin("function", "method")).select("id", "name")
    sole = sole.join(kinds, "id").where("id <> owner")
    inner = sole.where(~is_test(F.col("target_file"))).groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("_deeper"))
    rows = sole.select("id", "owner", "name").join(inner, "id", "left").groupBy(F.col("owner").alias("root"))
    made = rows.agg(F.count("*").alias("_own"), F.sum("_deeper").alias("deeper"), F.array_sort(F.collect_set(F.when(F.col("_deeper") > 0, F.col("name")))).alias("_via"))
    return made.where(F.col("deeper") >= least).select("root", (F.col("_own") + F.col("deeper")).alias("helpers"), "deeper", F.array_join(F.slice("_via", 1, 3), ", ").alias("via"))


def orphaned(g: CodeGraph, removed: DataFrame) -> DataFrame:
    """id, wave: functions and methods that nothing outside tests calls any more once removed (id) are gone: wave by wave, as their last caller goes.

    Each symbol has a count of callers left; a wave takes off what its own symbols called.
    """
    at = step_folder(g.edges.sparkSession)
    real = written(g.calls.where(~is_test(F.col("source_file"))).where("source_id <> target_id").select("source_id", "target_id"), f"{at}/calls")
    kinds = g.symbols.where(F.col("kind").isin("function", "method")).select("id")
    left = written(real.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).join(kinds, "id", "left_semi"), f"{at}/left0")
    front, i = written(removed.select("id").distinct(), f"{at}/gone0"), 0
    out = front.withColumn("wave", F.lit(0))
    while not front.isEmpty():
        i += 1
        less = real.join(front.select(F.col("id").alias("source_id")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("_less"))
        counted = left.join(out.select("id"), "id", "left_anti").join(less, "id", "left").select("id", (F.col("n") - F.coalesce("_less", F.lit(0))).alias("n"))
        left = written(counted, f"{at}/left{i}")
        front = left.where("n = 0").select("id")
        out = out.unionByName(front.withColumn("wave", F.lit(i)))
    return out.where("wave > 0")


def import_depth(g: CodeGraph, starts: DataFrame, most: int = 12) -> DataFrame:
    """root, depth: the most hops from each start up its importers, tests aside, along shortest paths."""
    edges = g.imports.where(~is_test(F.col("source_id")) & ~is_test(F.col("target_id"))).select(F.col("target_id").alias("x"), F.col("source_id").alias("y"))
    return _spread(starts, edges, most).groupBy("root").agg(F.max("hops").alias("depth"))


def beyond_focus(g: CodeGraph, shown: DataFrame, seed: str, least: int = 12, most: int = 2) -> DataFrame:
    """Entry-like or exported callers of a much-called seed that a focus (id) doesn't show: id."""
    callers = g.calls.where((F.col("target_id") == seed) & ~is_test(F.col("source_file"))).select(F.col("source_id").alias("id"))
    enough = callers.agg((F.count("*") > least).alias("_many"))
    rows = g.symbols.where("parent_id is null").join(callers, "id", "left_semi").join(shown.select("id"), "id", "left_anti")
    entry = F.col("name").isin("main", "run", "cli", "start") | F.col("file_path").endswith("__main__.py") | F.col("exported")
    return rows.where(entry).join(F.broadcast(enough)).where("_many").orderBy("id").limit(most).select("id")  # enough is one row
