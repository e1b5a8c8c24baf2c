"""Sub-graphs about seeds, for any number of labelled seed sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CodeGraph
from ..session import step_folder, written
from .advice import seeds

# Neighbours that one node adds, by way, at depth 0, 1 and further; and the order of ways.
FANOUT = {"callers": (12, 6, 3), "callees": (6, 4, 2), "children": (5, 5, 0), "subtypes": (5, 3, 0), "renderers": (4, 2, 0)}
# Symbols of one focus, lines of a monolith, kinds with subtypes.
MOST, MONOLITH, TYPES = 50, 1000, ("class", "interface", "struct", "trait")


def adaptive_depth(caller_files: Column, callees: Column, hot: Column) -> Column:
    """How far a focus expands: shallow about hubs, deep about symbols that call much and are called from few files."""
    more = hot.cast("int")
    return F.when(caller_files >= 15, 2).when((callees >= 6) & (caller_files <= 3), 4 + more).otherwise(3 + more)


def multi_seeds(g: CodeGraph, query: str, most: int = 10) -> DataFrame:
    """Seeds of each part of a query with | between its parts, most of them a part: id, place (from 1, by part and score)."""
    out = None
    for i, part in enumerate(p.strip() for p in query.split("|") if p.strip()):
        order = W.partitionBy("part").orderBy(F.desc("score"), "file_path", "line_start", "id")  # most rows
        rows = seeds(g, part, most).withColumn("part", F.lit(i)).join(g.symbols.select("id", "file_path", "line_start"), "id").withColumn("r", F.row_number().over(order)).select("id", "part", "r")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return g.symbols.limit(0).select("id", F.lit(0).alias("place"))
    first = out.groupBy("id").agg(F.min(F.struct("part", "r")).alias("_p"), F.lit(0).alias("_all"))
    return first.select("id", F.row_number().over(W.partitionBy("_all").orderBy("_p")).alias("place"))


def profiles(g: CodeGraph, starts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """label, depth: the adaptive depth of each set of seeds (label, id), by files of callers that hold no seed of it, callees, and seeds in hot files (path)."""
    own = starts.select("label", "id").distinct().join(g.symbols.select("id", "file_path"), "id")
    files = own.select("label", F.col("file_path").alias("source_file")).distinct()
    up = g.calls.select(F.col("target_id").alias("id"), "source_file").join(own.select("label", "id"), "id").join(files, ["label", "source_file"], "left_anti")
    up = up.groupBy("label").agg(F.countDistinct("source_file").alias("_up"))
    down = g.calls.select(F.col("source_id").alias("id")).join(own, "id").groupBy("label").agg(F.count("*").alias("_down"))
    warm = own.select("label", F.col("file_path").alias("path")).distinct()
    warm = warm.join(hot.select("path").distinct(), "path", "left_semi") if hot is not None else warm.limit(0)
    rows = own.select("label").distinct().join(up, "label", "left").join(down, "label", "left").na.fill(0, ["_up", "_down"])
    rows = rows.join(warm.select("label", F.lit(True).alias("_hot")).distinct(), "label", "left")
    return rows.select("label", adaptive_depth(F.col("_up"), F.col("_down"), F.coalesce("_hot", F.lit(False))).alias("depth"))


def _tables(g: CodeGraph, hot: DataFrame | None, at: str) -> tuple[DataFrame, DataFrame]:
    """Traits of symbols, and of each symbol and way the first neighbours that any focus can take, ranked."""
    cross = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("cross"), F.countDistinct("source_file").alias("caller_files"))
    rows = g.symbols.select("id", "file_path", "kind", "exported", "line_start").join(cross, "id", "left").na.fill(0, ["cross", "caller_files"])
    if hot is None:
        rows = rows.withColumn("hot", F.lit(False))
    else:
        rows = rows.join(hot.select(F.col("path").alias("file_path"), F.lit(True).alias("hot")).distinct(), "file_path", "left").na.fill(False, ["hot"])
    importance = 2 * F.col("cross") + F.coalesce("exported", F.lit(False)).cast("int") + 2 * F.col("hot").cast("int")
    traits = written(rows.withColumn("importance", importance).withColumn("utility", F.col("caller_files") >= 10), f"{at}/traits")

    def pairs(how: str, kinds: tuple[str, ...], a: str, b: str) -> DataFrame:
        return g.pairs(*kinds).select(F.lit(how).alias("how"), F.col(a).alias("x"), F.col(b).alias("y"))

    every = (
        pairs("callers", ("calls",), "target_id", "source_id").unionByName(pairs("callees", ("calls",), "source_id", "target_id"))
        .unionByName(pairs("children", ("contains",), "source_id", "target_id")).unionByName(pairs("subtypes", ("inherits", "implements"), "target_id", "source_id"))
        .unionByName(pairs("renderers", ("renders",), "target_id", "source_id"))
    )
    ends = traits.select(F.col("id").alias("x"), F.col("file_path").alias("_f"), F.col("kind").alias("_k"))
    every = every.join(traits.select(F.col("id").alias("y"), "file_path", "line_start", "importance", "utility"), "y").join(ends, "x")
    apart = F.col("file_path") != F.col("_f")
    every = every.where(~F.col("how").isin("subtypes", "renderers") | (apart & ((F.col("how") == "renderers") | F.col("_k").isin(*TYPES))))
    called = F.col("how").isin("callers", "callees")
    first = F.when((F.col("how") == "callees") & F.col("utility"), 1).otherwise(0)
    second = F.when(called, -F.col("importance")).when(F.col("how") == "children", F.col("line_start").cast("long")).otherwise(0)
    # subtypes and renderers that are shown already don't count for their limit, and MOST at most are shown
    room = MOST + max(max(v) for v in FANOUT.values())
    order = W.partitionBy("x", "how").orderBy(first, second, "y")
    return traits, written(every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= room).select("x", "how", "y", "r"), f"{at}/near")


def _expand(traits: DataFrame, near: DataFrame, starts: DataFrame, limits: DataFrame, aside: DataFrame, at: str, sparse: bool) -> DataFrame:
    """label, id, depth, place, extended: starts (label, id) expanded level by level, to the depth of each label in limits (label, depth) and MOST symbols.

    aside (label, file_path): files whose symbols come last in a level.  sparse: a
    label of fewer than 20 symbols goes one level further, to 5 at most.
    """
    aside = aside.select("label", "file_path", F.lit(1).alias("_aside")).distinct()
    limits = written(limits.select("label", F.col("depth").alias("_d")), f"{at}/limits")
    by_label = W.partitionBy("label")

    def ordered(rows: DataFrame, taken: DataFrame | None, depth: int, extended: Column) -> DataFrame:
        rows = rows.select("label", "id").distinct().join(traits.select("id", "file_path", "hot", "utility", "importance"), "id").join(aside, ["label", "file_path"], "left")
        order = by_label.orderBy(F.coalesce("_aside", F.lit(0)), ~F.col("hot"), "utility", F.desc("importance"), "id")
        rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
        if taken is not None:
            rows = rows.join(taken, "label").withColumn("place", F.col("place") + F.col("_n"))
        return rows.where(F.col("place") <= MOST).select("label", "id", F.lit(depth).alias("depth"), "place", extended.alias("extended"))

    seen = written(ordered(starts, None, 0, F.lit(False)), f"{at}/level0")
    if seen.isEmpty():
        return seen
    deepest = limits.agg(F.max("_d")).first()[0]  # one row
    for d in range(min(deepest + sparse, 5) if sparse else deepest):
        counts = seen.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") < MOST).join(limits, "label")
        further = (F.col("_d") == d) & (F.col("_d") < 5) & (F.col("_n") < 20) if sparse else F.lit(False)
        going = written(counts.where((F.col("_d") > d) | further).select("label", "_n", further.alias("_further")), f"{at}/going{d}")
        front = seen.where(F.col("depth") == d).join(going, "label").join(traits.select("id", "cross", "caller_files"), "id").select("label", F.col("id").alias("x"), "place", "cross", "caller_files")
        limit = F.create_map(*[F.lit(v) for how, n in FANOUT.items() for v in (how, n[min(d, 2)])])[F.col("how")]
        if d == 0:
            limit = F.when((F.col("how") == "callers") & (F.col("cross") >= 15), F.when(F.col("cross") < 25, 3).otherwise(1)).otherwise(limit)
        late = F.col("how").isin("subtypes", "renderers")
        rows = near.join(front, "x").withColumn("_limit", limit).where(late | (F.col("r") <= F.col("_limit")))
        if d:
            rows = rows.where((F.col("how") != "callers") | (F.col("caller_files") < 15))
        rows = rows.join(seen.select("label", F.col("id").alias("y")), ["label", "y"], "left_anti")
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("label", "x", "how").orderBy("r"))).where(~late | (F.col("_r") <= F.col("_limit")))
        # subtypes and renderers are taken only while what is shown and what waits has room for them
        way = F.create_map(*[F.lit(v) for i, how in enumerate(FANOUT) for v in (how, i)])[F.col("how")]
        rows = rows.withColumn("_waiting", F.row_number().over(by_label.orderBy("place", way, "r")) - 1).where(~late | (F.col("place") + F.col("_waiting") < MOST))
        new = written(ordered(rows.select("label", F.col("y").alias("id")), going, d + 1, F.col("_further")), f"{at}/level{d + 1}")
        if new.isEmpty():
            break
        seen = written(seen.unionByName(new), f"{at}/seen{d + 1}")
    return seen


def focus_each(g: CodeGraph, starts: DataFrame, depth: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The sub-graph about each set of seeds: label, place (order shown, from 1), id, depth, importance; MOST symbols a label at most.

    starts: label, id and, where the order of seeds matters, place.  Without a depth
    it follows from the seeds (profiles), is one more where that shows fewer than 20
    symbols, and seeds that are alone in their files (the first three) are then
    expanded by themselves, one level further, as long as there is room.

    Levels come whole: files of other seeds' monoliths last, hot files (path)
    first, then symbols called from fewer than 10 files, then by importance and id.
    A node adds the first of each way by FANOUT; fewer callers of seeds called much
    and none of later nodes called from 15 files.  Only neighbours that a focus can
    take are kept of a hub, so a level reads at most MOST nodes a label.  Seeds that
    the graph doesn't hold and null labels have no rows.
    """
    at = step_folder(g.edges.sparkSession)
    traits, near = _tables(g, hot, at)
    starts = starts if "place" in starts.columns else starts.withColumn("place", F.lit(0))
    starts = starts.where("label is not null").groupBy("label", "id").agg(F.min("place").alias("at"))
    starts = written(starts.join(traits.select("id", "file_path"), "id"), f"{at}/starts")
    big = g.files.where(F.col("line_count") >= MONOLITH).select("file_path")
    limits = profiles(g, starts, hot) if depth is None else starts.select("label", F.lit(depth).alias("depth")).distinct()
    limits = written(limits, f"{at}/limits")
    shown = _expand(traits, near, starts, limits, starts.join(big, "file_path", "left_semi").select("label", "file_path"), f"{at}/first", depth is None)
    if depth is None:
        shown = _with_starved(traits, near, starts, limits, shown, f"{at}/again")
    return shown.join(traits.select("id", "importance"), "id").select("label", "place", "id", "depth", "importance")


def _with_starved(traits: DataFrame, near: DataFrame, starts: DataFrame, limits: DataFrame, shown: DataFrame, at: str) -> DataFrame:
    """shown, and what the first three seeds that are alone in their files find by themselves, in the order of these seeds."""
    own = starts.groupBy("label").agg(F.count("*").alias("_seeds")).where("_seeds > 1")
    sizes = shown.groupBy("label").agg(F.count("*").alias("_n"), F.max("extended").alias("_extended")).where(F.col("_n") < MOST - 3)
    held = shown.join(traits.select("id", "file_path"), "id").groupBy("label", "file_path").agg(F.count("*").alias("_here"))
    alone = starts.join(own, "label").join(sizes, "label").join(held, ["label", "file_path"], "left").where(F.coalesce("_here", F.lit(0)) <= 1)
    alone = alone.withColumn("_order", F.row_number().over(W.partitionBy("label").orderBy("at", "id"))).where(F.col("_order") <= 3).join(limits, "label")
    # each such seed is a set of its own
    alone = written(alone.select(F.concat_ws(" ", "_order", "label").alias("label"), F.col("label").alias("_of"), "_order", "_n", "id", "file_path", (F.col("depth") + 1 + F.col("_extended").cast("int")).alias("depth")), f"{at}/alone")
    if alone.isEmpty():
        return shown
    found = _expand(traits, near, alone, alone, alone, at, False).drop("extended").join(alone.select("label", "_of", "_order", "_n"), "label")
    found = found.join(shown.select(F.col("label").alias("_of"), "id"), ["_of", "id"], "left_anti")
    first = found.groupBy("_of", "id", "_n").agg(F.min(F.struct("_order", "place", "depth")).alias("_b"))
    more = first.withColumn("place", F.col("_n") + F.row_number().over(W.partitionBy("_of").orderBy("_b"))).where(F.col("place") <= MOST)
    return shown.drop("extended").unionByName(more.select(F.col("_of").alias("label"), "id", "_b.depth", "place"))


def focus(g: CodeGraph, start: DataFrame, depth: int | None = 3, hot: DataFrame | None = None) -> DataFrame:
    """The sub-graph about one set of seeds (id, place): id, depth, importance, place; see focus_each."""
    return focus_each(g, start.withColumn("label", F.lit("")), depth, hot).select("id", "depth", "importance", "place")
