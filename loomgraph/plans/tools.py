"""Entry points: every tool by name, kits of weighted steps, and a registry of plugins with dependencies."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_change_task, token_estimate
from ..model import CodeGraph
from ..operators import focus, history, lookup, scoring, search, structure, telemetry, traverse
from ..rules.evaluate import fired

Tool = Callable[..., DataFrame]


def blast(g: CodeGraph, path: str) -> DataFrame:
    """section, item, n: what depends on a file: importers, outside callers, exports in use, tests to run, its own imports."""
    from ..functions.paths import is_test

    def rows(section: str, df: DataFrame, item: str, n: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(n).cast("long").alias("n"))

    one = F.lit(1).alias("n")
    outside = g.calls.where((F.col("target_file") == path) & (F.col("source_file") != path))
    importers = g.imports.where(F.col("target_id") == path).select(F.col("source_id").alias("item"), one)
    callers = outside.groupBy(F.col("source_file").alias("item")).agg(F.count("*").alias("n"))
    exports = outside.groupBy(F.col("target_id").alias("item")).agg(F.countDistinct("source_file").alias("n"))
    tests = importers.select("item").unionByName(callers.select("item")).where(is_test(F.col("item"))).distinct().select("item", one)
    own = g.imports.where(F.col("source_id") == path).select(F.col("target_id").alias("item"), one)
    return rows("importers", importers, "item", "n").unionByName(rows("callers", callers, "item", "n")).unionByName(rows("exports", exports, "item", "n")).unionByName(rows("tests", tests, "item", "n")).unionByName(rows("imports", own, "item", "n"))


def diff(g: CodeGraph, changed: DataFrame, now: str) -> DataFrame:
    """file_path, symbols, exported, callers, churn, blast, active, risk of changed files (path).

    callers: caller files outside, counted for each symbol; churn: commits; blast: importers, where there are two or more;
    active: commits of the last week, where there are two or more; risk: by callers and twice the churn, 12 or 6 and more.
    """
    files = changed.select(F.col("path").alias("file_path")).distinct()
    calls = g.calls.where("source_file <> target_file").join(files.select(F.col("file_path").alias("target_file")), "target_file", "left_semi")
    callers = calls.select("target_file", "target_id", "source_file").distinct().groupBy(F.col("target_file").alias("file_path")).agg(F.count("*").alias("callers"))
    own = g.symbols.groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    churn = history.commit_counts(g).select(F.col("path").alias("file_path"), F.col("commits").alias("churn"))
    blast = g.imports.where("source_id <> target_id").groupBy(F.col("target_id").alias("file_path")).agg(F.count("*").alias("blast")).where("blast >= 2")
    active = history.velocity(g, now, 7).where("per_week >= 2").select(F.col("path").alias("file_path"), F.col("per_week").alias("active"))
    for more in (own, callers, churn):
        files = files.join(more, "file_path", "left").na.fill(0)
    points = F.col("callers") + 2 * F.col("churn")
    rows = files.join(blast, "file_path", "left").join(active, "file_path", "left")
    return rows.withColumn("risk", F.when(points >= 12, "HIGH").when(points >= 6, "MEDIUM").otherwise("LOW"))


def overview(g: CodeGraph, now: str) -> DataFrame:
    """section, item, n: counts, key files, hot symbols and signals that fire."""
    def rows(section: str, df: DataFrame, item: str, n: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(n).cast("long").alias("n"))

    return (
        rows("stats", structure.stats(g).withColumn("item", F.concat_ws(":", "what", "name")), "item", "n").unionByName(rows("key_files", structure.key_files(g), "file_path", "score"))
        .unionByName(rows("hot_symbols", structure.hot_symbols(g), "id", "files")).unionByName(rows("signals", fired(g, now), "rule", "n"))
    )


def within_budget(rows: DataFrame, text: str, order: list, budget: int) -> DataFrame:
    """rows in order for as long as the running estimate of their text's tokens stays within a budget; meant for the lines of one answer."""
    running = F.sum(token_estimate(F.col(text))).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_used", running).where(F.col("_used") <= budget).drop("_used")


def prepare(g: CodeGraph, task: str, now: str, task_type: str = "", budget: int = 4000) -> DataFrame:
    """Context of a task: symbols about what it names, or nothing when a change task names nothing that is known.

    section, item, rank; cut to a token budget by rank.
    """
    spark = g.symbols.sparkSession
    change = spark.createDataFrame([(task, task_type)], "t string, k string").select(is_change_task(F.col("t"), F.col("k"))).first()[0]
    hits = search.search(g, task).limit(3)
    about = focus.focus(g, hits.select("id"), 2).select(F.lit("focus").alias("section"), F.col("id").alias("item"), F.col("place").cast("int").alias("rank"))
    if change:
        return within_budget(about, "item", ["rank"], budget)
    hot = scoring.hotspots(g, now, 5).select(F.lit("hotspots").alias("section"), F.col("id").alias("item"), (F.row_number().over(W.orderBy(F.desc("score"), "id")) + 1000).alias("rank"))
    return within_budget(about.unionByName(hot), "item", ["rank"], budget)


@dataclass(frozen=True)
class Kit:
    """Named steps that share a token budget by weight."""

    steps: tuple[str, ...]
    weights: dict[str, float] = field(default_factory=dict)
    description: str = ""

    def budgets(self, total: int) -> dict[str, int]:
        """Tokens of each step: by weight, at least 200; the last takes what is left, and none begins with 50 or fewer left."""
        whole, left, out = sum(self.weights.get(s, 1.0) for s in self.steps), total, {}
        for s in self.steps:
            if left <= 50:
                break
            out[s] = left if s == self.steps[-1] else max(200, int(total * self.weights.get(s, 1.0) / whole))
            left -= out[s]
        return out


# The built-in kits.
KITS = {
    "explore": Kit(("overview", "hotspots"), {"overview": 0.5, "hotspots": 0.5}, "structure and complexity of an unknown code base"),
    "deep_dive": Kit(("focus", "blast"), {"focus": 0.6, "blast": 0.4}, "a symbol and what depends on it"),
    "change_prep": Kit(("diff", "focus"), {"diff": 0.5, "focus": 0.5}, "the current change and the symbols about it"),
    "code_review": Kit(("dead", "hotspots", "focus"), {"dead": 0.3, "hotspots": 0.3, "focus": 0.4}, "dead code, risk and a focus"),
    "health": Kit(("hotspots", "dead"), {"hotspots": 0.5, "dead": 0.5}, "complexity and dead code"),
}


def load_kits(text: str) -> dict[str, Kit]:
    """Built-in kits with those of a JSON text; kits without steps and malformed texts add nothing."""
    try:
        own = {k: Kit(tuple(v["steps"]), v.get("weights", {s: 1 / len(v["steps"]) for s in v["steps"]}), v.get("description", "")) for k, v in json.loads(text).items() if v.get("steps")}
    except (ValueError, AttributeError, TypeError):
        own = {}
    return KITS | own


@dataclass
class Plugin:
    name: str
    run: Tool | None = None
    depends: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    default: bool = True


class Registry:
    """Plugins by name and mode; enabling one enables what it depends on, and one that others need can't be disabled."""

    def __init__(self, plugins: tuple[Plugin, ...] = ()):
        self.plugins, self.modes, self.enabled = {}, {}, set()
        for p in plugins:
            self.add(p)

    def add(self, plugin: Plugin) -> None:
        self.plugins[plugin.name] = plugin
        self.modes |= dict.fromkeys(plugin.provides, plugin.name)
        if plugin.default:
            self.enable(plugin.name)

    def enable(self, name: str) -> list[str]:
        """Newly enabled plugins, dependencies first."""
        if name not in self.plugins or name in self.enabled:
            return []
        self.enabled.add(name)
        return [x for d in self.plugins[name].depends for x in self.enable(d)] + [name]

    def disable(self, name: str) -> tuple[bool, list[str]]:
        """Whether it is disabled now, and the enabled plugins that keep it."""
        needed = [p.name for p in self.plugins.values() if p.name in self.enabled and name in p.depends and name in self.enabled]
        if not needed:
            self.enabled.discard(name)
        return not needed, needed

    def runner(self, mode: str) -> Tool | None:
        name = self.modes.get(mode)
        return self.plugins[name].run if name in self.enabled else None


#: Tools over a code graph, or over a usage log, by name.
TOOLS: dict[str, Tool] = {
    "overview": overview, "stats": structure.stats, "focus": focus.focus, "hotspots": scoring.hotspots, "blast_radius": blast, "diff_context": diff, "dead_code": scoring.dead_confidence,
    "lookup": lookup.lookup, "symbols": structure.top_symbols, "file_map": structure.top_symbols, "dependencies": traverse.layers, "architecture": structure.module_edges, "prepare_context": prepare,
    "search_semantic": search.search, "cochange_context": history.cochange_of, "get_patterns": structure.families, "suggest_next": telemetry.predict, "report": telemetry.report,
    "learn_recommendation": telemetry.effectiveness, "token_stats": telemetry.token_stats, "quality": structure.quality, "signals": fired,
}


def registry() -> Registry:
    """All plugins with their modes and dependencies."""
    return Registry((
        Plugin("overview", overview, (), ("overview",)), Plugin("focus", focus.focus, (), ("focus",)), Plugin("blast", blast, (), ("blast",)), Plugin("diff", diff, (), ("diff",)),
        Plugin("hotspots", scoring.hotspots, (), ("hotspots",)), Plugin("dead_code", scoring.dead_confidence, (), ("dead",)), Plugin("lookup", lookup.lookup, (), ("lookup",)),
        Plugin("arch", structure.module_edges, (), ("arch",)), Plugin("map", structure.top_symbols, (), ("map",)), Plugin("symbols", structure.top_symbols, (), ("symbols",)),
        Plugin("context", prepare, ("focus", "blast", "overview"), ("context",)), Plugin("tokens", telemetry.token_stats, (), ("token_stats",)), Plugin("learn", telemetry.effectiveness, ("context", "tokens"), ("learn", "insights")),
        Plugin("quality", structure.quality, ("hotspots", "dead_code"), ("quality",)), Plugin("skills", structure.families, (), ("skills", "patterns")),
    ))
