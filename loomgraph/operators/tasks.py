"""Tasks inferred from usage: what a session was about, what it read, and whether it went well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .telemetry import sessions

# The task that a mode speaks for, the mode of a tool, tools and modes that say nothing.
TASKS = {
    "focus": "code_navigation", "blast": "code_navigation", "lookup": "code_navigation", "symbols": "code_navigation", "map": "orientation",
    "dead": "cleanup", "hotspots": "refactor", "diff": "code_review", "overview": "orientation", "arch": "architecture", "deps": "dependency_audit",
    "context": "task_preparation", "quality": "output_review", "learn": "learning", "skills": "patterns",
}
TOOLS = {
    "overview": "overview", "focus": "focus", "lookup": "lookup", "blast_radius": "blast", "hotspots": "hotspots", "diff_context": "diff", "dead_code": "dead",
    "symbols": "symbols", "file_map": "map", "dependencies": "deps", "architecture": "arch", "prepare_context": "context", "learn_recommendation": "learn", "get_patterns": "skills",
}
SILENT_TOOLS, SILENT_MODES = ("index_repo", "stats", "report_feedback"), ("stats", "report")
#: Sessions of more events are runs of a machine; seconds about a session's end in which feedback is about it.
MOST, NEAR = 30, 3600


def _named(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def entry_mode(mode: Column, tool: Column) -> Column:
    """The mode of a usage entry: its own, else its tool's; null for tools that say nothing."""
    known = F.when(tool.isin(*SILENT_TOOLS), None).otherwise(F.coalesce(_named(TOOLS)[tool], tool))
    return F.coalesce(F.nullif(mode, F.lit("")), known)


def most_frequent(values: Column) -> Column:
    """The most frequent value of an array; of equally frequent ones the first to come.  Null for none."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda w: w == v))).alias("n"), F.array_position(values, v).alias("at"), v.alias("v")))
    return F.array_min(counted)["v"]


def task_type(modes: Column, labels: Column) -> Column:
    """The task of a session: its most frequent label, else the one that most of its modes speak for, else general."""
    said = F.filter(labels, lambda x: x.isNotNull() & ~x.isin("null", "unknown"))
    spoken = F.filter(F.transform(modes, lambda m: _named(TASKS)[m]), lambda t: t.isNotNull())
    return F.coalesce(most_frequent(said), most_frequent(spoken), F.lit("general"))


def session_hash(micros: Column) -> Column:
    """Eight digits of the digest of a session's times, given in order."""
    return F.substring(F.md5(F.array_join(F.transform(micros, lambda x: x.cast("string")), "|").cast("binary")), 1, 8)


def described(rows: DataFrame) -> DataFrame:
    """rows with _e, the events (us, event_id, mode, label) of a session in order: context_modes, task_type, session_hash in their place; sessions without a mode that says something go."""
    modes = F.filter(F.transform("_e", lambda x: x["mode"]), lambda m: m.isNotNull() & ~m.isin(*SILENT_MODES))
    rows = rows.withColumn("_modes", modes).where(F.size("_modes") > 0)
    made = rows.withColumn("context_modes", F.array_join(F.array_distinct("_modes"), ",")).withColumn("task_type", task_type(F.col("_modes"), F.transform("_e", lambda x: x["label"])))
    return made.withColumn("session_hash", session_hash(F.transform("_e", lambda x: x["us"]))).drop("_e", "_modes")


def session_tasks(usage: DataFrame, said: DataFrame, by: str = "repo", known: DataFrame | None = None, most: int = MOST, near: int = NEAR) -> DataFrame:
    """A row for each session of up to most events: by, session, start_us, end_us, events, tokens, empties, context_modes, task_type, success, session_hash.

    usage: ts, event_id, by, mode, tokens, empty, and tool and task_type if there
    are such; said: feedback (ts, by, helpful).  Feedback near a session's end
    decides its success, else whether less than half of its results were empty.
    known (session_hash) are tasks that are recorded.  Sessions are counted first,
    and only events of sessions short enough are gathered.
    """
    column = lambda name: F.col(name) if name in usage.columns else F.lit(None).cast("string")
    rows = sessions(usage.select("ts", "event_id", by, "tokens", "empty", entry_mode(F.col("mode"), column("tool")).alias("mode"), column("task_type").alias("label")), by)
    keys, us = [by, "session"], F.unix_micros("ts")
    sizes = rows.groupBy(*keys).agg(
        F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.count_if("empty").alias("empties")
    ).where(F.col("events") <= most)
    events = rows.join(sizes.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(us.alias("us"), "event_id", "mode", "label"))).alias("_e"))
    each = described(sizes.join(events, keys))
    if known is not None:
        each = each.join(known.select("session_hash").distinct(), "session_hash", "left_anti")
    # feedback and ends meet in buckets of near seconds
    width = near * 1_000_000
    ends = each.select(*keys, "end_us", F.explode(F.sequence(F.expr(f"end_us div {width} - 1"), F.expr(f"end_us div {width} + 1"))).alias("_b"))
    told = said.select(by, F.unix_micros("ts").alias("_us"), "helpful").withColumn("_b", F.expr(f"_us div {width}"))
    found = ends.join(told, [by, "_b"]).where(F.abs(F.col("_us") - F.col("end_us")) <= width).groupBy(*keys).agg(F.bool_or("helpful").alias("_helpful"))
    success = F.coalesce("_helpful", F.col("empties") < 0.5 * F.col("events"))
    return each.join(found, keys, "left").withColumn("success", success).drop("_helpful")
