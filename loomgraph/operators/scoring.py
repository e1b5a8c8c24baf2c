"""Hotspot scores, blast counts and dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dispatch_like, file_class, is_test
from ..model import CodeGraph, file_of
from .history import velocity

# Kinds and names that a score or a search leaves out, and weights.
UNSCORED = ("variable", "constant", "enum_member", "field")
UNDEAD_KINDS = ("module", "unknown", "test")
ENTRY_NAMES = ("main", "__init__", "__main__", "init", "Main")


def dependents(g: CodeGraph) -> DataFrame:
    """Distinct (file_path, dependent): files that import a file or call a symbol of it from outside."""
    calls = g.calls.select(F.col("target_file").alias("file_path"), F.col("source_file").alias("dependent"))
    imports = g.imports.select(F.col("target_id").alias("file_path"), F.col("source_id").alias("dependent"))
    return calls.unionByName(imports).where("file_path <> dependent").distinct()


def file_blast(g: CodeGraph) -> DataFrame:
    """Dependents of each file that has any, by class."""
    kind = file_class(F.col("dependent"))
    return dependents(g).groupBy("file_path").agg(
        F.count("*").alias("blast_total"), *[F.count_if(kind == k).alias(f"blast_{k}") for k in ("source", "test", "config")]
    )


def degrees(g: CodeGraph) -> DataFrame:
    """Per symbol id: caller files, callees, children, renders and renderers; symbols without an edge are absent."""
    callers = g.calls.groupBy(F.col("target_id").alias("id")).agg(
        F.countDistinct("source_file").alias("caller_files"),
        F.countDistinct(F.when(F.col("source_file") != F.col("target_file"), F.col("source_file"))).alias("cross_files"),
        F.count("*").alias("callers"),
    )
    callees = g.calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    known = g.symbols.select(F.col("id").alias("target_id"))
    children = g.of_kind("contains").join(known, "target_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("children"))
    renders = g.of_kind("renders").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("renders"))
    out = callers.join(callees, "id", "full").join(children, "id", "full").join(renders, "id", "full")
    return out.na.fill(0)


def hotspots(g: CodeGraph, now: str, n: int | None = 20) -> DataFrame:
    """Symbols by risk: coupling, size, complexity, churn of the file and its dependents."""
    cpw = velocity(g, now, 7).select(F.col("path").alias("file_path"), "per_week")
    rows = g.symbols.where(~F.col("kind").isin(*UNSCORED)).join(degrees(g), "id", "left").na.fill(0, ["caller_files", "callees", "children", "cross_files", "renders"])
    rows = rows.join(cpw, "file_path", "left").join(file_blast(g).select("file_path", "blast_total"), "file_path", "left").na.fill(0, ["per_week", "blast_total"])
    lines = F.col("line_end") - F.col("line_start") + 1
    base = (
        F.col("caller_files") * 3.0 + F.col("callees") * 1.5 + F.least(lines / 10, F.lit(50.0)) + F.col("children") * 2.0 + F.col("cross_files") * 5.0 + F.col("renders") * 2.0
        + F.when(F.col("complexity") > 1, F.log2(F.col("complexity").cast("double")) * 3.0).otherwise(0.0)
    )
    score = base * (1 + F.log2(1 + F.col("per_week")) * 0.2) * (1 + F.log2(1 + F.col("blast_total").cast("double")) * 0.1)
    out = rows.select("id", "file_path", "kind", "caller_files", "cross_files", "callees", "blast_total", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id")
    return out.limit(n) if n else out


def dead_code(g: CodeGraph) -> DataFrame:
    """Exported symbols that nothing refers to: id, name, kind, file_path, lines, parent_id, doc.

    A top-level symbol is dead without any reference; a member is dead when its
    parent is referred to across files and it isn't referred to at all.
    """
    refs = g.edges.where("kind <> 'contains'").select("source_id", "target_id")
    any_ref = refs.select(F.col("target_id").alias("id")).distinct()
    across = refs.where(file_of(F.col("source_id")) != file_of(F.col("target_id"))).select(F.col("target_id").alias("parent_id")).distinct()
    candidates = g.symbols.where(F.col("exported") & ~F.col("kind").isin(*UNDEAD_KINDS) & ~F.col("name").isin(*ENTRY_NAMES)).join(any_ref, "id", "left_anti")
    top = candidates.where("parent_id is null")
    members = candidates.where("parent_id is not null").join(across, "parent_id", "left_semi")
    return top.unionByName(members.select(*top.columns))


def dead_confidence(g: CodeGraph) -> DataFrame:
    """Dead symbols with a confidence of 0 to 100 and its tier."""
    dead = dead_code(g)
    called = g.calls.select(F.col("target_id").alias("id")).distinct().withColumn("has_callers", F.lit(True))
    imported = g.imports.select(F.col("target_id").alias("file_path")).distinct().withColumn("has_importers", F.lit(True))
    known = g.symbols.select(F.col("id").alias("source_id"))
    rendered = g.of_kind("renders").join(known, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct().withColumn("has_renderers", F.lit(True))
    parents = called.select(F.col("id").alias("parent_id"), F.lit(True).alias("parent_called"))
    components = g.symbols.where("kind = 'component'").groupBy("file_path").agg(F.count("*").alias("components"))
    rows = dead.join(called, "id", "left").join(imported, "file_path", "left").join(rendered, "id", "left").join(parents, "parent_id", "left").join(components, "file_path", "left")

    def points(n: int, when) -> F.Column:
        return F.when(when, n).otherwise(0)

    lines = F.col("line_end") - F.col("line_start") + 1
    total = (
        points(-50, is_test(F.col("file_path"))) + points(30, F.col("has_callers").isNull()) + points(25, F.col("has_importers").isNull())
        + points(10, F.col("has_renderers").isNull()) + points(15, lines > 50) + points(-20, dispatch_like(F.col("name")))
        + points(-30, (F.col("name") == "run") & F.col("file_path").contains("/plugins/")) + points(-40, F.col("kind") == "command")
        + points(-15, F.col("doc") != "") + points(-10, F.col("parent_id").isNotNull() & F.col("parent_called").isNull())
        + points(-20, (F.col("kind") == "component") & F.col("exported") & (F.col("components") == 1))
    )
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")
    tier = F.when(F.col("confidence") >= 70, "high").when(F.col("confidence") >= 40, "medium").otherwise("low")
    return rows.withColumn("confidence", confidence).withColumn("tier", tier).select("id", "kind", "file_path", lines.cast("int").alias("lines"), "confidence", "tier")


def dead_effort(g: CodeGraph) -> DataFrame:
    """Dead code of each file: symbols, lines, mean confidence and cleanup effort."""
    outside = g.calls.where("source_file <> target_file").select(F.col("target_id").alias("id")).distinct().withColumn("outside", F.lit(True))
    rows = dead_confidence(g).join(outside, "id", "left")
    weight = F.avg(F.when(F.col("outside").isNull(), 0.5).otherwise(1.0))
    effort = F.count("*") * (1 + weight)
    return rows.groupBy("file_path").agg(
        F.count("*").alias("n_dead"), F.sum("lines").alias("dead_lines"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.when(effort > 10, "HIGH").when(effort >= 4, "MEDIUM").otherwise("LOW").alias("effort"),
    )


def superseded(g: CodeGraph) -> DataFrame:
    """Dead symbols named like a live one but for a suffix of age."""
    stem = F.regexp_replace("name", "_(old|legacy|v1|v2|deprecated|backup|bak|orig)$", "")
    dead = dead_code(g).select("id", "name").withColumn("stem", stem).where("stem <> name")
    live = g.symbols.join(dead_code(g).select("id"), "id", "left_anti").select(F.col("name").alias("stem"), F.col("id").alias("live_id"))
    return dead.join(live, "stem").select("id", "live_id")
