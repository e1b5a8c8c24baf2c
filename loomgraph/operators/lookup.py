"""Point look-ups over adjacency, path resolution and the question router."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..model import CodeGraph
from .search import search

_BRIEF = ("id", "kind", "file_path", "line_start")


def _neighbours(g: CodeGraph, kind: str, given: str, wanted: str, value: str) -> DataFrame:
    ids = g.of_kind(kind).where(F.col(given) == value).select(F.col(wanted).alias("id")).distinct()
    return g.symbols.join(ids, "id", "left_semi").select(*_BRIEF)


def callers_of(g: CodeGraph, symbol: str) -> DataFrame:
    """Known symbols that call a symbol."""
    return _neighbours(g, "calls", "target_id", "source_id", symbol)


def callees_of(g: CodeGraph, symbol: str) -> DataFrame:
    return _neighbours(g, "calls", "source_id", "target_id", symbol)


def children_of(g: CodeGraph, symbol: str) -> DataFrame:
    return _neighbours(g, "contains", "source_id", "target_id", symbol)


def renderers_of(g: CodeGraph, symbol: str) -> DataFrame:
    return _neighbours(g, "renders", "target_id", "source_id", symbol)


def importers_of(g: CodeGraph, path: str) -> DataFrame:
    """Files that import a file, known or not."""
    return g.imports.where(F.col("target_id") == path).select(F.col("source_id").alias("file_path"))


def imports_of(g: CodeGraph, path: str) -> DataFrame:
    return g.imports.where(F.col("source_id") == path).select(F.col("target_id").alias("file_path"))


def subtypes_of(g: CodeGraph, name: str) -> DataFrame:
    """Known symbols that inherit or implement a type, given by its name or by the id of a symbol so named."""
    ids = g.symbols.where(F.col("name") == name).select("id").unionByName(g.symbols.sparkSession.createDataFrame([(name,)], "id string"))
    edges = g.pairs("inherits", "implements").join(ids.distinct(), F.col("target_id") == F.col("id"), "left_semi")
    return g.symbols.join(edges.select(F.col("source_id").alias("id")), "id", "left_semi").select(*_BRIEF)


def symbols_in(g: CodeGraph, path: str) -> DataFrame:
    return g.symbols.where(F.col("file_path") == path).select(*_BRIEF)


def find(g: CodeGraph, name: str) -> DataFrame:
    """Symbols of a name or qualified name, whatever the case."""
    return g.symbols.where((F.lower("name") == name.lower()) | (F.lower("qualified_name") == name.lower())).select(*_BRIEF)


def rename_risk(g: CodeGraph) -> DataFrame:
    """Callers, outside files and risk of renaming each function, method, class or interface."""
    calls = g.calls.groupBy(F.col("target_id").alias("id")).agg(
        F.count("*").alias("callers"), F.countDistinct(F.when(F.col("source_file") != F.col("target_file"), F.col("source_file"))).alias("outside")
    )
    rows = g.symbols.where(F.col("kind").isin("function", "method", "class", "interface")).join(calls, "id", "left").na.fill(0, ["callers", "outside"])
    risk = F.when((F.col("callers") >= 8) | (F.col("outside") >= 3), "HIGH").when((F.col("callers") >= 2) & (F.col("outside") >= 1), "MEDIUM").otherwise("LOW")
    return rows.select("id", "callers", "outside", risk.alias("risk"))


def resolve_path(g: CodeGraph, needle: str, most: int = 8) -> DataFrame:
    """Files that a path names: equal, or ending in it after a slash."""
    needle = needle.lstrip("./")
    hit = (F.col("file_path") == needle) | F.col("file_path").endswith(f"/{needle}")
    return g.files.where(hit).select("file_path").orderBy("file_path").limit(most)


def display_paths(g: CodeGraph) -> DataFrame:
    """The basename of each file, with its folder where the basename isn't unique."""
    rows = g.files.select("file_path", basename(F.col("file_path")).alias("base"))
    many = rows.groupBy("base").agg(F.count("*").alias("n"))
    short = F.when(F.col("n") == 1, F.col("base")).otherwise(F.substring_index("file_path", "/", -2))
    return rows.join(many, "base").select("file_path", short.alias("shown"))


# Question words of each kind of look-up.
_ROUTES = (
    ("callers", r"\b(who|what)\s+calls\b|\bcallers?\s+of\b|\bwho\s+uses\b"),
    ("callees", r"\bwhat\s+does\s+(?P<callee>\S+)\s+call\b|\bcallees?\s+of\b"),
    ("importers", r"\b(who|what)\s+imports\b|\bimporters?\s+of\b"),
    ("renderers", r"\b(who|what)\s+renders\b|\brenderers?\s+of\b"),
    ("subtypes", r"\b(who|what)\s+(implements|extends|inherits)\b|\bsubtypes?\s+of\b|\bsubclasses\s+of\b"),
    ("where", r"\bwhere\s+is\b|\bfind\b|\blocate\b|\bdefinition\s+of\b"),
)


def route(question: str) -> tuple[str, str]:
    """The look-up that a question asks for, and the name in it."""
    for kind, pattern in _ROUTES:
        if m := re.search(pattern, question, re.I):
            name = m.groupdict().get("callee") or question[m.end() :]
            name = re.sub(r"^\s*(from\s+)?(the|a|an)\s+|\b(defined|located|declared|used)\b|[?.!\"'`]+\s*$", " ", name, flags=re.I)
            return kind, name.strip().strip("\"'`?.! ")
    return "search", question.strip(" ?.!")


def lookup(g: CodeGraph, question: str) -> DataFrame:
    """Answer a question by the look-up that it asks for: id, kind, file_path, line_start."""
    kind, name = route(question)
    if kind == "importers":
        paths = resolve_path(g, name)
        rows = g.imports.join(paths.select(F.col("file_path").alias("target_id")), "target_id", "left_semi").select("source_id").distinct()
        return rows.select(F.col("source_id").alias("id"), F.lit("file").alias("kind"), F.col("source_id").alias("file_path"), F.lit(0).alias("line_start")).orderBy("id").limit(15)
    if kind == "subtypes":
        return subtypes_of(g, name).orderBy("id").limit(15)
    hits = find(g, name).orderBy("id").limit(3)
    if kind == "where":
        return find(g, name).orderBy("id").limit(10)
    if kind == "search":
        return search(g, name).select(*_BRIEF).limit(10)
    given, wanted, edge = {"callers": ("target_id", "source_id", "calls"), "callees": ("source_id", "target_id", "calls"), "renderers": ("target_id", "source_id", "renders")}[kind]
    ids = g.pairs(edge).join(hits.select(F.col("id").alias(given)), given, "left_semi").select(F.col(wanted).alias("id")).distinct()
    return g.symbols.join(ids, "id", "left_semi").select(*_BRIEF).orderBy("id").limit(15)
