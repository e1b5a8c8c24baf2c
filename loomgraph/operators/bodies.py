"""Facts about signatures and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test
from ..model import CodeGraph


def _parameters() -> Column:
    """Parameter texts of a signature, split at commas outside brackets, self and cls aside."""
    inner = F.regexp_extract("signature", r"\((.*)\)", 1)
    flat = F.regexp_replace(inner, r"\[[^\[\]]*\]", "")
    return F.filter(F.transform(F.split(flat, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin("self", "cls", "*", "/"))


def signatures(g: CodeGraph) -> DataFrame:
    """id and traits of each function's signature: parameters, annotated, defaults, variadic, is_async, returns."""
    rows = g.symbols.where(F.col("kind").isin("function", "method", "test", "route")).withColumn("p", _parameters())
    count = lambda test: F.size(F.filter("p", test)).cast("long")
    return rows.select(
        "id", F.size("p").cast("long").alias("parameters"), count(lambda p: p.contains(":")).alias("annotated"), count(lambda p: p.contains("=")).alias("defaults"),
        F.exists("p", lambda p: p.startswith("*")).alias("variadic"), F.col("signature").startswith("async ").alias("is_async"), F.regexp_extract("signature", r"->\s*(.+?)\s*:?$", 1).alias("returns"),
    )


def bodies(g: CodeGraph, contents: DataFrame) -> DataFrame:
    """id, signature, file_path, body: the lines after a symbol's first; contents: path, content (text or binary)."""
    text = contents.select(F.col("path").alias("file_path"), F.split(F.col("content").cast("string"), "\n").alias("_l"))
    rows = g.symbols.where("line_end > line_start").join(text, "file_path")
    return rows.select("id", "kind", "signature", "file_path", F.array_join(F.slice("_l", F.col("line_start") + 1, F.col("line_end") - F.col("line_start")), "\n").alias("body"), (F.col("line_end") - F.col("line_start") + 1).alias("lines"))


def notes(rows: DataFrame) -> DataFrame:
    """id, n: TODO, FIXME, HACK and XXX marks of bodies."""
    n = F.regexp_count("body", F.lit(r"\b(TODO|FIXME|HACK|XXX)\b"))
    return rows.select("id", n.alias("n")).where("n > 0")


def async_gaps(rows: DataFrame) -> DataFrame:
    """Async functions of three lines or more that neither await nor yield."""
    return rows.where("signature like '%async %' and lines >= 3").where(~F.col("body").rlike(r"\b(await|yield)\b|async (for|with)")).select("id")


def dead_parameters(g: CodeGraph, rows: DataFrame, callers: int = 3, most: int = 2) -> DataFrame:
    """id, parameter: plain parameters that the body of a function with enough outside callers never names."""
    used = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("c")).where(F.col("c") >= callers)
    names = F.filter(F.transform(_parameters(), lambda p: F.regexp_extract(p, r"^(\w+)", 1)), lambda p: p != "")
    told = rows.where(~is_test(F.col("file_path"))).join(used, "id", "left_semi").withColumn("p", names).where("size(p) >= 2")
    words = F.regexp_extract_all("body", F.lit(r"(\w+)"), 1)
    dead = F.slice(F.array_except("p", words), 1, most)
    return told.select("id", F.explode(dead).alias("parameter"))


def raised(rows: DataFrame) -> DataFrame:
    """id, exception: what a body raises or throws by name."""
    names = F.regexp_extract_all("body", F.lit(r"\b(?:raise|throw)\s+(?:new\s+)?([A-Z]\w*)"), 1)
    return rows.select("id", F.explode(F.array_distinct(names)).alias("exception"))
