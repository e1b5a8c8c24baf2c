"""Interval joins, cut to buckets so that they are joins by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CodeGraph

BUCKET = 64


def changed_symbols(g: CodeGraph, lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """id, lines: how many changed lines (path, line) lie within each symbol.

    A symbol stands in each bucket of lines that it touches, so a line meets
    only symbols of its own file and bucket.
    """
    first, last = F.floor(F.col("line_start") / bucket), F.floor(F.col("line_end") / bucket)
    spans = g.symbols.select("id", F.col("file_path").alias("path"), "line_start", "line_end", F.explode(F.sequence(first, last)).alias("_b"))
    told = lines.withColumn("_b", F.floor(F.col("line") / bucket))
    return spans.join(told, ["path", "_b"]).where("line between line_start and line_end").groupBy("id").agg(F.count("*").alias("lines"))
