"""A deterministic code graph on star-schema tables: parts are symbols, orders are commits, lines are edges."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CodeGraph

#: The instant that ages are counted from.
NOW = "2001-08-02"

_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    module, base = F.lower("p_type"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    leaf = F.when(size % 4 == 3, F.concat(F.lit("test_"), base)).otherwise(F.concat(base, F.lit("_"), (size % 4).cast("string")))
    kind = F.when(key % 10 == 0, "class").when(key % 10 == 1, "component").when(key % 10 == 2, "constant").when((key % 10).isin(3, 4), "method").otherwise("function")
    rows = part.select(
        key.alias("seq"),
        F.concat_ws("_", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), key.cast("string")).alias("name"),
        kind.alias("kind"),
        F.concat(module, F.lit("/"), leaf, F.lit(".py")).alias("file_path"),
        module.alias("module"),
        (key % 500 + 1).cast("int").alias("line_start"),
        (key % 500 + size).cast("int").alias("line_end"),
        F.when(key % 3 == 0, F.col("p_type")).otherwise("").alias("doc"),
        (key % 4 != 0).alias("exported"),
        (size % 30).cast("int").alias("complexity"),
        (size * 40).cast("long").alias("byte_size"),
    )
    rows = rows.withColumn("id", F.concat_ws("::", "file_path", "name"))
    owner = F.min(F.when(F.col("kind") == "class", F.col("id"))).over(W.partitionBy("file_path"))
    return rows.withColumn("parent_id", F.when(F.col("kind") == "method", owner)).select(
        "id", "name", F.col("name").alias("qualified_name"), "kind", F.lit("python").alias("language"), "file_path", "module", "line_start", "line_end",
        F.concat(F.lit("def "), F.col("name"), F.lit("(a, b)")).alias("signature"), "doc", "parent_id", "exported", "complexity", "byte_size", "seq",
    )


def _hops(lineitem: DataFrame, syms: DataFrame) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    steps = lineitem.where("l_orderkey % 8 in (0, 1, 2)").select("l_orderkey", "l_linenumber", "l_partkey", F.lead("l_partkey").over(order).alias("next")).where("next is not null")
    s, t = (syms.select(F.col("seq").alias(f"{p}_seq"), F.col("id").alias(f"{p}_id"), F.col("file_path").alias(f"{p}_file"), F.col("kind").alias(f"{p}_kind")) for p in "st")
    return steps.join(s, F.col("l_partkey") == F.col("s_seq")).join(t, F.col("next") == F.col("t_seq"))


def edges(lineitem: DataFrame, syms: DataFrame) -> DataFrame:
    hops = _hops(lineitem, syms)
    order = F.col("l_orderkey")

    def made(kind: str, rows: DataFrame, source: str, target: str, line: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), line.cast("int").alias("line"))

    line = F.col("l_linenumber")
    forward = (F.col("s_file") != F.col("t_file")) & ((F.col("s_file") > F.col("t_file")) | (order % 640 == 1))
    before = W.partitionBy("module", F.col("seq") % 7).orderBy("seq")
    classes = syms.where("kind = 'class'").withColumn("base", F.lag("id").over(before)).where("base is not null")
    return (
        made("calls", hops.where(order % 8 == 0), "s_id", "t_id", line)
        .unionByName(made("renders", hops.where((order % 8 == 2) & (F.col("t_kind") == "component")), "s_id", "t_id", line))
        .unionByName(made("imports", hops.where((order % 64 == 1) & forward), "s_file", "t_file", line))
        .unionByName(made("contains", syms.where("parent_id is not null"), "parent_id", "id", F.lit(0)))
        .unionByName(made("inherits", classes, "id", "base", F.lit(0)))
    )


def commit_files(lineitem: DataFrame, orders: DataFrame, syms: DataFrame) -> DataFrame:
    lines = lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("seq"))
    return (
        lines.join(syms.select("seq", F.col("file_path").alias("path")), "seq")
        .select("commit_id", "path")
        .distinct()
        .join(orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").cast("date").alias("day")), "commit_id")
        .select("commit_id", "day", "path")
    )


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The projected graph, persisted once for each session and folder."""
    known = _built.setdefault(spark, {})
    if sf_dir not in known:
        syms = symbols(table(spark, sf_dir, "part")).persist()
        lineitem = table(spark, sf_dir, "lineitem")
        known[sf_dir] = CodeGraph(syms, edges(lineitem, syms).persist(), commit_files(lineitem, table(spark, sf_dir, "orders"), syms).persist())
    return known[sf_dir]


def usage(events: DataFrame) -> DataFrame:
    """The events table as a usage log: ts (UTC), repo, mode, tokens, empty."""
    return events.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("repo"), F.col("event_type").alias("mode"),
        F.col("value").cast("int").alias("tokens"), (F.col("event_type") == "error").alias("empty"),
    )
