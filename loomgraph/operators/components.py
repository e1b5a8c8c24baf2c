"""Strongly connected components of a relation between nodes, the condensed relation, its layers and its longest chains.

Edges are rows (source_id, target_id).  Every step is a join or an aggregation of
all edges that are left, written below the shared folder, so that no step holds a
component in one task and a lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import is_test
from ..model import CodeGraph
from ..session import step_folder, written


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes (node)."""
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges


def _trimmed(edges: DataFrame, at: str) -> DataFrame:
    """edges without nodes that nothing comes to or goes from, until each node has both: what is left lies on or between cycles."""
    n, i = edges.count(), 0
    while n:
        inner = edges.select(F.col("source_id").alias("node")).distinct().join(edges.select(F.col("target_id").alias("node")).distinct(), "node", "left_semi")
        edges, before, i = written(_within(edges, inner), f"{at}/trim{i}"), n, i + 1
        n = edges.count()
        if n == before:
            break
    return edges


def _spread_least(values: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """node, colour: the least colour that reaches each node along edges; only nodes whose colour has changed pass it on."""
    changed, i = values, 0
    while True:
        told = changed.join(edges, changed["node"] == edges["source_id"]).groupBy(F.col("target_id").alias("node")).agg(F.min("colour").alias("_told"))
        next_ = values.join(told, "node", "left").select("node", F.least("colour", "_told").alias("colour"), (F.col("_told") < F.col("colour")).alias("_new"))
        next_, i = written(next_, f"{at}/colour{i}"), i + 1
        values, changed = next_.select("node", "colour"), next_.where("_new").select("node", "colour")
        if changed.isEmpty():
            return values


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), size: nodes that reach each other.

    Rounds of three steps: nodes on no cycle are trimmed off; the least node that
    reaches it colours each node; and the nodes of a colour that reach the node
    which gave it, within the colour, are a component.  Each round settles at least
    one component of each colour.
    """
    at = step_folder(edges.sparkSession)
    edges = written(edges.where("source_id <> target_id").select("source_id", "target_id").distinct(), f"{at}/edges")
    nodes = written(_ends(edges), f"{at}/nodes")
    left, found, i = edges, None, 0
    while not (left := _trimmed(left, f"{at}/round{i}")).isEmpty():
        step = f"{at}/round{i}"
        colours = _spread_least(_ends(left).withColumn("colour", F.col("node")), left, f"{step}/forward")
        of = lambda end, name: colours.select(F.col("node").alias(end), F.col("colour").alias(name))
        same = written(left.join(of("source_id", "_a"), "source_id").join(of("target_id", "_b"), "target_id").where("_a = _b").select("source_id", "target_id"), f"{step}/same")
        # backwards from the nodes that gave the colours
        seen = front = written(colours.where("node = colour"), f"{step}/back0")
        k = 0
        while not front.isEmpty():
            k += 1
            before = front.join(same, front["node"] == same["target_id"]).select(F.col("source_id").alias("node"), "colour").distinct()
            front = written(before.join(seen.select("node"), "node", "left_anti"), f"{step}/back{k}")
            seen = seen.unionByName(front)
        seen = written(seen, f"{step}/done")
        found = seen if found is None else found.unionByName(seen)
        left = written(_within(left, _ends(left).join(seen, "node", "left_anti")), f"{step}/left")
        i += 1
    single = nodes.withColumn("colour", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("colour"))
    sizes = single.groupBy("colour").agg(F.count("*").alias("size"), F.min("node").alias("component"))
    return written(single.join(sizes, "colour").select("node", "component", "size"), f"{at}/components")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges between components, which have no cycle."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    both = edges.join(of("source_id"), "source_id").join(of("target_id"), "target_id").where("_source_id <> _target_id")
    return both.select(F.col("_source_id").alias("source_id"), F.col("_target_id").alias("target_id")).distinct()


def peeled(edges: DataFrame) -> DataFrame:
    """node, layer: nodes without edges to others are layer 0, the others one above the highest that they point at.  Nodes in or above cycles share one last layer.

    A round keeps the nodes that point at one of those left; a node's layer is the
    last round that it is left in.  Edges to nodes that are done are dropped every
    few rounds.
    """
    spark = edges.sparkSession
    at = step_folder(spark)
    edges = written(edges.select("source_id", "target_id"), f"{at}/edges")
    left = written(_ends(edges), f"{at}/left/round=0")
    n, i = left.count(), 0
    while n:
        to_left = edges.join(left.select(F.col("node").alias("target_id")), "target_id", "left_semi")
        if i % 8 == 7:
            edges = to_left = written(to_left, f"{at}/edges{i}")
        rest = written(left.join(to_left.select(F.col("source_id").alias("node")), "node", "left_semi"), f"{at}/left/round={i + 1}")
        before, n = n, rest.count()
        if n == before:
            break
        left, i = rest, i + 1
    rounds = spark.read.schema(f"node {edges.schema['source_id'].dataType.simpleString()}, round int").parquet(f"{at}/left")
    return rounds.where(F.col("round") <= i).groupBy("node").agg(F.max("round").alias("layer"))


def import_components(g: CodeGraph) -> DataFrame:
    """component, size and members (in order) of files that import each other in a circle."""
    many = strong_components(g.imports).where("size > 1")
    return many.groupBy("component", "size").agg(F.array_join(F.sort_array(F.collect_list("node")), " ").alias("members"))


def condensed_layers(g: CodeGraph) -> DataFrame:
    """file_path, component, layer: the longest chain of components below each file's own."""
    parts = strong_components(g.imports)
    layers = peeled(condensed(g.imports, parts)).select(F.col("node").alias("component"), "layer")
    return parts.join(layers, "component", "left").select(F.col("node").alias("file_path"), "component", F.coalesce("layer", F.lit(0)).alias("layer"))


def longest_chain(g: CodeGraph, least: int = 5, most: int = 12, width: int = 256) -> DataFrame:
    """chain, length: the longest import chain of files outside tests that symbols lie in, without repeated files; of several, the first by name.  Chains of most files end the search; no row below least.

    Once a chain has left a component it can't come back, so a chain is known by
    its last file and the files of that one's component that it has visited.  One
    chain of each such kind is kept for each length: one a file outside of cycles.
    Within a component, width kinds a file are tried first; the search is repeated
    with more as long as some were left out and no chain of most files was found.
    """
    at = step_folder(g.edges.sparkSession)
    known = g.files.select("file_path").where(~is_test(F.col("file_path")))
    edges = written(_within(g.imports.where("source_id <> target_id"), known.select(F.col("file_path").alias("node"))), f"{at}/edges")
    parts = strong_components(edges)
    of = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
    step = written(edges.join(of("source_id", "_a"), "source_id").join(of("target_id", "_b"), "target_id").select("source_id", "target_id", (F.col("_a") == F.col("_b")).alias("_same")), f"{at}/step")
    while True:
        front = written(edges.select(F.col("source_id").alias("node")).distinct().select("node", F.array("node").alias("inside"), F.array("node").alias("chain")), f"{at}/{width}/front1")
        best, length, cut = front, 1, False
        while length < most:
            on = front.join(step, front["node"] == step["source_id"]).where(~F.col("_same") | ~F.array_contains("inside", F.col("target_id")))
            inside = F.when(F.col("_same"), F.array_sort(F.concat("inside", F.array("target_id")))).otherwise(F.array("target_id"))
            kinds = on.select(F.col("target_id").alias("node"), inside.alias("inside"), F.concat("chain", F.array("target_id")).alias("chain")).groupBy("node", "inside").agg(F.min("chain").alias("chain"))
            place = kinds.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("chain"))).where(F.col("_r") <= width + 1)
            front = written(place, f"{at}/{width}/front{length + 1}")
            if front.isEmpty():
                break
            cut = cut or not front.where(F.col("_r") > width).isEmpty()
            front = front.where(F.col("_r") <= width).drop("_r")
            best, length = front, length + 1
        if length == most or not cut:
            break
        width *= 16
    top = best.agg(F.min("chain").alias("chain")).where(F.lit(length >= least) & F.col("chain").isNotNull())
    return top.select(F.array_join("chain", " > ").alias("chain"), F.lit(length).alias("length"))
