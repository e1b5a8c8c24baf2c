"""Evaluation: all rules of a scope in one pass over its features."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CodeGraph
from ..operators.scoring import hotspots
from ..session import step_folder, written
from . import features
from .base import Rule
from .catalogue import RULES
from .totals import of_change, totals


def subject(scope: str) -> str:
    """The column that names a row of a scope."""
    return {"symbol": "id", "top": "id", "touched": "id", "leader": "id", "repository": "repository", "change": "repository"}.get(scope, "file_path")


def of_scope(rows: DataFrame, rules: list[Rule], subject: str) -> DataFrame:
    """rule, n, sample (the least subject) of the rules that fire.

    Each row gives the names of the rules that it meets, and these are counted;
    a task counts its own rows first, so what is shuffled is a row per rule and task.
    """
    met = F.array_compact(F.array(*[F.when(F.expr(f"coalesce({r.condition}, false)"), F.lit(r.name)) for r in rules]))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.least)])
    counted = rows.select(F.explode(met).alias("rule"), F.col(subject).alias("subject")).groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("sample"))
    return counted.where(F.col("n") >= least[F.col("rule")])


def fired(g: CodeGraph, now: str, rules: list[Rule] | None = None) -> DataFrame:
    """rule, n, sample of all rules that fire on a graph.

    What several scopes read is written once: the features of symbols and of files, the paths of the change and the first
    hotspots.  A scope without rules isn't built.
    """
    rules = RULES if rules is None else rules
    at = step_folder(g.symbols.sparkSession)

    @cache
    def base(name: str) -> DataFrame:
        build = {"symbols": lambda: features.symbols(g), "files": lambda: features.files(g, now), "paths": lambda: features.changed_paths(g), "hot": lambda: hotspots(g, now, 5).select("id", "score")}
        return written(build[name](), f"{at}/{name}")

    tables = {
        "symbol": lambda: base("symbols"),
        "file": lambda: base("files"),
        "diff": lambda: features.changed(base("files"), base("paths")),
        "touched": lambda: features.touched(base("symbols"), base("paths"), g),
        "user": lambda: features.users(base("paths"), g),
        "change": lambda: of_change(features.changed(base("files"), base("paths"))),
        "leader": lambda: features.leaders(base("symbols"), base("hot")),
        "top": lambda: features.top(base("symbols"), base("files"), base("hot"), g),
        "mutual": lambda: features.mutual(g),
        "repository": lambda: totals(base("symbols"), base("files")),
    }
    found = [of_scope(build(), own, subject(scope)) for scope, build in tables.items() if (own := [r for r in rules if r.scope == scope])]
    return reduce(DataFrame.unionByName, found)
