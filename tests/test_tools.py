"""Kits, plugins and text functions."""

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.plans import tools


def test_kit_budgets():
    assert tools.KITS["deep_dive"].budgets(4000) == {"focus": 2400, "blast": 1600}
    assert tools.KITS["code_review"].budgets(240) == {"dead": 200}
    assert tools.load_kits('{"mine": {"steps": ["a", "b"]}, "none": {}}')["mine"].budgets(1000) == {"a": 500, "b": 500}
    assert tools.load_kits("{") == tools.KITS


def test_registry():
    r = tools.registry()
    assert r.disable("focus") == (False, ["context"]) and r.runner("focus") is not None
    assert r.disable("learn") == (True, []) and r.disable("context") == (True, []) and r.disable("focus") == (True, [])
    assert r.runner("focus") is None and r.enable("learn") == ["focus", "context", "learn"]


def test_text(spark):
    row = spark.createDataFrame([("Fix parse_file in Parser, parser and PARSE (#12)", "@@ -1,2 +3,2 @@\nx\n@@ -9 +10 @@\n@@ -1 +20,0 @@", "— a/b.py:3-9 and — c.py:1-2")], "t string, d string, o string")
    got = row.select(text.task_keywords(F.col("t")).alias("k"), text.is_change_task(F.col("t"), F.lit("")).alias("c"), text.hunk_lines(F.col("d")).alias("h"), text.focus_ranges(F.col("o")).alias("r")).first()
    assert got["k"] == ["parse_file", "Parser", "PARSE"] and got["c"] and got["h"] == [3, 4, 10]
    assert [tuple(r) for r in got["r"]] == [("a/b.py", 3, 9), ("c.py", 1, 2)]


def test_task_keywords_by_brute_force(spark):
    import re

    def slow(t):
        out, seen = [], set()
        for w in re.findall(r"\b[A-Z][a-zA-Z0-9]+\b|\b[a-z_][a-z0-9_]{2,}\b", t):
            if w.lower() not in text.TASK_SKIP and w.lower() not in seen and len(w) > 2:
                seen.add(w.lower())
                out.append(w)
        return out

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text", text.task_keywords(F.col("text")).alias("k")).collect()
    assert rows and all(r["k"] == slow(r["text"]) for r in rows)


def test_simple_upper_keeps_one_character_for_each(spark):
    row = spark.createDataFrame([("straße, déjà", "ᾀŉ", None)], "a string, b string, c string")
    assert tuple(row.select(*[text.simple_upper(F.col(c)) for c in "abc"]).first()) == ("STRAẞE, DÉJÀ", "ᾈŉ", None)
