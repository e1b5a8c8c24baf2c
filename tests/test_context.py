"""Gates of prepared contexts and the budget that sections carry on."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import context

FOUND = "task string, keyword string, k int, file string, rank int"


def run(spark, found, fallback=(), baseline=None, **more):
    said = None if baseline is None else spark.createDataFrame([("t", f) for f in baseline], "task string, file string")
    rows = context.gate(spark.createDataFrame(list(found), FOUND), spark.createDataFrame(list(fallback), FOUND + ", way int"), said, **more).collect()
    assert len(rows) == 1
    return rows[0]["how"], rows[0]["files"].split()


def files(keyword, n, k=1):
    return [("t", keyword, k, f"{keyword}{i:02}.py", i + 1) for i in range(n)]


@pytest.mark.parametrize("n,how,kept", [(1, "focus", 1), (8, "focus", 8), (9, "path", 5), (11, "path", 4), (14, "path", 1), (15, "path", 1), (16, "nothing", 0), (40, "nothing", 0)])
def test_breadth(spark, n, how, kept):
    assert run(spark, files("widget", n)) == (how, [f"widget{i:02}.py" for i in range(kept)])


def test_fallbacks_in_order(spark):
    path, defined = ("t", "broad", 1, "by_path.py", 1, 0), ("t", "broad", 1, "defined.py", 1, 1)
    assert run(spark, files("broad", 16), [path, defined]) == ("path", ["by_path.py"])
    assert run(spark, files("broad", 16), [defined]) == ("path", ["defined.py"])
    assert run(spark, files("broad", 12), [defined]) == ("path", ["defined.py"])
    assert run(spark, files("other", 3, 2), [path]) == ("focus", ["by_path.py", "other00.py", "other01.py", "other02.py"])
    assert run(spark, files("other", 3, 2), [defined]) == ("focus", ["other00.py", "other01.py", "other02.py"])  # the keyword isn't broad
    assert run(spark, files("few", 2), [("t", "few", 1, "x.py", 1, 0)]) == ("focus", ["few00.py", "few01.py"])  # a focus needs no fallback
    assert run(spark, files("broad", 16), [("t", "abc", 2, "short.py", 1, 0)]) == ("nothing", [])
    assert run(spark, files("wide", 13, 2), [("t", "none", 1, f"p{i}.py", i, 0) for i in range(7)]) == ("path", [f"p{i}.py" for i in range(5)])


def test_precision_and_baseline(spark):
    assert run(spark, files("widget", 4), precise=True)[0] == "focus" and run(spark, files("widget", 5), precise=True)[0] == "too broad"
    assert run(spark, files("widget", 3), baseline=["a.py", "b.py"]) == ("off the baseline", [])
    assert run(spark, files("widget", 3), baseline=["a.py", "widget02.py"])[0] == "focus"
    assert run(spark, files("widget", 3), baseline=["a.py"])[0] == "focus"  # one predicted file has no say
    assert run(spark, files("widget", 11), baseline=["a.py", "b.py"])[0] == "off the baseline"


def test_budget_is_carried(spark):
    def given(budget, *sections):
        rows = spark.createDataFrame([([*sections],)], "s array<struct<needs: int, share: double>>")
        return rows.select(context.carried(F.col("s"), budget)).first()[0]

    assert given(1000, (300, 1.0), (900, 0.5), (900, 1.0)) == [300, 350, 350]  # blast gets half of what is left
    assert given(1000, (100, 1.0), (100, 0.5), (2000, 1.0)) == [100, 100, 800]  # what isn't used goes on
    assert given(0, (5, 1.0)) == [0] and given(10) == []
