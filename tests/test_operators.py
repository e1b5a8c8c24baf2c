"""Micro-graphs at the thresholds of rules, and properties of iterative operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.model import EDGE_SCHEMA, SYMBOL_SCHEMA, CodeGraph
from loomgraph.operators import focus, history, lookup, scoring, search, telemetry, traverse


def symbol(path, name, kind="function", exported=True, parent=None, lines=(1, 5), cx=1, doc=""):
    return (f"{path}::{name}", name, name, kind, "python", path, *lines, f"def {name}()", doc, parent, exported, cx, 100)


def graph(spark, symbols, edges, commits=()):
    return CodeGraph(
        spark.createDataFrame(symbols, SYMBOL_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame(list(commits), "commit_id long, day string, path string").selectExpr("commit_id", "cast(day as date) day", "path")
    )


@pytest.mark.parametrize("callers,outside,risk", [(8, 0, "HIGH"), (7, 0, "LOW"), (3, 3, "HIGH"), (2, 1, "MEDIUM"), (1, 1, "LOW")])
def test_rename_risk(spark, callers, outside, risk):
    rows = [symbol("a.py", "f")] + [symbol(f"x{i}.py" if i < outside else "a.py", f"c{i}") for i in range(callers)]
    g = graph(spark, rows, [("calls", r[0], "a.py::f", 1) for r in rows[1:]])
    assert lookup.rename_risk(g).where("id = 'a.py::f'").first()["risk"] == risk


def test_dead_code_rules(spark):
    rows = [
        symbol("a.py", "used"), symbol("a.py", "unused"), symbol("a.py", "hidden", exported=False), symbol("a.py", "main"),
        symbol("a.py", "C", "class"), symbol("a.py", "m", "method", parent="a.py::C"), symbol("b.py", "D", "class"), symbol("b.py", "n", "method", parent="b.py::D"),
    ]
    edges = [("calls", "b.py::n", "a.py::used", 1), ("calls", "b.py::n", "a.py::C", 2), ("contains", "a.py::C", "a.py::m", 0), ("contains", "b.py::D", "b.py::n", 0), ("calls", "a.py", "b.py::D", 0)]
    g = graph(spark, rows, edges)
    # D is called by a file, which is a reference but not one across files: its member isn't dead, nor is D
    assert {r["id"] for r in scoring.dead_code(g).collect()} == {"a.py::unused", "a.py::m"}
    assert {r["id"]: r["tier"] for r in scoring.dead_confidence(g).collect()} == {"a.py::unused": "medium", "a.py::m": "medium"}


def test_layers_follow_imports_and_cycles_come_last(spark):
    edges = [("imports", a, b, 0) for a, b in (("c", "b"), ("b", "a"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "x"))]
    g = graph(spark, [symbol("a", "f")], edges)
    found = {r["file_path"]: r["layer"] for r in traverse.layers(g).collect()}
    assert found == {"a": 0, "b": 1, "d": 1, "c": 2, "x": 3, "y": 3, "z": 3}
    assert [(r["cycle"], r["length"]) for r in traverse.cycles(g).collect()] == [("x > y", 2)]


def test_cochange_properties(spark):
    commits = [(i, "2001-01-01", p) for i in range(4) for p in ("a", "b")] + [(9, "2001-01-02", "c"), (10, "2001-01-02", "a"), (10, "2001-01-02", "c")]
    g = graph(spark, [symbol("a", "f")], [], commits)
    g = CodeGraph(g.symbols, spark.createDataFrame([], EDGE_SCHEMA), g.commit_files)
    rows = history.cochange(g).collect()
    assert {(r["path"], r["partner"], r["frequency"]) for r in rows} == {("a", "b", 1.0), ("b", "a", 1.0)}
    assert all(0 < r["frequency"] <= 1 and r["rank"] <= 10 and r["path"] != r["partner"] for r in rows)


def test_session_gap_is_strict(spark):
    rows = [(1, "2024-01-01 23:50:00", "a"), (2, "2024-01-02 00:10:00", "b"), (3, "2024-01-02 00:30:01", "a"), (4, "2024-01-04 00:00:00", "c")]
    u = spark.createDataFrame(rows, "event_id long, ts string, mode string").selectExpr("event_id", "cast(ts as timestamp) ts", "mode", "1L repo", "1 tokens", "false empty")
    assert [r["session"] for r in telemetry.sessions(u).orderBy("event_id").collect()] == [1, 1, 2, 3]
    assert {(r["state"], r["next"]): r["n"] for r in telemetry.markov1(u, 1).collect()} == {("a", "b"): 1, ("b", "a"): 1, ("a", "c"): 1}


def test_search_prefers_exact_names(spark):
    g = graph(spark, [symbol("a.py", "parse_file"), symbol("b.py", "parse_file_list"), symbol("c.py", "other", doc="parse")], [("calls", "a.py::parse_file", "c.py::other", 1)])
    assert [r["id"] for r in search.search(g, "parse_file").collect()][0] == "a.py::parse_file"
    assert search.query_tokens("fix buildGraph in the parser") == ["buildgraph", "parser", "build", "graph"]


def test_question_routes():
    assert lookup.route("who calls parse_file?") == ("callers", "parse_file")
    assert lookup.route("where is the Parser defined?") == ("where", "Parser")
    assert lookup.route("parse things") == ("search", "parse things")


@pytest.mark.parametrize("path,test,simple", [("a/test_x.py", True, True), ("a/x_test.py", True, True), ("conftest.py", True, False), ("a/x.test.tsx", True, False), ("a/contest.py", False, False)])
def test_test_predicates(spark, path, test, simple):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(path,)], "p string").select(paths.is_test(F.col("p")), paths.is_test_simple(F.col("p"))).first()
    assert tuple(row) == (test, simple)


@pytest.mark.parametrize("files,callees,hot,depth", [(15, 9, True, 2), (14, 5, False, 3), (14, 5, True, 4), (3, 6, False, 4), (3, 6, True, 5), (4, 6, False, 3)])
def test_adaptive_depth(spark, files, callees, hot, depth):
    assert spark.range(1).select(focus.adaptive_depth(*map(F.lit, (files, callees, hot)))).first()[0] == depth


def test_focus_without_a_depth_goes_one_further_where_sparse(spark):
    chain = [symbol(f"m{i}.py", f"f{i}") for i in range(8)]
    g = graph(spark, chain, [("calls", f"m{i}.py::f{i}", f"m{i + 1}.py::f{i + 1}", 1) for i in range(7)])
    seed = spark.createDataFrame([("m0.py::f0",)], "id string")
    assert focus.profiles(g, seed.withColumn("label", F.lit("x"))).first()["depth"] == 3
    assert {r["depth"] for r in focus.focus(g, seed, 3).collect()} == {0, 1, 2, 3}
    assert {r["depth"] for r in focus.focus(g, seed, None).collect()} == {0, 1, 2, 3, 4}


def test_key_files_demote_hubs(spark):
    from loomgraph.operators import advice

    text = "hub.py " * 5 + "a/x.py a/x.py tests/test_x.py example/e.py none"
    found = lambda t, *words: [(r["path"], r["tier"]) for r in advice.key_files_in(spark.createDataFrame([(t,), (None,)], "text string"), "text", words).collect()]
    assert found(text) == [("a/x.py", 0), ("hub.py", 1), ("tests/test_x.py", 1), ("example/e.py", 2)]
    # a keyword or a shown symbol keeps it first
    assert found(text.replace("hub", "router"), "router")[0] == ("router.py", 0)
    assert found("● f — hub.py:1-2\n" + text)[0] == ("hub.py", 0)
    assert found("nothing here") == []


def test_cycles_by_halves(spark):
    pick = random.Random(4)
    names = [f"f{i}.py" for i in range(9)]
    edges = sorted({(pick.choice(names), pick.choice(names)) for _ in range(45)})
    g = graph(spark, [symbol(f, "f") for f in names], [("imports", *e, 1) for e in edges])
    want = sorted((" > ".join(p), n) for n in range(2, 6) for p in itertools.permutations(names, n) if p[0] == min(p) and all(e in edges for e in zip(p, p[1:] + p[:1])))
    found = traverse.cycles(g, 5)
    assert sorted(map(tuple, found.collect())) == want and {n for _, n in want} == {2, 3, 4, 5}
    # joins are by first and last file: none closes whole paths by their last element
    assert "element_at" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_halves_of_cycles_are_dealt_out_as_numbers(spark):
    names = ["b.py", "a/z.py", "é.py", "B.py"]
    g = graph(spark, [symbol(f, "f") for f in names], [("imports", a, b, 1) for a, b in zip(names, names[1:] + names[:1])])
    found = traverse.cycles(g)
    assert [tuple(r) for r in found.collect()] == [("B.py > b.py > a/z.py > é.py", 4)]
    # no list of paths is kept for a half, and none is shuffled
    assert "array" not in found._jdf.queryExecution().optimizedPlan().toString()
