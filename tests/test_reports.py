"""Reports over logs: merging, scratch repositories, notes, gates; budgets of files; names of unused error handlers."""

import datetime

import pytest
from test_operators import graph, symbol

from loomgraph.operators import reports, structure
from loomgraph.rules.catalogue import RULES

USAGE = "event_id long, ts timestamp, repo string, repo_path string, mode string, tokens int, empty boolean, duration_ms int"
FEEDBACK = "ts timestamp, repo string, repo_path string, mode string, helpful boolean, note string"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def use(i, minutes, repo="r", path="/src/r", mode="focus", tokens=10, empty=False, ms=None):
    return (i, None if minutes is None else at(minutes), repo, path, mode, tokens, empty, ms)


def test_shared_rows_of_known_times_are_left_out(spark):
    own = spark.createDataFrame([use(1, 0), use(2, None)], USAGE)
    shared = spark.createDataFrame([use(3, 0), use(4, 1), use(5, 1), use(6, None)], USAGE)
    assert sorted(r["event_id"] for r in reports.merged(own, shared).collect()) == [1, 2, 4, 5]
    assert sorted(r["event_id"] for r in reports.merged(own.limit(0), shared).collect()) == [3, 4, 5, 6]


def test_scratch_repositories_are_left_out(spark):
    rows = [use(1, 0, "tmpabc"), use(2, 0, "tmp" + "x" * 17), use(3, 0, path="/tmp/x"), use(4, 0, path="/a/pytest-1"), use(5, 0, None, None), use(6, 0, "mytmp")]
    assert sorted(r["event_id"] for r in reports.real(spark.createDataFrame(rows, USAGE)).collect()) == [2, 5, 6]


def test_report(spark):
    rows = [use(1, 0, tokens=10, ms=5), use(2, 1, tokens=None, empty=True, ms=8), use(3, 2, tokens=13), use(4, 3, mode="stats", ms=100), use(5, 4, None, mode=None, tokens=None)]
    said = [(at(i), "r", "/src/r", "focus" if i else None, i % 2 == 0 if i else None, f"n{i} " + "x" * 200 if i != 3 else "") for i in range(7)]
    found = {(r["section"], r["item"][:12]): (r["n"], r["value"]) for r in reports.usage_report(spark.createDataFrame(rows, USAGE), spark.createDataFrame(said, FEEDBACK)).where("section <> 'note'").collect()}
    assert found == {
        ("repo", "r"): (4, None), ("repo", "unknown"): (1, None), ("total", ""): (4, 1), ("mode", "focus"): (3, 11), ("mode", "unknown"): (1, None), ("empty", "focus"): (1, 33.333333), ("duration", ""): (100, 37),
        ("feedback", "helpful"): (3, None), ("feedback", "unhelpful"): (4, None), ("unhelpful", "focus"): (3, None), ("unhelpful", "unknown"): (1, None),
    }
    notes = [r["item"] for r in reports.usage_report(spark.createDataFrame(rows, USAGE), spark.createDataFrame(said, FEEDBACK)).where("section = 'note'").orderBy("n").collect()]
    assert [n[:13] for n in notes] == ["[-] focus: n1", "[+] focus: n2", "[+] focus: n4", "[-] focus: n5", "[+] focus: n6"] and all(len(n) == 111 for n in notes)
    none = spark.createDataFrame([], USAGE), spark.createDataFrame([], FEEDBACK)
    assert reports.usage_report(*none).collect() == [] and reports.mode_effectiveness(*none).collect() == []


@pytest.mark.parametrize("n,shown", [(9, False), (10, True)])
def test_modes_are_compared_from_ten_sessions_on(spark, n, shown):
    rows = [use(i, 21 * i, path="/src/a" if i < 7 else "/src/b", tokens=i and 3 + i % 2) for i in range(n)] + [use(99, 9999, mode="report"), use(98, 9999, path="/x/pytest-of-me"), use(97, None)]
    said = [(at(0), "r", "/src/a", m, h, None) for m, h in (("focus", True), ("focus", None), ("focus", True), ("dead", True), ("dead", True), (None, True), ("prepare", True), ("prepare", True))] + [(at(0), "r", "/tmp/q", "dead", True, None)]
    found = [tuple(r) for r in reports.mode_effectiveness(spark.createDataFrame(rows, USAGE), spark.createDataFrame(said, FEEDBACK)).collect()]
    assert sorted(found, key=str) == ([("mode", "focus", 3, 0.666667, 3), ("repo", "/src/a", 7, None, None), ("repo", "/src/b", 3, None, None)] if shown else [])


def test_budget_of_files(spark):
    g = graph(spark, [symbol(f"m/f{i:02}.py", "f") for i in range(30)] + [symbol("n/a.py", "f")], [])
    assert sorted((r["file_path"], r["running"]) for r in structure.token_budget(g, 3).collect()) == [("m/f00.py", 1), ("m/f01.py", 2), ("m/f02.py", 3), ("n/a.py", 1)]
    empty = graph(spark, [(*symbol("m/a.py", "f")[:-1], None), (*symbol("m/b.py", "f")[:-1], 0), (*symbol("m/c.py", "f")[:-1], 401)], [])
    assert sorted((r["file_path"], r["tokens"], r["running"]) for r in structure.token_budget(empty, 3).collect()) == [("m/a.py", 1, 1), ("m/b.py", 1, 2)]


@pytest.mark.parametrize("name,meets", [("parse_error", True), ("my_error_handler_2", True), ("handle_it", True), ("errors", False), ("Parse_Error", False), ("error", False)])
def test_names_of_unused_error_handlers(spark, name, meets):
    rule = next(r for r in RULES if r.id == "S202")
    row = spark.createDataFrame([(name, name.lower(), 50, "a.py", False, "function")], "name string, low string, confidence int, file_path string, is_test boolean, kind string")
    assert (row.where(rule.condition).count() == 1) == meets
