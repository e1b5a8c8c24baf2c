"""Logs, caches, exports and keywords."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.keywords import change_keywords, changes_no_source
from loomgraph.model import EDGE_SCHEMA, SYMBOL_SCHEMA, CodeGraph
from loomgraph.operators import advice
from loomgraph.operators.structure import holders
from loomgraph.sources import files, logs
from loomgraph.streaming import ingest


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("COMMIT_SEP a1 86400\n\nx.py\ny.py\nx.py\nCOMMIT_SEP b2 oops\nz.py\nCOMMIT_SEP c3 172800\n")
    assert sorted((r["commit_id"], str(r["day"]), r["path"]) for r in logs.commits(spark, str(tmp_path / "log")).collect()) == [("a1", "1970-01-02", "x.py"), ("a1", "1970-01-02", "y.py")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"mode": "focus", "tokens": 3, "other": 1}\nnot json\n{"mode": "blast"}\n')
    rows = logs.json_lines(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r["mode"], r["tokens"]) for r in rows.collect()) == [("blast", None), ("focus", 3)]
    logs.append_json(rows, str(tmp_path / "out"))
    logs.append_json(rows, str(tmp_path / "out"))
    assert logs.json_lines(spark, str(tmp_path / "out")).count() == 4


def test_parse_cache_and_export(spark, tmp_path):
    names = [f.split(" ")[0] for f in SYMBOL_SCHEMA.split(", ")]
    symbol = dict(zip(names, ("a.py::f", "f", "f", "function", "python", "a.py", 1, 2, "def f()", "", None, True, 1, 9)))
    (tmp_path / "cache.json").write_text(json.dumps({"version": 2, "files": {"a.py": {"hash": "h", "symbols": [symbol], "edges": [], "imports": ["import x"]}}}))
    row = logs.parse_cache(spark, str(tmp_path / "cache.json")).first()
    assert row["path"] == "a.py" and row["symbols"][0]["id"] == "a.py::f" and row["imports"] == ["import x"]
    g = CodeGraph(spark.createDataFrame([tuple(symbol.values())], SYMBOL_SCHEMA), spark.createDataFrame([("calls", "a.py::f", "a.py::f", 1)], EDGE_SCHEMA))
    assert sorted(r["what"] for r in logs.export(g).collect()) == ["edge", "file", "symbol"]
    assert logs.folder_notes(g).first()["note"] == "- a.py: 1 symbols, 1 exported"
    logs.save(g, str(tmp_path / "graph"))
    again = logs.load(spark, str(tmp_path / "graph"), history=False)
    assert again.edges.collect() == g.edges.collect() and again.symbols.collect() == g.symbols.collect()


@pytest.mark.parametrize("task,want", [
    ("Merge pull request #12 from me/reply-not-found", ["ReplyNotFound"]), ("Merge pull request #12 from me/master\n\nBody words", []), ("Merge pull request #1 from me/docs-view", []),
    ("Merge branch 'stable'", []), ("Merge branch 'feature/add-redis-caching'", ["AddRedisCaching", "Caching"]), ("feat(StreamMiddleware): deprecate `should_ignore_error`", ["should_ignore_error", "StreamMiddleware", "deprecate"]),
    ("Merge pull request #7 from me/fix-31\n\nKeep `parse_body` in RequestParser for https://x.y/z", ["parse_body", "RequestParser", "Keep"]),
    ("fix: update handleRequest to keep MAX_SIZE", ["MAX_SIZE", "handleRequest", "keep"]), (None, []), ("", []),
])
def test_change_keywords(task, want):
    assert change_keywords(task) == want


@pytest.mark.parametrize("task,want", [
    ("Merge pull request #9 from me/docs/view", True), ("Merge pull request #9 from me/docstring-update", False), ("Merge branch 'x' into docs/y", True), ("Merge branch 'release-1.2' into main", True),
    ("Merge pull request #9 from me/fix-10\n\nPin versions of dependencies", True), ("Merge pull request #9 from me/fix-10\n\nPin the parser", False), ("add docs", False), (None, False),
])
def test_changes_no_source(spark, task, want):
    assert spark.createDataFrame([(task,)], "t string").select(changes_no_source(F.col("t"))).first()[0] is want


def test_substring_join_by_brute_force(spark):
    stems, names = ["parser", "a", "ab", "", "x_y", "zzz"], ["test_parsers.py", "ab_test.py", "test_x_y_z.py", "b.py"]
    frame = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {tuple(r) for r in holders(frame(stems, "stem"), frame(names, "name")).collect()}
    assert got == {(s, n) for s in stems for n in names if s and s in n}


def test_path_fallback_parts_and_coverage(spark):
    paths = ["src/stream.py", "src/loader_stream.py", "tests/stream.py", "static/stream.py", *[f"src/config_{i}.py" for i in range(6)]]
    names = [f.split(" ")[0] for f in SYMBOL_SCHEMA.split(", ")]
    rows = [tuple({"id": f"{f}::g{i}", "name": f"g{i}", "file_path": f}.get(n) for n in names) for i, f in enumerate(paths)]
    g = CodeGraph(spark.createDataFrame(rows, SYMBOL_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    found = lambda k: sorted(r[0] for r in advice.path_fallback(g, k).collect())
    assert found("Stream") == found("RequestStreamSupport") == found("config_stream") == ["src/loader_stream.py", "src/stream.py"]
    assert found("config") == [] and found("nothing_here") == []
    assert tuple(advice.coverage(g, ["G1", "g2", "h"], g.symbols.where("name = 'g1'")).first()) == (2, 3, 0.666667, 1, "medium")


def test_snapshots_by_name(spark, tmp_path):
    g = CodeGraph(spark.createDataFrame([], SYMBOL_SCHEMA), spark.createDataFrame([("calls", "a", "b", 1)], EDGE_SCHEMA))
    logs.publish(g, str(tmp_path), "me/tool")
    assert [r["repo"] for r in logs.snapshots(spark, str(tmp_path)).collect()] == ["me/tool"]
    assert logs.snapshot(spark, str(tmp_path), "me/tool").edges.count() == 1
    with pytest.raises(KeyError, match="me/tool"):
        logs.snapshot(spark, str(tmp_path), "me/other")
    with pytest.raises(ValueError):
        logs.snapshot_folder("x", "me/../tool")


def test_watch_keeps_a_store_up_to_date(spark, tmp_path):
    root = tmp_path / "src"
    (root / ".git").mkdir(parents=True)
    (root / "a.py").write_text("x = 1\n")
    (root / ".git" / "b.py").write_text("no")
    told = []
    store = ingest.Store(spark, str(tmp_path / "store"), "path string, hash string, content binary")

    def once():
        ingest.follow(files.watch(spark, str(root), (".py",)), store, str(tmp_path / "at"), lambda rows: told.extend(r["path"] for r in rows.collect()), every=None).awaitTermination()
        return {r["path"]: bytes(r["content"]).decode() for r in store.read().collect()}

    assert once() == {"a.py": "x = 1\n"}
    (root / "c.py").write_text("y = 2\n")
    assert once() == {"a.py": "x = 1\n", "c.py": "y = 2\n"} and told == ["a.py", "c.py"]
