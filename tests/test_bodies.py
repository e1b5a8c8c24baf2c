"""Signatures, bodies, embeddings and the working copy."""

import subprocess

from test_operators import graph, symbol

from loomgraph.operators import bodies, embed, search
from loomgraph.sources import git

TEXT = "async def f(a: int, b=1, *rest) -> int:\n    # TODO later\n    raise ValueError(a)\n\ndef g(x, y):\n    return x\n"


def test_bodies(spark):
    rows = [symbol("a.py", "f", lines=(1, 3)), symbol("a.py", "g", lines=(5, 6))] + [symbol(f"c{i}.py", f"u{i}") for i in range(3)]
    rows[0] = (*rows[0][:8], "async def f(a: int, b=1, *rest) -> int", *rows[0][9:])
    rows[1] = (*rows[1][:8], "def g(x, y)", *rows[1][9:])
    g = graph(spark, rows, [("calls", f"c{i}.py::u{i}", "a.py::g", 1) for i in range(3)])
    told = bodies.bodies(g, spark.createDataFrame([("a.py", TEXT)], "path string, content string"))
    assert [tuple(r) for r in bodies.notes(told).collect()] == [("a.py::f", 1)]
    assert [r["id"] for r in bodies.async_gaps(told).collect()] == ["a.py::f"]
    assert [tuple(r) for r in bodies.dead_parameters(g, told).collect()] == [("a.py::g", "y")]
    assert [tuple(r) for r in bodies.raised(told).collect()] == [("a.py::f", "ValueError")]
    assert tuple(bodies.signatures(g).where("id = 'a.py::f'").first()) == ("a.py::f", 3, 1, 1, True, True, "int")


def test_embeddings_find_shared_words(spark):
    g = graph(spark, [symbol("a.py", "parse_file"), symbol("b.py", "render_page")], [("calls", "x", "y", 1)])
    rows = embed.embed(g)
    assert embed.embed(g, rows).count() == 0
    query = embed.hashed(["function parse_file"])[0]
    assert search.nearest(rows, query, 1, "symbol_id").first()["symbol_id"] == "a.py::parse_file"


def test_working_copy(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a.py").write_text("1\n")
    run("add", ".")
    run("commit", "-m", "one")
    (tmp_path / "a.py").write_text("2\n")
    assert git.changed(str(tmp_path), "unstaged") == ["a.py"] and git.changed(str(tmp_path), "staged") == [] and git.changed(str(tmp_path)) == ["a.py"]
    git.write_log(str(tmp_path), str(tmp_path / "log"))
    assert "a.py" in (tmp_path / "log").read_text() and git.changed("/nonexistent") == []
