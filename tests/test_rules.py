"""The rule catalogue: names are single, conditions meet the files that they are made for, and leave others alone."""

import datetime

import pytest

from loomgraph.rules.catalogue import RULES
from loomgraph.rules.evaluate import of_scope

FILE = "file_path string, base string, stem string, is_test boolean, importers long, test_importers long, symbols long, exported long, exported_fns long, exported_api long, classes long, constants long, functions long, lines long, imports long, max_cx int, commits long, days int"


def _file(path, **more):
    base = path.rsplit("/", 1)[-1].lower()
    row = dict.fromkeys((c.split()[0] for c in FILE.split(", ")), 0)
    return row | {"file_path": path, "base": base, "stem": base.rsplit(".", 1)[0], "is_test": base.startswith("test_"), "days": None, "symbols": 1, "exported": 1} | more


def _fired(spark, rows):
    rules = [r for r in RULES if r.mode == "blast" and r.scope == "file"]
    names = [c.split()[0] for c in FILE.split(", ")]
    found = of_scope(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FILE), rules, "file_path").collect()
    return {r["rule"].split(".")[1]: r["n"] for r in found}


def test_names_are_single_and_known():
    names = [r.name for r in RULES]
    assert len(set(names)) == len(names)
    assert all(r.id[1:].isdigit() for r in RULES)


@pytest.mark.parametrize(
    "path,ids",
    [
        ("a/user_auth.py", {"S884", "S1004"}),
        ("a/author.py", {"S884"}),  # the word is inside another, so only the rule on parts fires
        ("a/json_codec.py", {"S872", "S1010"}),
        ("a/b/c/main.py", {"S217", "S554", "S674", "S710", "S794"}),
        ("src/api/v1.py", {"S860"}),
        ("core/x.py", {"S578"}),
        ("migrations/0001.py", {"S968"}),
        ("a/_utils.py", {"S722", "S788", "S932"}),
        ("a/mock_query.py", set()),
        ("a/env.py", {"S515", "S770", "S812", "S842", "S986"}),
        ("plain.py", set()),
    ],
)
def test_file_families(spark, path, ids):
    quiet = {"S290"}  # nothing imports the file
    assert set(_fired(spark, [_file(path)])) - quiet == ids


def test_counts_of_files(spark):
    rows = [
        _file("a/x.py", importers=12, test_importers=2, lines=501, symbols=30, exported=20, exported_fns=20, exported_api=20),
        _file("a/y.py", importers=1, test_importers=1),
        _file("a/z.py", exported=0),
        _file("a/k.py", importers=1, symbols=5, constants=5),
    ]
    found = _fired(spark, rows)
    assert {i: found.get(i) for i in ("S183", "S413", "S459", "S527", "S572", "S662", "S776", "S836", "S908")} == dict.fromkeys(("S183", "S413", "S459", "S527", "S572", "S662", "S776", "S836", "S908"), 1)
    assert (found["S467"], found["S560"], found["S237"], found["S473"], found["S511"]) == (1, 1, 1, 1, 2)
    assert "S290" not in found


def test_no_rows_no_rules(spark):
    assert _fired(spark, []) == {}


SYMBOL = "id string, name string, low string, kind string, file_path string, is_test boolean, confidence int, parent_id string, callers long, file_importers long, doc string, signature string, exported boolean, lines long, renderers long"


def _dead(spark, *rows):
    """Ids of the rules on unused functions that fire on (name, confidence, more)."""
    rules = [r for r in RULES if r.mode == "dead" and r.scope == "symbol"]
    names = [c.split()[0] for c in SYMBOL.split(", ")]
    plain = {"kind": "function", "file_path": "a/x.py", "is_test": False, "parent_id": None, "callers": 0, "file_importers": 1, "doc": "", "signature": "", "exported": False, "lines": 3, "renderers": 0}
    full = [plain | {"id": f"a/x.py::{n}", "name": n, "low": n.lower(), "confidence": c} | more for n, c, more in rows]
    found = of_scope(spark.createDataFrame([tuple(r[n] for n in names) for r in full], SYMBOL), rules, "id").collect()
    return {r["rule"].split(".")[1] for r in found}


def test_unused_functions(spark):
    two = [("cron_a", 30, {}), ("cron_b", 30, {})]
    assert {"S341", "S420", "S965"} <= _dead(spark, *two)
    # one alone, too little confidence, or in tests
    assert not {"S341", "S420"} & _dead(spark, two[0])
    assert not {"S341", "S420"} & _dead(spark, *[(n, 29, {}) for n, _, _ in two])
    assert not {"S341", "S420", "S965"} & _dead(spark, *[(n, c, {"is_test": True}) for n, c, _ in two])
    # names as written and a confidence of 40
    assert "S270" in _dead(spark, ("on_message", 40, {}), ("on_x", 40, {}))
    assert "S270" not in _dead(spark, ("ON_message", 40, {}), ("on_x", 40, {}))
    assert "S270" not in _dead(spark, ("on_message", 39, {}), ("on_x", 40, {}))
    # methods count only where the family allows
    assert "S965" not in _dead(spark, *[(n, c, {"parent_id": "p", "kind": "method"}) for n, c, _ in two])
    # a single one is enough, at any confidence
    assert {"S767", "S893"} <= _dead(spark, ("find_it", 0, {"exported": True}))
    assert {"S551"} <= _dead(spark, ("do_a", None, {"file_importers": 0}), ("do_b", None, {"file_importers": 0}))
    assert "S551" not in _dead(spark, ("do_a", None, {"file_importers": 0}), ("do_b", None, {}))


def _graph(spark, symbols, imports=(), inherits=(), calls=(), change=()):
    """A graph of (path, name, kind, more) and of edges between paths or ids."""
    from loomgraph.model import EDGE_SCHEMA, SYMBOL_SCHEMA, CodeGraph

    names = [c.strip().split()[0] for c in SYMBOL_SCHEMA.split(",")]
    plain = {"language": "python", "line_start": 1, "line_end": 4, "signature": "def f()", "doc": "", "parent_id": None, "exported": True, "complexity": 1, "byte_size": 10}
    rows = [plain | {"id": f"{p}::{n}", "name": n, "qualified_name": n, "kind": k, "file_path": p} | more for p, n, k, more in symbols]
    edges = [(kind, a, b, 1) for kind, pairs in (("imports", imports), ("inherits", inherits), ("calls", calls)) for a, b in pairs]
    commits = spark.createDataFrame([(1, datetime.date(2024, 1, 1), p) for p in change], "commit_id long, day date, path string")
    return CodeGraph(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SYMBOL_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), commits)


def _overview(spark, *args, **more):
    from loomgraph.rules.evaluate import fired

    rules = [r for r in RULES if r.mode == "overview"]
    return {r["rule"].split(".")[1]: (r["n"], r["sample"]) for r in fired(_graph(spark, *args, **more), "2024-01-01", rules).collect()}


def test_overview_of_nothing(spark):
    assert _overview(spark, []) == {}


def test_overview_without_tests(spark):
    symbols = [(f"m{i}.py", f"f{j}", "function", {}) for i in range(8) for j in range(2)]
    symbols += [("m0.py", "A", "class", {}), ("m1.py", "B", "class", {}), ("m2.py", "C", "class", {})]
    found = _overview(
        spark, symbols, imports=[("m0.py", "m1.py"), ("m1.py", "m0.py"), ("m2.py", "m1.py")], inherits=[("m0.py::A", "m1.py::B"), ("m1.py::B", "m2.py::C")], calls=[("m3.py::f0", "m4.py::f1")]
    )
    # no tests, all at the root, small files, little coupling, nothing documented
    assert {"S82", "S100", "S547", "S667", "S871", "S967", "S391", "S259", "S421", "S733", "S901", "S961", "S588", "S781", "S286", "S679", "S203", "S877", "S607", "S520", "S463", "S721", "S919", "S829", "S841", "S937"} <= set(found)
    # one pair of files imports each other, one class has a grandparent
    assert found["S185"] == found["S613"] == found["S895"] == (1, "m0.py")
    assert found["S643"] == (1, "m0.py::A")
    # five exported functions, yet classes are exported as well; imports exist; one language only
    assert not {"S631", "S594", "S582", "S625", "S805", "S979", "S763", "S213", "S151"} & set(found)
    # a call makes the count of uncalled symbols smaller
    assert "S86" not in found


def test_overview_of_shares(spark):
    tests = [(f"t/test_{i}.py", "test_a", "function", {"line_end": 200}) for i in range(6)]
    sources = [("a/x.py", f"f{j}", "function", {"line_end": 60, "complexity": 12, "doc": "told"}) for j in range(6)] + [(f"b/{n}.go", n, "function", {"language": "go", "doc": "told"}) for n in ("y", "z")]
    found = _overview(spark, tests + sources)
    assert {"S213", "S565", "S823", "S913", "S373", "S883", "S1015", "S673"} <= set(found)
    # nine files are too few for S532, one wide file of three too few for S859, and all exports are documented
    assert not {"S532", "S859", "S348", "S547", "S322", "S203", "S877", "S588", "S973"} & set(found)
    # one test file less, and there are less than two a source
    assert "S823" not in _overview(spark, tests[:5] + sources)


def _diff(spark, change, symbols, **more):
    from loomgraph.rules.evaluate import fired

    return {r["rule"].split(".")[1]: (r["n"], r["sample"]) for r in fired(_graph(spark, symbols, change=change, **more), "2024-01-02", [r for r in RULES if r.mode == "diff"]).collect()}


def test_change_of_documents(spark):
    found = _diff(spark, ["README.md", "docs/a.md", "docs/b.rst", "docs/c/d.txt", "x/CHANGELOG.md"], [("a/x.py", "f", "function", {})])
    # paths that the graph doesn't know take part
    assert {"S308", "S885", "S1005", "S375", "S699", "S687", "S771", "S879", "S837", "S957", "S909"} <= set(found)
    assert found["S669"] == (5, "README.md") and found["S783"][0] == 5 and found["S596"] == (2, "README.md")
    assert not {"S681", "S705", "S903", "S819", "S999", "S717", "S447", "S540", "S199", "S78"} & set(found)


def test_change_of_code(spark):
    change = ["a/x.py", "a/test_x.py", "b/__init__.py", "c/y.go", "deploy.yml"]
    symbols = [("a/x.py", "f", "function", {"complexity": 10, "line_end": 600}), ("a/x.py", "BaseThing", "class", {}), ("a/test_x.py", "test_f", "function", {}), ("c/y.go", "g", "function", {"language": "go"})]
    symbols += [(f"u/{i}.py", "h", "function", {}) for i in range(5)]
    found = _diff(spark, change, symbols, calls=[(f"u/{i}.py::h", "a/x.py::f") for i in range(5)])
    assert found["S127"] == (1, "a/x.py::f") and found["S187"] == (1, "a/x.py::f") and found["S163"] == (5, "u/0.py") and found["S485"] == (1, "a/x.py::BaseThing")
    assert {"S149", "S135", "S465", "S741", "S627", "S777", "S573", "S747", "S951", "S819", "S78", "S783"} <= set(found)
    # four callers elsewhere aren't five, and f has a caller
    assert not {"S1028", "S160", "S639", "S308", "S681", "S181", "S205", "S753"} & set(found)
