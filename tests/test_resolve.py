"""Which symbol a name leads to: scopes, class families, hot names."""

from test_operators import symbol

from loomgraph.model import EDGE_SCHEMA, SYMBOL_SCHEMA
from loomgraph.operators import resolve


def method(path, cls, name, exported=True):
    return (f"{path}::{cls}.{name}", name, f"{cls}.{name}", "method", "python", path, 1, 5, "", "", f"{path}::{cls}", exported, 1, 100)


def resolved(spark, symbols, edges, imports=(), names=()):
    made = resolve.resolve_names(
        spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame(symbols, SYMBOL_SCHEMA), spark.createDataFrame(list(imports), "file_path string, target string"), spark.createDataFrame(list(names), "file_path string, name string")
    )
    return {(r["kind"], r["source_id"], r["line"]): r["target_id"] for r in made.collect()}


def test_scopes_in_order(spark):
    rows = [symbol(p, "get", exported=p != "a.py") for p in ("a.py", "b.py", "c.py", "own.py")] + [symbol(p, "user") for p in ("x.py", "y.py", "z.py", "w.py", "own.py")]
    edges = [("calls", f"{p}::user", "get", 1) for p in ("x.py", "y.py", "z.py", "w.py", "own.py")] + [("calls", "x.py::user", "nothing", 2), ("contains", "x.py", "get", 0)]
    found = resolved(spark, rows, edges, imports=[("x.py", "c.py"), ("y.py", "c.py"), ("y.py", "b.py")], names=[("x.py", "get"), ("z.py", "get")])
    assert found == {
        ("calls", "x.py::user", 1): "c.py::get",  # an imported name in an imported file
        ("calls", "y.py::user", 1): "b.py::get",  # imported files, the least id
        ("calls", "z.py::user", 1): "a.py::get",  # an imported name from anywhere
        ("calls", "w.py::user", 1): "b.py::get",  # exported
        ("calls", "own.py::user", 1): "own.py::get",
        ("calls", "x.py::user", 2): "nothing", ("contains", "x.py", 0): "get",
    }


def test_methods_of_self_by_family(spark):
    classes = [symbol(p, c, "class") for p, c in (("m.py", "Mixin"), ("f.py", "Parser"), ("s.py", "Other"), ("b.py", "Base"), ("n.py", "Mixin"))]
    methods = [
        method("m.py", "Mixin", "go"), method("m.py", "Mixin", "own"), method("b.py", "Base", "root"), method("f.py", "Parser", "run"), method("s.py", "Other", "aside"), method("n.py", "Mixin", "far"),
        symbol("m.py", "local"), symbol("f.py", "go"),
    ]
    family = [("inherits", "f.py::Parser", "m.py::Mixin", 1), ("inherits", "f.py::Parser", "Other", 2), ("inherits", "m.py::Mixin", "Base", 3)]
    asked = ["own", "far", "root", "run", "aside", "local", "missing"]
    edges = family + [("calls", "m.py::Mixin.go", f"self.{b}", i) for i, b in enumerate(asked)] + [("calls", "m.py::local", "self.own", 9)]
    found = resolved(spark, classes + methods, edges)
    assert [found["calls", "m.py::Mixin.go", i] for i in range(len(asked))] == [
        "m.py::Mixin.own", "n.py::Mixin.far", "b.py::Base.root", "f.py::Parser.run", "s.py::Other.aside", "m.py::local", "self.missing",
    ]
    assert found["calls", "m.py::local", 9] == "self.own"  # no class around it
    assert found["inherits", "f.py::Parser", 2] == "s.py::Other" and found["inherits", "m.py::Mixin", 3] == "b.py::Base"


def test_methods_of_types(spark):
    rows = [symbol("a.py", "Shop", "class"), symbol("a.py", "helper"), method("b.py", "Till", "open"), symbol("b.py", "Till", "class"), symbol("c.py", "user")]
    edges = [("calls", "c.py::user", t, i) for i, t in enumerate(("Till.open", "Shop.open", "helper.open", "unknown.open"))]
    found = resolved(spark, rows, edges)
    assert [found["calls", "c.py::user", i] for i in range(4)] == ["b.py::Till.open", "b.py::Till.open", "helper.open", "unknown.open"]


def test_a_name_that_most_edges_ask_for(spark):
    rows = [symbol(f"f{i:04}.py", "get") for i in range(300)] + [symbol("u.py", f"u{i}") for i in range(40)] + [symbol("u.py", "rare")]
    edges = [("calls", f"f{i:04}.py::get", "get", i) for i in range(300)] + [("calls", f"v{i}.py::v", "get", i) for i in range(1500)] + [("calls", "v0.py::v", "rare", 1)] * 3
    found = resolved(spark, rows, edges)
    assert all(found["calls", f"f{i:04}.py::get", i] == f"f{i:04}.py::get" for i in range(300)) and all(found["calls", f"v{i}.py::v", i] == ("f0000.py::get") for i in range(2, 1500))
    assert found["calls", "v0.py::v", 1] == "u.py::rare"
