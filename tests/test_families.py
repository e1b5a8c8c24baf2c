"""Series without gaps, sibling families, and the five factors of exposure."""

from test_operators import graph, symbol

from loomgraph.operators import families


def test_series_without_gaps(spark):
    names = ["step_part_a", "step_part_b", "step_part_c", "phase_1", "phase_2", "phase_3", "round_1", "round_3", "round_7", "ab_1", "ab_2", "render_x", "__pre_9", "stage_a", "stage_1", "level_09", "level_10", "level_11"]
    rows = [symbol("m.py", n) for n in names] + [symbol("m.py", "phase_4", "class"), symbol("o.py", "phase_5"), symbol("tests/test_m.py", "phase_1"), symbol("tests/test_m.py", "phase_2")]
    g = graph(spark, rows, [])
    found = {(r["file_path"], r["base"], r["series"]): (r["total"], r["longest_run"]) for r in families.variant_groups(g).collect()}
    assert found == {
        ("m.py", "step_part", "A/B series"): (3, 3), ("m.py", "phase", "numeric series"): (3, 3), ("m.py", "round", "numeric series"): (3, 1), ("m.py", "level", "numeric series"): (3, 3),
    }
    assert {r["base"] for r in families.unbroken_series(g).collect()} == {"step_part", "phase", "level"}


def test_sibling_families(spark):
    rows = [symbol("pkg/a.py", "render_one"), symbol("pkg/a.py", "render_own"), *(symbol(f"pkg/{c}.py", f"render_{c}") for c in "bcd"), symbol("other/e.py", "render_e"), symbol("pkg/test_f.py", "render_f"), symbol("pkg/b.py", "renderer"), symbol("pkg/b.py", "set_b")]
    found = {r["id"]: (r["stem"], r["siblings"]) for r in families.sibling_families(graph(spark, rows, [])).collect()}
    assert found == {"pkg/a.py::render_one": ("render", 3), "pkg/a.py::render_own": ("render", 3), **{f"pkg/{c}.py::render_{c}": ("render", 4) for c in "bcd"}}


def exposed(spark, edges, hot=(), ids=()):
    names = sorted({x for e in edges for x in e} | {"s.py::seed"} | set(ids))
    g = graph(spark, [symbol(*x.split("::")) for x in names], [("calls", a, b, 1) for a, b in edges])
    rows = families.exposure(g, spark.createDataFrame([(p,) for p in hot], "path string")).where("id = 's.py::seed'").collect()
    return rows[0]["level"] if rows else ""


def test_exposure_by_factors(spark):
    callers = lambda n: [(f"c{i}.py::c", "s.py::seed") for i in range(n)]
    callees = lambda n: [("s.py::seed", f"d{i}.py::d") for i in range(n)]
    tested = lambda n: [(f"tests/test_d{i}.py::t", f"d{i}.py::d") for i in range(n)]
    assert exposed(spark, callers(7)) == "" and exposed(spark, callers(8)) == "MEDIUM"
    assert exposed(spark, callees(2)) == "" and exposed(spark, callees(3)) == "MEDIUM" and exposed(spark, callees(3) + tested(2)) == "" and exposed(spark, callees(4) + tested(2)) == "MEDIUM"
    assert exposed(spark, callers(8) + callees(3)) == "HIGH"
    assert exposed(spark, callers(8) + callees(3), ["s.py"]) == "CRITICAL"
    assert exposed(spark, callers(3), ["c0.py", "c1.py"]) == "" and exposed(spark, callers(3), ["c0.py", "c1.py", "c2.py"]) == "MEDIUM"
    assert exposed(spark, callees(2), ["d0.py", "d1.py"]) == "MEDIUM"
    assert exposed(spark, [(f"tests/test_{i}.py::t", "s.py::seed") for i in range(9)]) == ""
