"""Summaries and sections of changes: thresholds, hubs, tests named after a file, odd input."""

import random
from collections import defaultdict

import pytest
from test_operators import graph, symbol

from loomgraph.operators import review, structure


def changes(spark, *rows):
    return spark.createDataFrame(rows, "change string, path string")


@pytest.mark.parametrize("importers,callers,risk", [(16, 0, "HIGH"), (15, 0, "MEDIUM"), (6, 0, "MEDIUM"), (5, 0, None), (3, 1, "MEDIUM"), (2, 1, None), (13, 1, "HIGH")])
def test_risk(spark, importers, callers, risk):
    rows = [symbol("a.py", "f")] + [symbol(f"x{i}.py", "g") for i in range(20)]
    edges = [("imports", f"x{i}.py", "a.py", 1) for i in range(importers)] + [("calls", f"x{i}.py::g", "a.py::f", 1) for i in range(callers)] + [("imports", "a.py", "a.py", 1), ("imports", "nowhere.py", "a.py", 1)]
    row = review.summaries(graph(spark, rows, edges), changes(spark, ("c", "a.py"), ("c", "a.py"), ("c", "gone.py"), ("d", "gone.py"), (None, "a.py"))).collect()
    assert [(r["change"], r["risk"], r["blast"], r["called"], r["symbols"]) for r in row] == [("c", risk, importers, min(callers, 1), 1)]


def test_names_scope_and_top(spark):
    rows = [symbol(f"d{i}/m.py", f"f{i}", exported=i != 1) for i in range(7)] + [symbol("u.py", "u"), symbol("v.py", "v"), symbol("d0/test_m.py", "t"), symbol("d0/m.py", "x", "variable")]
    edges = [("imports", s, t, 1) for s in ("u.py", "v.py") for t in ("d0/m.py", "d1/m.py")] + [("imports", "u.py", "d2/m.py", 1)]
    g = graph(spark, rows, edges)
    r = review.summaries(g, changes(spark, *[("c", f"d{i}/m.py") for i in range(7)], ("c", "d0/test_m.py"))).first()
    assert r["names"] == "f0, f2, f3, f4, f5, f6" and r["symbols"] == 8 and r["exported"] == 7
    assert r["scope"] == "d0, d1, d2, d3, d4 +2 more" and r["top"] == "m.py (blast:2), m.py (blast:2)" and r["blast"] == 2
    r = review.summaries(g, changes(spark, ("c", "d0/m.py"), ("c", "d1/m.py"))).first()
    assert r["names"] is None and r["scope"] is None and r["folders"] == 2
    r = review.summaries(g, changes(spark, ("t", "d0/test_m.py"))).first()
    assert (r["symbols"], r["risk"], r["names"]) == (0, None, None)


def test_tests_named_after_a_changed_file(spark):
    files = ("parse.py", "draw.py", "tests/test_parse.py", "tests/test_parse_more.py", "tests/test_draw.py")
    g = graph(spark, [symbol(f, "f") for f in files], [])
    found = review.sections(g, changes(spark, ("c", "parse.py"), ("c", "draw.py"), ("c", "tests/test_draw.py"), ("d", "parse.py"), ("d", "tests/test_parse.py"))).where("section = 'unchanged'").collect()
    assert [(r["change"], r["item"], r["r"], r["total"]) for r in found] == [("c", "tests/test_parse.py", 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_by_brute_force(spark, seed):
    # few files, so that changes hold many of a hub's importers and callers
    pick = random.Random(seed)
    files = [f"m{i:02}.py" for i in range(30)]
    rows = [symbol(pick.choice(files), f"f{i:03}", exported=pick.random() < 0.7) for i in range(120)]
    held = sorted({r[5] for r in rows})
    ids = [r[0] for r in rows]
    imports = {(pick.choice(held), pick.choice(held[:6] if pick.random() < 0.7 else held)) for _ in range(250)}
    calls = {(pick.choice(ids), pick.choice(ids[:8] if pick.random() < 0.5 else ids)) for _ in range(400)}
    g = graph(spark, rows, [("imports", *e, 1) for e in imports] + [("calls", *e, 1) for e in calls])
    sets = {f"c{i}": set(pick.sample(held, 1 + i % 15)) for i in range(30)}
    each = changes(spark, *[(c, f) for c, fs in sets.items() for f in fs])
    exported = {r[0]: r[11] for r in rows}
    path = lambda i: i.split("::")[0]
    got = {r["change"]: (r["blast"], r["called"]) for r in review.summaries(g, each).collect()}
    listed = defaultdict(dict)
    for r in review.sections(g, each).collect():
        listed[r["change"], r["section"]][r["r"]] = (r["item"], r["n"], r["total"])
    for c, fs in sets.items():
        blast = {a for a, b in imports if b in fs and a != b}
        outside = defaultdict(int)
        for a, b in calls:
            if exported[b] and path(b) in fs and path(a) not in fs:
                outside[b] += 1
        assert got[c] == (len(blast), len(outside))
        assert [x for _, x in sorted(listed[c, "importer"].items())] == [(x, None, len(blast - fs)) for x in sorted(blast - fs)[:10]]
        assert [x for _, x in sorted(listed[c, "external"].items())] == [(x, outside[x], len(outside)) for x in sorted(outside, key=lambda i: (path(i), i))[:10]]


def test_no_changes(spark):
    g = graph(spark, [symbol("a.py", "f")], [])
    assert review.summaries(g, changes(spark, ("c", None))).count() == 0 and review.sections(g, changes(spark, (None, "a.py"))).count() == 0


def test_live_coupling_follows_dependencies(spark):
    rows = [symbol(f"{m}/{i}.py", f"{m}{i}") for m in "abcd" for i in range(2)]
    # a uses b; b and c use each other; d has no dependency
    edges = [("imports", "a/0.py", "b/0.py", 1), ("calls", "b/0.py::b0", "c/0.py::c0", 1), ("calls", "c/1.py::c1", "b/1.py::b1", 1)]
    pairs = [(x, y, i) for x, y in ("ab", "bc", "ad") for i in range(2)]
    commits = [(9 * k + n, "2001-01-01", f"{m}/{i}.py") for k, (x, y, i) in enumerate(pairs) for n in range(3) for m in (x, y)]
    found = structure.live_coupling(graph(spark, rows, edges, [*commits, (99, "2001-01-01", "notes/x.md"), (99, "2001-01-01", "a/0.py")]), 0.3).collect()
    assert sorted((r["a"], r["b"], r["pairs"], r["leads"]) for r in found) == [("a", "b", 2, "b"), ("b", "c", 2, None)]
    many = [("calls", f"a/{i % 2}.py::a{i % 2}", f"b/{i // 2}.py::b{i // 2}", 1) for i in range(4)] + [("imports", f"d/{i % 2}.py", f"b/{i // 2}.py", 1) for i in range(4)]
    hubs = lambda more: [tuple(r) for r in structure.module_hubs(graph(spark, rows, many + more)).collect()]
    assert hubs([("calls", "c/0.py::c0", "b/0.py::b0", 1)]) == [] and hubs([("calls", "c/0.py::c0", f"b/{i}.py::b{i}", 1) for i in range(2)]) == [("b", 3, 10)]


def test_coupling_counts_uses_of_modules_once(spark):
    g = graph(spark, [symbol("a/0.py", "f"), symbol("b/0.py", "g")], [("imports", "a/0.py", "b/0.py", 1)], [(1, "2001-01-01", "a/0.py"), (1, "2001-01-01", "b/0.py")])
    # imports and calls are read when their counts are written, and not again for each of its uses
    assert "imports" not in structure.live_coupling(g)._jdf.queryExecution().optimizedPlan().toString()


def test_large_changes_give_what_small_ones_do(spark, monkeypatch):
    # whole changes of 1 to 6 files, by pairs of files and without
    pick = random.Random(7)
    files = [f"m{i}.py" for i in range(7)] + ["test_m1.py"]
    rows = [symbol(pick.choice(files), f"f{i}", pick.choice(["function", "component"])) for i in range(30)]
    ids, held = [r[0] for r in rows], sorted({r[5] for r in rows})
    edges = [(k, pick.choice(ids), pick.choice(ids), 1) for k in ("calls", "renders") for _ in range(40)] + [("imports", pick.choice(held), pick.choice(held), 1) for _ in range(15)]
    each = changes(spark, *[(f"c{i}", f) for i in range(8) for f in pick.sample(held, 1 + i % 6)])
    g = graph(spark, rows, edges)
    found = []
    for wide in (64, 2):
        monkeypatch.setattr(review, "WIDE", wide)
        monkeypatch.setattr(review, "PART", wide)
        found.append((sorted(map(tuple, review.summaries(g, each).collect()), key=repr), sorted(map(tuple, review.sections(g, each).collect()), key=repr)))
    assert found[0] == found[1] and {r[1] for r in found[0][1]} >= {"external", "importer", "component", "test"}


def test_items_tied_to_files_of_a_change_only(spark, monkeypatch):
    # one row for items that are tied alike, in parts of few rows and with large changes; importers of 1300 files as 3 rows of bits
    pick = random.Random(3)
    files = [(f"m{i:04}.py", i) for i in range(1300)]
    items = {(f, o): set(pick.sample(range(6), 1 + pick.randrange(4))) for f in range(6) for o in range(20)}
    ties = spark.createDataFrame([(f, g, o, 1, len(gs), len(gs)) for (f, o), gs in items.items() for g in gs], "f int, g int, ord int, n long, every long, by long")
    sets = {f"c{i}": set(pick.sample(range(6), 1 + i % 6)) for i in range(20)}
    named = spark.createDataFrame(files, "file_path string, f int")
    each = changes(spark, *[(c, files[f][0]) for c, fs in sets.items() for f in fs])
    expected = {(c, f): n for c, fs in sets.items() for f in fs if (n := sum(gs <= fs for (x, _), gs in items.items() if x == f))}
    for narrow, wide in ((500_000, 64), (5, 64), (5, 3)):
        monkeypatch.setattr(review, "NARROW", narrow)
        monkeypatch.setattr(review, "WIDE", wide)
        at = review.step_folder(spark)
        found = review._Changes(each, named, at).whole(ties, at).collect()
        assert {(r["change"], r["f"]): r["whole"] for r in found} == expected
    rows = review._bits(spark.range(1300).selectExpr("1 as f", "cast(id as int) as i").where("i <> 70"), f"{review.step_folder(spark)}/bits").collect()
    assert sorted(r["block"] for r in rows) == [0, 1, 2]
    assert {64 * (review.WORDS * r["block"] + j) + b for r in rows for j in range(review.WORDS) for b in range(64) if (r[f"w{j}"] or 0) >> b & 1} == set(range(1300)) - {70}


def test_most_counted_and_first_outside(spark, monkeypatch):
    # sums in a matrix and by a join; the first importers that aren't changed, over three rows of bits
    pick = random.Random(5)
    named = spark.createDataFrame([(f"m{i:04}.py", i) for i in range(1300)], "file_path string, f int")
    counts = {(f, i): pick.randrange(1, 4) for f in range(8) for i in pick.sample(range(1300), 9 if f else 2)}
    sets = {f"c{k}": {0} if not k else set(pick.sample(range(12), 1 + k % 6)) for k in range(20)} | {"far": {9, 11}}
    known = review._Changes(changes(spark, *[(c, f"m{f:04}.py") for c, fs in sets.items() for f in fs]), named, review.step_folder(spark))
    table = spark.createDataFrame([(f, i, n) for (f, i), n in counts.items()], "f int, i int, _n long")
    most, near = set(), set()
    for c, fs in sets.items():
        total = defaultdict(int)
        for (f, i), n in counts.items():
            total[i] += n if f in fs else 0
        total = {i: n for i, n in total.items() if n}
        most |= {(c, i, total[i], r + 1, len(total)) for r, i in enumerate(sorted(total, key=lambda i: (-total[i], i))[:5])}
        near |= {(c, i, r + 1, len(total.keys() - fs)) for r, i in enumerate(sorted(total.keys() - fs)[:10])}
    for dense in (2_000_000, 70, 1):
        monkeypatch.setattr(review, "DENSE", dense)
        assert {tuple(r) for r in review._most(known, table, 5).select("change", "i", "n", "r", "total").collect()} == most
    at = review.step_folder(spark)
    assert {tuple(r) for r in review._outside(known, review._bits(table, f"{at}/bits"), named, 10, f"{at}/outside").collect()} == near
