"""Components, layers, chains, bounded reach, apex paths and orphan cascades against plain versions."""

import random
from itertools import product

import pytest
from test_operators import graph, symbol

from loomgraph.operators import components, traverse


def imports(spark, edges, nodes=()):
    files = {x for e in edges for x in e} | set(nodes)
    return graph(spark, [symbol(f, "f") for f in sorted(files)], [("imports", a, b, 0) for a, b in edges])


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {a: {b for x, b in edges if x == a} for a in nodes}
    for k, a in product(nodes, nodes):
        if k in out[a]:
            out[a] |= out[k]
    return out


def plain_components(edges):
    r = reach(edges)
    return {a: min([a, *(b for b in r[a] if a in r.get(b, ()))]) for a in r}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(16)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(20 + 4 * seed)})
    proper = [e for e in edges if e[0] != e[1]]
    found = components.strong_components(spark.createDataFrame(edges, "source_id string, target_id string")).collect()
    want = plain_components(proper)
    assert {r["node"]: r["component"] for r in found} == want
    assert all(r["size"] == list(want.values()).count(r["component"]) for r in found)


def test_a_cycle_of_seven_and_layers_over_it(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    g = imports(spark, ring + [("top", "r3"), ("r5", "base"), ("base", "low"), ("apart", "low")])
    assert [(r["component"], r["size"], r["members"]) for r in components.import_components(g).collect()] == [("r0", 7, "r0 r1 r2 r3 r4 r5 r6")]
    layers = {r["file_path"]: r["layer"] for r in components.condensed_layers(g).collect()}
    assert layers == {"low": 0, "base": 1, "apart": 1, "top": 3} | {f"r{i}": 2 for i in range(7)}
    assert components.strong_components(g.imports.limit(0)).count() == 0 and components.peeled(g.imports.limit(0)).count() == 0


def test_layers_beyond_a_hundred(spark):
    g = imports(spark, [(f"c{i + 1:03}", f"c{i:03}") for i in range(104)])
    layers = {r["file_path"]: r["layer"] for r in traverse.layers(g).collect()}
    assert layers == {f"c{i:03}": i for i in range(105)}


def plain_chain(edges, most=12):
    best, stack = [], [[x] for x in sorted({x for e in edges for x in e})]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while stack:
        p = stack.pop()
        if len(p) > len(best) or len(p) == len(best) and p < best:
            best = p
        if len(p) < most:
            stack += [[*p, b] for b in out.get(p[-1], ()) if b not in p]
    return best


@pytest.mark.parametrize("width", [1, 256])
def test_longest_chain(spark, width):
    rng = random.Random(2)
    names = [f"m{i}" for i in range(9)]
    edges = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(13)) if a != b})
    want = plain_chain(edges)
    assert len(want) >= 5
    found = components.longest_chain(imports(spark, edges), width=width).collect()
    assert [r["length"] for r in found] == [len(want)]
    assert width == 1 or found[0]["chain"] == " > ".join(want)
    assert components.longest_chain(imports(spark, [("a", "b"), ("b", "c"), ("tests/test_a.py", "a")])).count() == 0


def calls(spark, edges, kinds=None):
    ids = sorted({x for e in edges for x in e} | set(kinds or ()))
    return graph(spark, [symbol(*x.split("::"), kind=(kinds or {}).get(x, "function")) for x in ids], [("calls", a, b, 1) for a, b in edges])


def levels(edges, root, depth):
    """Nodes that point at root, by least number of steps."""
    seen, front, out = {root}, {root}, []
    for _ in range(depth):
        front = {a for a, b in edges if b in front} - seen
        seen |= front
        out.append(len(front))
    return out


def test_reach_is_exact_below_the_cap_and_saturates_at_it(spark):
    rng = random.Random(6)
    names = [f"f{i}.py" for i in range(40)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(90)} | {(f"h{i}.py", "f1.py") for i in range(30)})
    edges = [e for e in edges if e[0] != e[1]]
    g = imports(spark, edges)
    for most in (4, 12, 1000):
        found = {}
        for r in traverse.cascade(g, most=most).collect():
            found.setdefault(r["root"], {})[r["hops"]] = r["files"]
        for root in {x for e in edges for x in e}:
            want, left = {}, most
            for i, n in enumerate(levels(edges, root, 5), 1):
                if min(n, left) > 0:
                    want[i] = min(n, left)
                left -= min(n, left)
            assert found.get(root) == (want if len(want) > 1 else None), (root, most)


def test_cascade_without_a_limit_counts_all_importers(spark):
    # 230 files import a.py in two hops, b.py has direct importers only
    edges = [("m.py", "a.py"), *((f"i{i:03}.py", "m.py") for i in range(230)), ("x.py", "b.py"), ("y.py", "b.py")]
    found = {(r["root"], r["hops"]): r["files"] for r in traverse.cascade(imports(spark, edges)).collect()}
    assert found == {("a.py", 1): 1, ("a.py", 2): 230, ("m.py", 1): 230, ("b.py", 1): 2}


def test_upstream_gates(spark):
    fan = [("a.py::c", "a.py::seed"), *((f"u{i}.py::u", "a.py::c") for i in range(25)), ("tests/test_x.py::t", "a.py::seed")]
    many = [(f"v{i}.py::v", "b.py::seed") for i in range(9)] + [(f"w{i}.py::w", "v1.py::v") for i in range(40)]
    g = calls(spark, fan + many)
    rows = {r["root"]: (r["direct"], r["reach"], r["capped"], r["shown"]) for r in traverse.upstream(g).collect()}
    assert rows["a.py::seed"] == (1, 26, False, True) and rows["b.py::seed"] == (9, 49, False, False)
    assert {r["root"]: (r["reach"], r["capped"]) for r in traverse.upstream(g, most=20).collect()}["a.py::seed"] == (20, True)


def test_apex_names_and_paths(spark):
    edges = [
        ("h.py::handle", "core.py::process"), ("app.py::main", "h.py::handle"), ("z.py::other", "h.py::handle"), ("tests/test_u.py::test_it", "u.py::helper"),
        *((f"d{i + 1}.py::d{i + 1}", f"d{i}.py::d{i}") for i in range(8)), ("a.py::ring", "b.py::ring"), ("b.py::ring", "a.py::ring"),
    ]
    g = calls(spark, edges, {"one.py::run": "function", "k.py::K": "class"})
    rows = {r["root"]: r for r in traverse.apex(g).collect()}
    assert rows["core.py::process"]["line"] == "apex: main [2 hops]" and rows["core.py::process"]["path"] == ["core.py::process", "h.py::handle", "app.py::main"]
    assert rows["h.py::handle"]["line"] == "apex: main [1 hop]" and rows["one.py::run"]["line"] == rows["app.py::main"]["line"] == "apex: self [entry]"
    assert rows["d0.py::d0"]["line"] == rows["a.py::ring"]["line"] == "apex: 5+ hops" and rows["d3.py::d3"]["line"] == "apex: d8 [5 hops]"
    assert "u.py::helper" not in rows and "k.py::K" not in rows


def test_orphans_go_wave_by_wave(spark):
    rng = random.Random(8)
    ids = [f"f{i}.py::s{i}" for i in range(30)]
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(36)})
    g = calls(spark, edges)
    gone, wave, want = {ids[0], ids[1]}, 0, {}
    callers = {t: {a for a, b in edges if b == t and a != t} for t in ids}
    while True:
        wave += 1
        new = {t for t in ids if t not in gone and callers[t] and callers[t] <= gone}
        if not new:
            break
        want |= {t: wave for t in new}
        gone |= new
    found = traverse.orphaned(g, spark.createDataFrame([(x,) for x in ids[:2]], "id string"))
    assert {r["id"]: r["wave"] for r in found.collect()} == want and want


def test_orphan_cascade_fires_from_two(spark):
    base = [("a.py::seed", "a.py::x"), ("a.py::x", "a.py::x1"), ("b.py::other", "a.py::shared"), ("a.py::seed", "a.py::shared"), ("tests/test_x.py::t", "a.py::x")]
    assert traverse.orphan_cascade(calls(spark, base)).count() == 0
    rows = traverse.orphan_cascade(calls(spark, [*base, ("a.py::x", "a.py::x2")])).collect()
    assert [(r["root"], r["helpers"], r["deeper"], r["via"]) for r in rows] == [("a.py::seed", 3, 2, "x")]
