"""Focus: equal to a plain walk on random graphs, limits of hubs, room for late ways, starved seeds, seeds of several questions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import graph, symbol

from loomgraph.operators import focus, traverse

WAYS = {"callers": ("calls", 1, 0), "callees": ("calls", 0, 1), "children": ("contains", 0, 1), "subtypes": ("inherits", 1, 0), "renderers": ("renders", 1, 0)}


class Plain:
    """The same rules, one node at a time."""

    def __init__(self, symbols, edges, hot):
        self.file = {r[0]: r[5] for r in symbols}
        self.kind = {r[0]: r[3] for r in symbols}
        self.line = {r[0]: r[6] for r in symbols}
        self.lines = defaultdict(int)
        for r in symbols:
            self.lines[r[5]] = max(self.lines[r[5]], r[7])
        self.hot = hot
        self.near = {w: defaultdict(set) for w in WAYS}
        for kind, *ends, _ in edges:
            for way, (k, a, b) in WAYS.items():
                if k == kind:
                    self.near[way][ends[a]].add(ends[b])
        self.outer = {x: [y for y in self.near["callers"][x] if self.file[y] != self.file[x]] for x in self.file}
        self.caller_files = {x: len({self.file[y] for y in ys}) for x, ys in self.outer.items()}
        exported = {r[0]: r[11] for r in symbols}
        self.importance = {x: 2 * len(self.outer[x]) + exported[x] + 2 * (self.file[x] in hot) for x in self.file}

    def depth(self, seeds):
        own = {self.file[s] for s in seeds}
        up = {self.file[c] for s in seeds for c in self.near["callers"][s]} - own
        down = sum(len(self.near["callees"][s]) for s in seeds)
        warm = bool(own & self.hot)
        return 2 if len(up) >= 15 else 4 + warm if down >= 6 and len(up) <= 3 else 3 + warm

    def walk(self, seeds, deepest, aside):
        shown, seen, level, d = [], set(), set(seeds), 0
        while level and len(shown) < 50:
            seen |= level
            order = sorted(level, key=lambda x: (self.file[x] in aside, self.file[x] not in self.hot, self.caller_files[x] >= 10, -self.importance[x], x))
            coming = []
            for x in order:
                if len(shown) == 50:
                    break
                shown.append((x, d))
                if d == deepest:
                    continue
                for way, limits in focus.FANOUT.items():
                    n = limits[min(d, 2)]
                    ys = self.near[way][x]
                    if way == "callers":
                        if d and self.caller_files[x] >= 15:
                            continue
                        if not d and len(self.outer[x]) >= 15:
                            n = 3 if len(self.outer[x]) < 25 else 1
                        ys = sorted(ys, key=lambda y: (-self.importance[y], y))[:n]
                    elif way == "callees":
                        ys = sorted(ys, key=lambda y: (self.caller_files[y] >= 10, -self.importance[y], y))[:n]
                    elif way == "children":
                        ys = sorted(ys, key=lambda y: (self.line[y], y))[:n]
                    else:
                        if way == "subtypes" and self.kind[x] not in focus.TYPES:
                            continue
                        for y in sorted(y for y in ys if y not in seen and self.file[y] != self.file[x])[:n]:
                            if len(shown) + len(coming) < 50:
                                coming.append(y)
                        continue
                    coming += [y for y in ys if y not in seen]
            level, d = set(coming), d + 1
        return shown

    def focus(self, seeds):
        depth, extended = self.depth(seeds), False
        aside = {self.file[s] for s in seeds if self.lines[self.file[s]] >= focus.MONOLITH}
        shown = self.walk(seeds, depth, aside)
        if len(shown) < 20 and depth < 5:
            more = self.walk(seeds, depth + 1, aside)
            shown, extended = more, len(more) > len(shown)
        held = [self.file[x] for x, _ in shown]
        alone = [s for s in seeds if held.count(self.file[s]) <= 1]
        if len(seeds) > 1 and len(shown) < 47:
            for s in alone[:3]:
                for x, d in self.walk([s], depth + 1 + extended, {self.file[s]}):
                    if len(shown) < 50 and x not in {y for y, _ in shown}:
                        shown.append((x, d))
        return shown


def random_graph(seed, n, files, calls):
    pick = random.Random(seed)
    kinds = ["function", "function", "method", "class", "component"]
    rows = []
    for i in range(n):
        line = pick.choice([3, 40, 1200])
        rows.append(symbol(f"m{pick.randrange(files)}.py", f"f{i:03}", pick.choice(kinds), pick.random() < 0.5, lines=(line, line + 5)))
    ids = [r[0] for r in rows]
    hub = ids[:3]
    ends = lambda: pick.choice(hub if pick.random() < 0.2 else ids)
    edges = [(k, pick.choice(ids), ends(), 1) for k, m in (("calls", calls), ("contains", n), ("inherits", n), ("renders", n)) for _ in range(m)]
    return rows, [e for e in edges if e[1] != e[2]], {f"m{i}.py" for i in range(0, files, 4)}


@pytest.mark.parametrize("seed,n,files,calls", [(1, 300, 60, 600), (2, 300, 250, 120), (3, 60, 30, 40), (4, 400, 40, 2000)])
def test_equal_to_a_plain_walk(spark, seed, n, files, calls):
    symbols, edges, hot = random_graph(seed, n, files, calls)
    pick = random.Random(seed)
    sets = {f"q{i}": pick.sample([r[0] for r in symbols], 1 + i % 4) for i in range(12)} | {"hubs": [r[0] for r in symbols[:3]]}
    starts = spark.createDataFrame([(q, s, i) for q, ss in sets.items() for i, s in enumerate(ss)] + [("q0", "nowhere", 9), (None, symbols[0][0], 0)], "label string, id string, place int")
    g = graph(spark, symbols, edges)
    found = defaultdict(list)
    for r in focus.focus_each(g, starts, None, spark.createDataFrame([(h,) for h in hot], "path string")).collect():
        found[r["label"]].append((r["place"], r["id"], r["depth"]))
    plain = Plain(symbols, edges, hot)
    for q, ss in sets.items():
        assert [x for _, *x in sorted(found[q])] == [list(x) for x in plain.focus(ss)], q
        assert [p for p, *_ in sorted(found[q])] == list(range(1, len(found[q]) + 1)) and len(found[q]) <= 50
    assert set(found) == set(sets)


@pytest.mark.parametrize("callers,shown", [(14, 12), (15, 3), (24, 3), (25, 1)])
def test_callers_of_hubs_are_limited(spark, callers, shown):
    rows = [symbol("a.py", "f")] + [symbol(f"x{i}.py", f"c{i}") for i in range(callers)]
    g = graph(spark, rows, [("calls", r[0], "a.py::f", 1) for r in rows[1:]])
    start = spark.createDataFrame([("a.py::f",)], "id string")
    assert focus.focus(g, start, 1).where("depth = 1").count() == shown


def test_a_starved_seed_goes_further_by_itself(spark):
    # a long chain alone in its files, beside a seed that fills more than 20 places
    chain = [symbol(f"s{i}.py", f"s{i}") for i in range(9)]
    rich = [symbol("r.py", "r")] + [symbol("r.py", f"k{i}") for i in range(6)] + [symbol("r.py", f"j{i}{k}") for i in range(6) for k in range(3)]
    edges = [("calls", f"s{i}.py::s{i}", f"s{i + 1}.py::s{i + 1}", 1) for i in range(8)]
    edges += [("calls", "r.py::r", f"r.py::k{i}", 1) for i in range(6)] + [("calls", f"r.py::k{i}", f"r.py::j{i}{k}", 1) for i in range(6) for k in range(3)]
    g = graph(spark, chain + rich, edges)
    alone = focus.focus_each(g, spark.createDataFrame([("x", "s0.py::s0", 0), ("x", "r.py::r", 1)], "label string, id string, place int"))
    # depth 4 for both (7 callees, no callers), and 5 for the seed that is alone in its file
    assert sorted(r["id"] for r in alone.where("id like 's%'").collect()) == [f"s{i}.py::s{i}" for i in range(6)]
    assert alone.where("id like 's%'").agg(F.max("depth")).first()[0] == 5


def test_seeds_of_several_questions_and_odd_input(spark):
    g = graph(spark, [symbol("a.py", "parse_tree"), symbol("b.py", "draw_line"), symbol("test_a.py", "parse_tree_test")], [])
    found = [r["id"] for r in focus.multi_seeds(g, "draw_line | parse_tree | draw_line").orderBy("place").collect()]
    assert found == ["b.py::draw_line", "a.py::parse_tree"]
    assert focus.multi_seeds(g, " | ").count() == 0
    assert focus.focus(g, focus.multi_seeds(g, "|"), None).count() == 0
    assert focus.focus(graph(spark, [], []), focus.multi_seeds(g, "draw_line"), None).count() == 0


@pytest.mark.parametrize("callers,found", [(12, []), (13, ["x00.py::main", "x05.py::open"])])
def test_callers_beyond_a_focus(spark, callers, found):
    names = {0: "main", 5: "open", 7: "shown"}
    rows = [symbol("a.py", "f")] + [symbol(f"x{i:02}.py", names.get(i, f"c{i}"), exported=i in (5, 7, 9)) for i in range(callers)] + [symbol("tests/test_x.py", "main")]
    g = graph(spark, rows, [("calls", r[0], "a.py::f", 1) for r in rows[1:]])
    shown = spark.createDataFrame([("a.py::f",), ("x07.py::shown",)], "id string")
    assert [r["id"] for r in traverse.beyond_focus(g, shown, "a.py::f").orderBy("id").collect()] == found
