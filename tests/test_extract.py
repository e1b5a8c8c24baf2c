"""Small repositories: what files declare, and how references resolve."""

from loomgraph.operators import lookup, resolve
from loomgraph.sources import extract, files

REPO = {
    "lib/core.py": '"""Core."""\nfrom .util import helper as h\n\nLIMIT = 3\n\nclass Base:\n    def run(self):\n        """Run it."""\n        return self.step() if LIMIT and h else None\n\n    def step(self):\n        return helper()\n\ndef _hidden():\n    pass\n',
    "lib/util.py": "def helper():\n    return 1\n",
    "lib/__init__.py": "",
    "app/main.py": "from lib.core import Base\n\nclass Child(Base):\n    def go(self):\n        self.run()\n        Base.step(self)\n\n@app.route('/')\ndef home():\n    return helper()\n\ndef test_home():\n    home()\n",
    "web/Card.tsx": "import { useCard } from './hooks';\nexport function Card() {\n  const x = useCard();\n  return <Title name={x} />;\n}\n",
    "web/hooks.ts": "export const useCard = () => {\n  return 1;\n};\nexport class Box extends Shape implements Sized {\n  size() {\n    return 1;\n  }\n}\n",
    "src/lib.rs": "pub fn top() -> i32 {\n    inner()\n}\nfn inner() -> i32 { 1 }\n",
    "main.go": "package main\nfunc Start() {\n\tstop()\n}\nfunc stop() {}\n",
    "node_modules/x.js": "function skipped() {}\n",
    "broken.py": "def (:\n",
}


def build(spark, tmp_path):
    for path, text in REPO.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return extract.extract(files.scan(spark, str(tmp_path)))


def test_symbols(spark, tmp_path):
    rows = build(spark, tmp_path)
    symbols = {r["id"]: r for r in extract.relations(rows)[0].collect()}
    kinds = {k: r["kind"] for k, r in symbols.items()}
    assert kinds["lib/core.py::Base"] == "class" and kinds["lib/core.py::Base.run"] == "method" and kinds["lib/core.py::LIMIT"] == "constant"
    assert kinds["app/main.py::home"] == "route" and kinds["app/main.py::test_home"] == "test"
    assert kinds["web/Card.tsx::Card"] == "component" and kinds["web/hooks.ts::useCard"] == "hook" and kinds["web/hooks.ts::Box.size"] == "method"
    assert symbols["main.go::Start"]["exported"] and not symbols["main.go::stop"]["exported"]
    assert symbols["src/lib.rs::top"]["exported"] and not symbols["src/lib.rs::inner"]["exported"]
    assert not symbols["lib/core.py::_hidden"]["exported"]
    assert symbols["lib/core.py::Base.run"]["complexity"] == 3 and symbols["lib/core.py::Base.run"]["doc"] == "Run it."
    assert not any("node_modules" in k for k in symbols)


def test_resolution(spark, tmp_path):
    g = resolve.build(build(spark, tmp_path))
    edges = {(r["kind"], r["source_id"], r["target_id"]) for r in g.edges.collect()}
    assert ("imports", "lib/core.py", "lib/util.py") in edges and ("imports", "app/main.py", "lib/core.py") in edges and ("imports", "web/Card.tsx", "web/hooks.ts") in edges
    assert ("calls", "app/main.py", "lib/core.py::Base") in edges  # a named import
    assert ("inherits", "app/main.py::Child", "lib/core.py::Base") in edges
    assert ("calls", "lib/core.py::Base.run", "lib/core.py::Base.step") in edges  # self of the same class
    assert ("calls", "app/main.py::Child.go", "lib/core.py::Base.run") in edges  # self of a supertype
    assert ("calls", "app/main.py::Child.go", "lib/core.py::Base.step") in edges  # Type.method
    assert ("calls", "web/Card.tsx::Card", "web/hooks.ts::useCard") in edges
    assert {r["id"] for r in lookup.callers_of(g, "lib/util.py::helper").collect()} == {"lib/core.py::Base.step", "app/main.py::home"}


def test_change_states(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1)], "path string, hash string, mtime long")
    new = spark.createDataFrame([("a", "9", 1), ("b", "1", 2), ("c", "2", 2), ("e", "1", 1)], "path string, hash string, mtime long")
    assert dict(map(tuple, files.changes(old, new).collect())) == {"a": "same", "b": "touched", "c": "changed", "d": "gone", "e": "new"}
