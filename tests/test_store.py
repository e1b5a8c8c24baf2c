"""Relations that last: restart, replay, the rules of edges, exact files, compaction, buckets."""

import pytest

from loomgraph.streaming import ingest
from loomgraph.streaming.store import Store, with_files

FILES, SYMBOLS = "path string, hash string", "id string, file_path string"
EDGES = "kind string, source_id string, target_id string, line int, source_file string, target_file string"
RELATIONS = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES}


def opened(spark, tmp_path, **more):
    return Store(spark, f"file://{tmp_path}/store", RELATIONS, **more)


def put(store, number, files, deleted=()):
    """files: path -> (hash, symbols, edges)."""
    spark = store.spark
    made = {
        "files": spark.createDataFrame([(p, h) for p, (h, _, _) in files.items()], FILES),
        "symbols": spark.createDataFrame([(f"{p}::{s}", p) for p, (_, names, _) in files.items() for s in names], SYMBOLS),
        "edges": with_files(spark.createDataFrame([e for _, _, edges in files.values() for e in edges], "kind string, source_id string, target_id string, line int")),
    }
    return store.apply(number, spark.createDataFrame([(p,) for p in [*files, *deleted]], "path string"), **made)


def ids(store):
    return {r["id"] for r in store.read("symbols").collect()}, {(r["source_id"], r["target_id"]) for r in store.read("edges").collect()}


FIRST = {
    "a.py": ("1", ["f", "g"], [("calls", "a.py::f", "b.py::h", 1), ("imports", "a.py", "b.py", 0)]),
    "b.py": ("1", ["h"], [("calls", "b.py", "c.py::k", 1)]),
    "a.pyx": ("1", ["z"], [("calls", "a.pyx::z", "a_py::q", 1)]),
    "c.py": ("1", ["k"], [("calls", "deco", "c.py::k", 2)]),
}


def test_a_restarted_driver_goes_on(spark, tmp_path):
    assert put(opened(spark, tmp_path), 0, FIRST)
    again = opened(spark, tmp_path)
    assert put(again, 1, {"d.py": ("1", ["m"], [])})
    assert {r["path"] for r in opened(spark, tmp_path).read("files").collect()} == {"a.py", "b.py", "a.pyx", "c.py", "d.py"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = opened(spark, tmp_path)
    put(store, 0, FIRST)
    before, versions = ids(store), store.versions()
    assert not put(opened(spark, tmp_path), 0, {"a.py": ("9", [], [])}) and ids(store) == before and store.versions() == versions


def test_edges_end_with_their_source_and_what_their_target_lies_below(spark, tmp_path):
    store = opened(spark, tmp_path)
    put(store, 0, FIRST)
    # b changes: edges from it and to its symbols end; the import of the file itself stays
    put(store, 1, {"b.py": ("2", ["h2"], [("calls", "b.py::h2", "c.py::k", 1)])})
    assert ids(store) == (
        {"a.py::f", "a.py::g", "b.py::h2", "a.pyx::z", "c.py::k"},
        {("a.py", "b.py"), ("b.py::h2", "c.py::k"), ("a.pyx::z", "a_py::q"), ("deco", "c.py::k")},
    )
    # a.py goes: a.pyx and a_py are other files
    put(store, 2, {}, deleted=["a.py"])
    assert ids(store) == ({"b.py::h2", "a.pyx::z", "c.py::k"}, {("b.py::h2", "c.py::k"), ("a.pyx::z", "a_py::q"), ("deco", "c.py::k")})
    put(store, 3, {}, deleted=["c.py"])
    assert ids(store) == ({"b.py::h2", "a.pyx::z"}, {("a.pyx::z", "a_py::q")})


def test_compaction_keeps_what_counts(spark, tmp_path):
    import os

    store = opened(spark, tmp_path, deltas=2)
    put(store, 0, FIRST)
    for n in range(1, 6):
        put(store, n, {"b.py": (str(n), [f"h{n}"], [])}, deleted=["c.py"] if n == 3 else [])
    assert ids(store) == ({"a.py::f", "a.py::g", "b.py::h5", "a.pyx::z"}, {("a.py", "b.py"), ("a.pyx::z", "a_py::q")})
    store.compact()
    assert ids(opened(spark, tmp_path)) == ids(store) and store.manifest()["deltas"] == [] and store.manifest()["last"] == 5
    store.compact()
    assert len([x for x in os.listdir(tmp_path / "store") if x.startswith(("base-", "delta-"))]) == 2
    assert put(store, 6, {"e.py": ("1", ["n"], [])}) and "e.py::n" in ids(store)[0]


def test_files_are_read_from_their_buckets(spark, tmp_path):
    store = opened(spark, tmp_path, buckets=8)
    put(store, 0, {f"f{i}.py": ("1", ["x"], []) for i in range(40)})
    some = store.read("symbols", ["f1.py", "f2.py"])
    assert {r["id"] for r in some.collect()} == {"f1.py::x", "f2.py::x"}
    assert "PartitionFilters: [_bucket" in some._jdf.queryExecution().executedPlan().toString()


def test_two_writers_of_a_version_are_an_error(spark, tmp_path):
    store = opened(spark, tmp_path)
    put(store, 0, FIRST)
    old = store.manifest()
    put(store, 1, {"d.py": ("1", [], [])})
    with pytest.raises(RuntimeError):
        store._publish(old | {"version": old["version"] + 1})
    assert store.manifest()["last"] == 1


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, seen = "path string, hash string, deleted boolean, version long", []
    at = f"file://{tmp_path}"

    def drain():
        store = ingest.Store(spark, f"{at}/store", "path string, hash string")
        changed = spark.readStream.schema(schema).parquet(f"{at}/in")
        ingest.follow(changed, store, f"{at}/checkpoint", lambda rows: seen.append(sorted(r["path"] for r in rows.collect())), None).awaitTermination()
        return sorted(map(tuple, store.read().collect()))

    spark.createDataFrame([("a", "1", False, 1), ("b", "1", False, 1)], schema).write.mode("append").parquet(f"{at}/in")
    assert drain() == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("c", "1", False, 2), ("a", None, True, 2), ("nowhere", None, True, 2)], schema).write.mode("append").parquet(f"{at}/in")
    assert drain() == [("b", "1"), ("c", "1")] and seen == [["a", "b"], ["a", "c"]]
    # the batch function itself, called again with a number that is in
    run = ingest.apply_changes(ingest.Store(spark, f"{at}/store", "path string, hash string"))
    run(spark.createDataFrame([("b", None, True, 9)], schema), 1)
    assert drain() == [("b", "1"), ("c", "1")]
