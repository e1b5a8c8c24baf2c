"""The inverted index against a scan of all texts."""

import re

import pytest

from loomgraph.operators import index, search

TEXTS = {
    "1": "build graph of the modules", "2": "Render output; the graph of output", "3": "builder builds a build", "4": "", "5": None, "6": "graph the build", "7": "ÄPFEL und äpfel, build graph build graph",
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    out = index.Index(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=8)
    out.update(0, table(spark, TEXTS))
    return out


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc string, text string")


def has(text, words, prefix=False):
    w = re.findall(r"\w+", (text or "").lower())
    ends = (lambda a, b: a.startswith(b)) if prefix else (lambda a, b: a == b)
    return any(w[i : i + len(words) - 1] == words[:-1] and ends(w[i + len(words) - 1], words[-1]) for i in range(len(w) - len(words) + 1))


def found(made, query):
    return {r["doc"] for r in made.match(query, None).collect()}


@pytest.mark.parametrize(
    "query,want",
    [
        ("graph", lambda t: has(t, ["graph"])), ("build*", lambda t: has(t, ["build"], True)), ('"build graph"', lambda t: has(t, ["build", "graph"])),
        ("the graph", lambda t: has(t, ["the"]) and has(t, ["graph"])), ("the AND graph", lambda t: has(t, ["the"]) and has(t, ["graph"])),
        ("builder OR output", lambda t: has(t, ["builder"]) or has(t, ["output"])), ("graph NOT build", lambda t: has(t, ["graph"]) and not has(t, ["build"])),
        ('"the gr"* OR und', lambda t: has(t, ["the", "gr"], True) or has(t, ["und"])), ("Äpfel", lambda t: has(t, ["äpfel"])), ("nothing_here", lambda t: False),
    ],
)
def test_matches_are_those_of_a_scan(made, query, want):
    assert found(made, query) == {k for k, t in TEXTS.items() if want(t)}


@pytest.mark.parametrize("query", ["", '"open', "OR a", "a OR", "NOT a", "a NOT", "a AND", "a OR NOT b", "(a)", "a +b", '""'])
def test_bad_syntax_gives_nothing(made, query):
    assert found(made, query) == set()


def test_ranks_are_those_of_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) doc", "doc_id", "text")
    import tempfile

    out = index.Index(spark, f"file://{tempfile.mkdtemp(prefix='index-')}")
    out.update(0, docs.select("doc", "text"))
    want = [(str(r["doc_id"]), r["score"]) for r in search.bm25(docs, "the and of", n=None).collect()]
    assert [tuple(r) for r in out.match("the OR and OR of", None).collect()] == want and want


def test_changed_documents_and_terms_alone_are_read(spark, made, tmp_path):
    out = index.Index(spark, f"file://{tmp_path}/index", buckets=8)
    out.update(0, table(spark, TEXTS))
    assert not out.update(0, table(spark, {"1": "other"})) and found(out, "modules") == {"1"}
    out.update(1, table(spark, {"1": "fresh words", "8": "fresh graph"}), spark.createDataFrame([("2",)], "doc string"))
    again = index.Index(spark, f"file://{tmp_path}/index", buckets=8)
    assert found(again, "modules") == set() and found(again, "fresh") == {"1", "8"} and found(again, "graph") == {"6", "7", "8"} and found(again, "output") == set()


def test_words_are_not_shuffled(spark, tmp_path, monkeypatch):
    # documents are gathered in their tasks, some at a time, and each task writes its own files
    monkeypatch.setattr(index, "WORDS", 3)
    docs = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None), ("d", "y z z x")], "doc string, text string").repartition(2)
    made = index.Index(spark, f"file://{tmp_path}/index")
    dealt = []
    monkeypatch.setattr(made.store, "_write", lambda name, rows, folder, dealt_=True, write=made.store._write: (dealt.append((name, dealt_)), write(name, rows, folder, dealt_)))
    made.update(0, docs)
    assert dealt == [("postings", False), ("lengths", True)]
    found = sorted((r["term"], r["doc"], r["tf"], tuple(r["places"])) for r in made.store.read("postings").collect())
    assert found == [("x", "a", 2, (0, 2)), ("x", "d", 1, (3,)), ("y", "a", 1, (1,)), ("y", "d", 1, (0,)), ("z", "d", 2, (1, 2))]
