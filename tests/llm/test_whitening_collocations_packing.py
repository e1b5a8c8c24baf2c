"""Whitening against plain linear algebra, collocations against plain counts, packing against the tokenizers library and its own rules."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import collocations, packing, queries, whitening

SF = "/root/testdata/sf0.001"
VOCABULARY = queries.tokenizer_file("word_bpe_49k.json")
ODD = "doc_id long, text string, lang string, _key string, _of string, piece string, gram string, tier string, ids string, task string, n string, key string"
ODD_ROWS = [
    (1, None, None), (2, "", "en"), (None, " \t\n", "en"), (4, "Same words here. same WORDS here!", "en"), (4, "Same words here. same WORDS here!", "en"),
    (5, "long text " * 40_000, "en"), (6, "ÄÖ ß 日本語 <|endoftext|> it's ΑΣ", None), (7, "a,b;c", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *(f"x{i}" if i % 2 else None for _ in range(9))) for i, r in enumerate(ODD_ROWS)], ODD)


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x], values[::-1], axes[:, ::-1], y


def test_whitening_by_plain_linear_algebra(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    given_ = table.orderBy("vec_id").collect()
    n, deviations, values, axes, y = plain_whitening([r["embedding"] for r in given_])
    rows = defaultdict(dict)
    for r in queries.op11_whitening(spark, SF).collect():
        rows[r["vec_id"]][r["component"]] = r
    assert set(rows) == {r["vec_id"] for r in given_} and all(set(c) == set(range(1, 9)) for c in rows.values())
    for k in range(8):
        column = [rows[r["vec_id"]][k + 1] for r in given_]
        assert [r["deviation"] for r in column] == deviations and {r["n"] for r in column} == {n}
        want = y @ axes[:, k] / np.sqrt(values[k])
        found = np.array([r["whitened"] for r in column])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
        assert abs(column[0]["explained"] / (values[k] / values.sum()) - 1) < 1e-9 and column[0]["identity_error"] < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 30):
        scale = 10.0 ** np.linspace(0, -9, d)
        basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
        b = rng.normal(size=(d, d))
        a = (b @ b.T + d * np.eye(d)) * np.outer(scale, scale)  # graded: small eigenvalues are well determined
        values, axes = whitening.jacobi(a)
        assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-12 and (np.diff(values) <= 0).all()
        for k in range(d):
            assert abs(np.linalg.norm(a @ axes[:, k] - values[k] * axes[:, k])) < 1e-13 * np.abs(a).max()
        least = 1 / np.linalg.eigvalsh(np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)).max()
        assert np.abs(values[-1] / least - 1) < 1e-9
        values, _ = whitening.jacobi(basis @ np.diag(np.arange(d, 0, -1.0)) @ basis.T)
        assert np.allclose(values, np.arange(d, 0, -1.0), rtol=1e-13)
    assert list(whitening.jacobi(np.zeros((3, 3)))[0]) == [0, 0, 0]


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -0.25]), (None, [0.25, 1.0, 0.5]), (1, [0.5, 1.0, -0.25]), (4, [-0.5, 1.0, 0.125])]
    bad = [(5, None), (6, []), (7, [None, 1.0, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<float>, whitened string, n int")
    rows = whitening.components_of(table).collect()
    n, deviations, values, *_ = plain_whitening([v for _, v in good])
    assert Counter(r["vec_id"] for r in rows) == Counter({1: 6, None: 3, 4: 3}) and {r["n"] for r in rows} == {n}
    assert sorted({int(r["deviation"]) for r in rows}) == sorted(set(deviations))
    # one dimension doesn't vary: its component has no value and no share
    assert all((r["whitened"] is None) == (r["component"] == 3) and r["identity_error"] < 1e-9 for r in rows)
    assert [round(r["explained"], 9) for r in rows[:3]] == [round(float(v / values.sum()), 9) + 0.0 for v in values]
    assert whitening.components_of(table.limit(0)).count() == 0
    alone = whitening.components_of(table.limit(1)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in alone] == [(None, 0.0, None, 0)] * 3


def test_deviations_past_64_bits(spark):
    table = spark.createDataFrame([(i, [1e12 * i, -3e11, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    _, deviations, *_ = plain_whitening([[1e12 * i, -3e11, float(i)] for i in range(5)])
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.components_of(table, components=1).collect()}
    assert found == dict(enumerate(deviations)) and max(deviations) > 1 << 63


def plain_collocations(rows, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if a >= 30 and len(g[1]) > 1}
    out = []
    for (lang, g), a in often.items():
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        if not any(h != g and x == lang and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (x, h), b in often.items() if len(h) > len(g)):
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked, seen = [], Counter()
    for row in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        seen[row[0]] += 1
        if seen[row[0]] <= first:
            ranked.append((row[0], seen[row[0]], *row[1:]))
    return ranked


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_by_plain_counts(spark, odd, monkeypatch):
    rows = [("the  big\tred dog runs. The big red dog, a b a b a b a b", "en")] * 40 + [("big red dog; the big RED cat", "en")] * 9 + [("ein wort ein Wort ein wort", None)] * 31 + [("x", "de")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    for block, long in ((4 << 20, 1 << 20), (200, 64)):  # the second splits blocks and long pieces
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "LONG", long)
        for docs, given_ in ((table, rows), (odd, [r[1:] for r in ODD_ROWS])):
            want = plain_collocations(given_)
            assert sorted(map(tuple, collocations.collocations(docs).select(*COLUMNS).collect())) == sorted(want) and want
    assert sorted(map(tuple, collocations.collocations(table, first=3).select(*COLUMNS).collect())) == sorted(plain_collocations(rows, 3))
    assert collocations.collocations(table.limit(0)).count() == 0


def test_runs_of_long_pieces_repeat_what_n_grams_need(monkeypatch):
    import pyarrow as pa

    words = [f"w{i % 7}" for i in range(100)]
    batch = pa.record_batch({"lang": ["en"], "piece": [" ".join(words)], "times": [3]})
    for long in (8, 40, 1000):
        monkeypatch.setattr(collocations, "LONG", long)
        found = Counter()
        for block in collocations._blocks([batch]):
            for table, h in collocations.grams(block, (1, 2, 3, 4), np.full(collocations.MAP_BITS // 8, 255, np.uint8)):
                found.update({r["gram"]: r["weight"] for r in table.to_pylist()})
                assert collocations.hashes(table.column("lang").to_pylist(), table.column("gram").to_pylist()) == h.view(np.int64).tolist()
        assert found == Counter({" ".join(g): 3 * n for k in range(1, 5) for g, n in Counter(tuple(words[i : i + k]) for i in range(101 - k)).items()})


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def checked(rows, docs):
    """Windows and documents that the rows make, held against the rules."""
    windows, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
        parts[r["doc_id"]].append(r)
    padding = tokens = 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert at == own[0]["tier"] or own[0]["tier"] == 4096
    assert set(parts) == set(docs)
    for key, copies in docs.items():
        ids = copies[0]
        want = Counter(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids) for r in parts[key])
        assert not want[False]
        covered = Counter(i for r in parts[key] for i in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({i: len(copies) for i in range(len(ids))})
    return windows, padding, tokens


def test_packing_keeps_each_token_once(spark, odd, monkeypatch):
    for table, most in ((spark.read.parquet(f"{SF}/documents.parquet"), 4096), (odd, 4096)):
        given_ = table.select("doc_id", "text").collect()
        docs = defaultdict(list)
        for r, ids in zip(given_, library_ids([r["text"] for r in given_])):
            docs[r["doc_id"]].append([*ids, 2])
        rows = packing.packed(table, VOCABULARY).collect()
        windows, padding, tokens = checked(rows, docs)
        assert padding < most and sum(sum(map(len, d)) for d in docs.values()) == tokens
    assert packing.packed(table.limit(0), VOCABULARY).count() == 0


def test_packing_over_many_tasks_and_steps(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet").repartition(23, "doc_id")
    given_ = table.select("doc_id", "text").collect()
    docs = {r["doc_id"]: [[*ids, 2]] for r, ids in zip(given_, library_ids([r["text"] for r in given_]))}
    monkeypatch.setattr(packing, "POOL", 9_000)  # several pools a task, and more than one round of rests
    monkeypatch.setattr(packing, "STEP", 5 * 4096)
    rows = packing.packed(table, VOCABULARY).collect()
    windows, padding, tokens = checked(rows, docs)
    assert padding < 4096
    steps = defaultdict(int)
    for own in windows.values():
        assert len({r["step"] for r in own}) == 1
        steps[own[0]["step"]] += own[0]["tier"]
    assert set(steps) == set(range(-(-sum(steps.values()) // (5 * 4096)))) and max(steps.values()) - min(steps.values()) <= 4096


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9_000), max_size=60))
def test_packed_windows_are_full(lengths):
    windows, left = packing.pack(lengths)
    for tier, parts in windows:
        assert sum(n for *_, n in parts) == tier in packing.TIERS
    assert sum(n for *_, n in left) < 4096
    covered = Counter((i, at) for i, start, n in [p for _, w in windows for p in w] + left for at in range(start, start + n))
    assert covered == Counter((i, at) for i, n in enumerate(lengths) for at in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abA 's\n\t\x0b\x1c.,1İßſŉ́ \xa0\x85Σσ<|>日"), st.characters(blacklist_categories=("Cs",))), max_size=40))
def test_ids_equal_the_library(text):
    from array import array

    assert list(array("i", packing.load(VOCABULARY)(text))) == library_ids([text])[0]
    special = f"{text}<|endoftext|>x{text}"
    assert list(array("i", packing.load(VOCABULARY)(special))) == library_ids([special])[0]
