"""Language identification of mixed-language text by script ranges and Viterbi.

A bounded sample of labelled rows gives each language the shares of scripts
among its letters and the probabilities of character trigrams within words.
Trigrams are hashed to the cells of a table of a fixed size, CELLS numbers for all
languages together, so that none is dropped, and neither the driver nor what is
broadcast grows with the texts; trigrams that share a cell share its probability.
The script of a word narrows its candidates to languages that use it; each
candidate scores the word by its trigrams.  Viterbi over the words, with PENALTY
for each switch, labels spans.  The language with most letters wins.

The path is exact: a constant path is taken only where a bound on the gain of
any other path proves it best, and the recurrence is run on all other texts.

Defined results: null and letterless texts are 'und' with score 0.  Text in
scripts that no language uses is scored against all languages.  Without any
labelled row all texts are 'und'.  Letters are Unicode's (L).  Ties go to the first language by name.
Repeated rows are labelled alike; only the text decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_importable, held_out, rows_operator, shared_dir

#: Labelled rows of each language, and of all languages together, that training takes, about.
ROWS_PER_LANGUAGE, MAX_ROWS = 2_000, 200_000
#: Numbers of the trigram table, and cells of a language at most (powers of two).
CELLS, CELLS_PER_LANGUAGE = 1 << 24, 1 << 20
#: Nats that a switch of language costs, the most that a word can say against a candidate, and what bars a language that isn't one.
PENALTY, CLIP, BARRED = 12.0, 8.0, 1e6
#: Bytes of words' scores that a worker remembers, about, and languages whose numbers of rows are broadcast at most.
CACHE_BYTES, BROADCAST = 64 << 20, 10_000
#: Least share of a language's letters that a script needs to count as used.
USED = 0.01
_OTHER = regex.compile(r"[^\p{L}\n]")

# First code points of Unicode ranges, and their scripts.
RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = np.array([a for a, _ in RANGES])


def script(letter: str) -> str:
    """The script range of a letter."""
    i = int(np.searchsorted(_STARTS, ord(letter), side="right")) - 1
    return RANGES[i][1] if i >= 0 else "Other"


def letters_of(text: str) -> np.ndarray:
    """The code points of a text in lower case, a space for whatever isn't a letter, but for line ends, and a line end before and behind."""
    return np.frombuffer(f"\n{_OTHER.sub(' ', text.lower())}\n".encode("utf-32-le"), np.uint32).astype(np.int64)


def cells_of(a: np.ndarray, at: np.ndarray, cells: int) -> np.ndarray:
    """The cells of the trigrams whose middles are the letters at; neighbours are letters of the word or a space."""
    b = np.where(a == 10, 32, a)
    code = (b[at - 1] << 42 | b[at] << 21 | b[at + 1]).astype(np.uint64)
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(65 - cells.bit_length())).astype(np.int64) if cells > 1 else np.zeros(len(code), np.int64)


def cells_for(languages: int) -> int:
    """Cells of each of so many languages: a power of two."""
    return min(CELLS_PER_LANGUAGE, 1 << max(1, (CELLS // max(1, languages)).bit_length() - 1))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: Log probabilities: a row for each cell, a column for each language.
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 0), np.float32))
    scripts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self._reset()

    def _reset(self):
        n = len(self.languages)
        self.rows = np.zeros((1 << 12, n))
        self.letters = np.zeros(1 << 12)
        self.used = self.held = 0
        self.index = {}
        self.partial = {k for k, used in self.scripts.items() if not used.all()}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "table", "scripts")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._reset()

    def _score(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the languages, the best being 0, and numbers of letters of white-space tokens.

        Each letter is the middle of one trigram, whose neighbours are letters of its word or a space.
        """
        n, m = len(raw), len(self.languages)
        a = letters_of(b"\n".join(raw).decode("utf-8", "replace"))
        at = np.flatnonzero((a != 32) & (a != 10))
        token = (np.cumsum(a == 10) - 1)[at]
        cell = cells_of(a, at, len(self.table))
        total = np.stack([np.bincount(token, self.table[cell, j], n) for j in range(m)], axis=1)
        barred = np.zeros((n, m), bool)
        if self.partial:
            kind = np.searchsorted(_STARTS, a[at], side="right") - 1
            for i in np.unique(kind).tolist():
                if (name := RANGES[i][1]) in self.partial:
                    barred[np.ix_(np.unique(token[kind == i]), ~self.scripts[name])] = True
            barred[barred.all(axis=1)] = False  # a word of scripts that no language has together
        total = np.where(barred, -np.inf, total)
        total = np.maximum(total - total.max(axis=1, keepdims=True), -CLIP)
        return np.where(barred, -BARRED, total), np.bincount(token, minlength=n).astype(float)

    def _rows(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > CACHE_BYTES:
            self._reset()
        index = self.index
        new = [w for w in dict.fromkeys(raw) if w not in index]
        if new:
            end = self.used + len(new)
            while end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.rows[self.used : end], self.letters[self.used : end] = self._score(new)
            index.update(zip(new, range(self.used, end)))
            self.used = end
            self.held += sum(map(len, new)) + len(new) * (150 + 8 * len(self.languages))
        at = np.fromiter(map(index.__getitem__, raw), np.int64, len(raw))
        return self.rows[at], self.letters[at]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word under the switching penalty."""
        best = int(np.argmax(scores.sum(axis=0)))
        others = np.delete(scores, best, axis=1)
        if not others.shape[1]:
            return np.zeros(len(scores), np.int64)
        gain = np.concatenate(([0.0], np.cumsum(others.max(axis=1) - scores[:, best])))
        inner = (gain - np.minimum.accumulate(gain)).max()
        if inner <= 2 * PENALTY and gain.max() <= PENALTY and (gain[-1] - gain).max() <= PENALTY:
            return np.full(len(scores), best)  # no run of other languages gains what its switches cost
        v = scores[0].tolist()
        back: list[list[int] | None] = []
        for s in scores[1:].tolist():
            top = max(v)
            switch = top - PENALTY
            if min(v) >= switch:
                back.append(None)  # no language is better reached from another
                v = [a + b for a, b in zip(v, s)]
            else:
                i = v.index(top)
                back.append([j if a >= switch else i for j, a in enumerate(v)])
                v = [(a if a >= switch else switch) + b for a, b in zip(v, s)]
        at = v.index(max(v))
        out = [at]
        for step in reversed(back):
            if step is not None:
                at = step[at]
            out.append(at)
        return np.array(out[::-1])

    def label(self, text: str | None) -> tuple[str, float, int]:
        """Language of a text, its share of the letters, number of spans."""
        raw = (text or "").encode().split()
        if not raw or not self.languages:
            return "und", 0.0, 0
        scores, letters = self._rows(raw)
        some = letters > 0
        if not some.any():
            return "und", 0.0, 0
        scores, letters = scores[some], letters[some]
        path = self.path(scores)
        share = np.bincount(path, letters, len(self.languages))
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum()), int((path[1:] != path[:-1]).sum()) + 1

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Character spans of maximal runs of one language; tokens without letters join the run before them."""
        found = [(m.start(), m.end(), m.group().encode()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        if not found or not self.languages:
            return []
        scores, letters = self._rows([w for *_, w in found])
        if not (letters > 0).any():
            return []
        path = iter(self.path(scores[letters > 0]))
        out: list[tuple[int, int, str]] = []
        for (a, z, _), n in zip(found, letters):
            name = self.languages[next(path)] if n else out[-1][2] if out else None
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], z, name)
            elif name:
                out.append((a, z, name))
        return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE, most: int = MAX_ROWS) -> Model:
    """Count trigrams and scripts in about rows documents of each language (all of rare ones), outside the held-out fifth; most bounds all languages together.

    Rows are drawn one by one, by a hash of id, text and their number, so null ids and repeated rows are drawn like others.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.col(key).alias("_id"))
    at = shared_dir(docs.sparkSession)
    sizes = cut(known.groupBy("_lang").agg(F.count("*").alias("_n")), f"{at}/sizes")
    languages = [r[0] for r in sizes.select("_lang").orderBy("_lang").limit(most).collect()]
    if not languages:
        return Model()
    cells = cells_for(len(languages))
    unit = F.pmod(F.xxhash64("_id", F.xxhash64("_text"), F.monotonically_increasing_id(), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("_unit", unit)
    sample = drawn.join(F.broadcast(sizes) if len(languages) <= BROADCAST else sizes, "_lang").where(F.col("_unit") * F.col("_n") < F.lit(min(rows, most / len(languages))))

    def count(langs, texts):
        by: dict[str, list[str]] = defaultdict(list)
        for name, t in zip(langs, texts):
            by[name].append(t)
        for name, own in by.items():
            a = letters_of("\n".join(own))
            middle = np.flatnonzero((a != 32) & (a != 10))
            kinds = Counter({RANGES[i][1] if i >= 0 else "Other": n for i, n in zip(*(x.tolist() for x in np.unique(np.searchsorted(_STARTS, a[middle], side="right") - 1, return_counts=True)))})
            yield from ((name, k, -1, n) for k, n in kinds.items())
            found, n = np.unique(cells_of(a, middle, cells), return_counts=True)
            yield from ((name, None, c, k) for c, k in zip(found.tolist(), n.tolist()))

    parts = rows_operator(sample, ["_lang", "_text"], count, "lang string, script string, cell int, n long")
    counts = cut(parts.groupBy("lang", "script", "cell").agg(F.sum("n").alias("n")), f"{at}/counts")
    # one number for each cell and language at most
    local = counts.where("script is null").select("lang", "cell", "n").toPandas()
    column = {name: i for i, name in enumerate(languages)}
    table = np.zeros((cells, len(languages)), np.float32)
    table[local["cell"].to_numpy(np.int64), local["lang"].map(column).to_numpy(np.int64)] = local["n"].to_numpy(np.float32)
    floor = 0.5
    used = int((table.sum(axis=1) > 0).sum()) + 1
    norm = np.log(table.sum(axis=0, dtype=np.float64) + floor * used)
    table = np.log(table + np.float32(floor)) - norm.astype(np.float32)
    scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for r in counts.where("script is not null").collect():
        scripts[r["script"]][column[r["lang"]]] = r["n"]
    whole = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
    return Model(languages, table, {s: some for s, c in scripts.items() if (some := c / whole >= USED).any()})


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score (share of letters), n_spans."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys, outs, texts):
        m = shared.value
        for k, out, t in zip(keys, outs, texts):
            yield k, out, *m.label(t)

    kind = docs.schema[key].dataType.simpleString()
    return rows_operator(docs, [key, held_out(key).alias("_out"), text], run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, n_spans int")
