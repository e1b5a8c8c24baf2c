"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and long hexadecimal strings.
Beside them, tokens of mixed character classes and high entropy are candidates.
All values are hashed, and each hash is counted over the distinct repositories
and distinct owners that hold it.  A value with more than EXAMPLE_OWNERS owners
or EXAMPLE_REPOSITORIES repositories is a widely copied example; one with fewer
of both, of high entropy, is owner-specific and live-looking.  Live-looking candidates add spans of kind token; base spans
always stay.

Defined results: a null text counts as empty, with no spans.  A null repository
or owner counts as one value of its own.  Repeated rows count once for their
repository and owner.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, rows_operator, shared_dir

# The base patterns, in the order of their kinds, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex", "token")
#: Candidates beside the base patterns, and the bits per character that a live-looking value has.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
LEAST_BITS = 3.0
#: Distinct owners, or repositories of any owners, beyond which a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 100
_HINTS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)


def bits(value: str) -> float:
    """Entropy of a value's characters, in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of all base matches, leftmost and without overlap within a kind, in order.

    A run of 24 or more hexadecimal digits is what the unbounded pattern
    matches there too, and so it is with access keys; an assignment is matched
    first and measured after, as a short value uses up its text.
    """
    found = []
    if _HINTS.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates outside base spans: at least two of lower case, upper case and digits, one of them digits, and high entropy."""
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        v = m[0]
        if not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)) or bits(v) < LEAST_BITS:
            continue
        while i < len(base) and base[i][2] <= m.start():
            i += 1
        if not any(b[0] < m.end() and m.start() < b[2] for b in base[i:]):
            out.append((m.start(), 3, m.end(), v))
    return out


def scan(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and the spans of each row, with the hash and entropy of their values."""
    n = len(keys)

    def run(*columns):
        for row in zip(*columns):
            t = row[n] or ""
            base = base_spans(t)
            every = sorted(base + candidate_spans(t, base))
            yield (*row[:n], [{"start": a, "kind": k, "end": z, "hash": hashlib.sha256(v.encode()).hexdigest(), "bits": bits(v)} for a, k, z, v in every])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return rows_operator(docs, [*keys, text], run, f"{kinds}, spans array<struct<start: int, kind: int, end: int, hash: string, bits: double>>")


def ownership(found: DataFrame, repository: str = "repository", owner: str = "owner") -> DataFrame:
    """For each hash: n_found, n_repositories, n_owners, example.

    Rows are reduced to distinct (hash, owner, repository) before they are
    counted, so that a value that everyone copies isn't one task's work.
    """
    told = found.select("hash", F.struct(F.col(owner).alias("x")).alias("o"), F.struct(F.col(repository).alias("x")).alias("r"))
    pairs = told.groupBy("hash", "o", "r").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "o").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    by_owner = owners.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count("*").alias("n_owners"))
    by_repository = pairs.groupBy("hash", "r").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    return by_owner.join(by_repository, "hash").withColumn("example", (F.col("n_owners") > EXAMPLE_OWNERS) | (F.col("n_repositories") > EXAMPLE_REPOSITORIES))


def _written(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, and how its values are owned.

    n_live: values of high entropy that few owners and repositories hold;
    n_example: values that many hold.  The spans column has all base spans and
    the live candidates; owned has n_repositories:n_owners of each of them.
    """
    at = shared_dir(docs.sparkSession)
    columns = docs.select(F.col(key).alias("key"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    rows = cut(scan(columns, ["key", "repository", "owner"], "text"), f"{at}/scanned")
    some = cut(rows.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()), f"{at}/some")
    found = some.select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", "s.*")
    owned = cut(ownership(found), f"{at}/owned")
    joined = join_groups(found.select("row", "start", "kind", "end", "bits", "hash"), owned.select("hash", "n_found", "n_repositories", "n_owners", "example"), "hash", "n_found", found.count())
    live = ~F.col("example") & (F.col("bits") >= LEAST_BITS)
    # a document's own spans come together again; they are as many as its text holds
    told = joined.groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end", "n_repositories", "n_owners"))).alias("shown"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"),
    )
    base = F.filter("shown", lambda s: s["kind"] < 3)

    counts = F.array_join(F.transform(F.array_sort("shown"), lambda s: F.concat_ws(":", s["n_repositories"], s["n_owners"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("shown", lambda s: s["kind"] == kind)).cast("long")

    def out(rows_: DataFrame) -> DataFrame:
        return rows_.select(
            F.col("key").alias(key), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
            F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("shown")).alias("spans"), counts.alias("owned"), "n_live", "n_example",
        )

    zero = F.lit(0).cast("long")
    none = rows.where(F.size("spans") == 0).select("key", F.expr("cast(array() as array<struct<start: int, kind: int, end: int, n_repositories: bigint, n_owners: bigint>>)").alias("shown"), zero.alias("n_live"), zero.alias("n_example"))
    return out(some.select("row", "key").join(told, "row").drop("row").unionByName(none))
