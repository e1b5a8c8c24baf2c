"""Seeds, suggestions, neighbourhood facts and change advice over the code graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import basename, is_test
from ..model import CodeGraph
from .history import ages, cochange, commit_counts, velocity
from .scoring import file_blast
from .search import bonus, query_tokens, search
from .structure import holders, stem_of

# Entry points by file name and by symbol name, antonyms, documentation extensions.
ENTRY_FILES = ("main.py", "app.py", "server.py", "cli.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "index.ts", "index.js", "main.ts", "main.go", "main.rs", "lib.rs")
ENTRY_SYMBOLS = ("main", "run", "start", "serve", "cli")
ANTONYMS = (("start", "stop"), ("open", "close"), ("acquire", "release"), ("push", "pop"), ("red", "blue"), ("small", "large"), ("old", "new"), ("encode", "decode"), ("load", "save"), ("add", "remove"))
DOC_EXTENSIONS = ("md", "rst", "txt", "adoc")


def is_hot_source(path: Column) -> Column:
    """Files whose churn counts: neither tests, by name or folder, nor documentation."""
    low, name = F.lower(path), F.lower(basename(path))
    folder = low.rlike(r"(^|/)(tests?|specs?|__tests__)/")
    test = name.startswith("test_") | name.startswith("spec_") | name.rlike(r"(_test\.(py|go|rb)|\.(test|spec)\.(ts|tsx|js))$")
    return ~(folder | test | F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*DOC_EXTENSIONS))


def seeds(g: CodeGraph, query: str, most: int = 10) -> DataFrame:
    """Search hits with at least 0.3 of the best score, and 2; tests only where nothing else is."""
    rows = search(g, query).limit(50)
    top = F.max("score").over(W.partitionBy(F.lit(0)))  # of 50 rows
    rows = rows.withColumn("_top", top).where(F.col("score") >= F.greatest(0.3 * F.col("_top"), F.lit(2.0))).withColumn("_test", is_test(F.col("file_path")))
    rows = rows.withColumn("_all", F.min(F.col("_test").cast("int")).over(W.partitionBy(F.lit(0)))).where(~F.col("_test") | (F.col("_all") == 1))
    return rows.orderBy(F.desc("score"), "file_path", "line_start", "id").limit(most).select("id", "score")


def suggestions(g: CodeGraph, query: str, each: int = 10, most: int = 5) -> DataFrame:
    """Alternatives for a query without hits: the best symbols of each of its words."""
    out = None
    for i, t in enumerate(t for t in query_tokens(query) if len(t) > 2):
        rows = search(g, t).limit(each).select("id", "score", F.lit(i).alias("word"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return g.symbols.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("word"))
    return out.groupBy("id").agg(F.max("score").alias("score"), F.min("word").alias("word")).orderBy("word", F.desc("score"), "id").limit(most)


def with_bonus(g: CodeGraph, fused: DataFrame, most: int = 50) -> DataFrame:
    """Fused scores (id, score) times 100, with the structural bonus."""
    cross = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("cross_callers"))
    rows = fused.join(g.symbols, "id").join(cross, "id", "left").na.fill(0, ["cross_callers"])
    return rows.select("id", F.round(F.col("score") * 100 + bonus(), 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def orbit(g: CodeGraph, path: str, query: str, most: int = 3) -> DataFrame:
    """The symbol of each co-change partner of a file that holds most words of a query."""
    partners = cochange(g).where(F.col("path") == path).select(F.col("partner").alias("file_path"), "frequency")
    hits = sum((F.lower("name").contains(t).cast("int") for t in query_tokens(query)), F.lit(0))
    rows = g.symbols.join(partners, "file_path").withColumn("hits", hits).where("hits > 0")
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("hits"), "id"))).where("_r = 1")
    return best.orderBy(F.desc("frequency"), "id").limit(most).select("id", "hits")


def key_files_in(texts: DataFrame, text: str = "text", keywords: tuple[str, ...] = (), most: int = 15) -> DataFrame:
    """path, n, tier: paths that texts mention; sources before tests before examples, then those that a keyword names, by mentions.

    A file with over 30 % of more than six mentions is a tier lower, unless a keyword of four letters or more is in its stem
    or a line that begins with ● shows a symbol of it.
    """
    ends = "py|ts|tsx|js|jsx|go|rs|java|cs|rb"
    known = texts.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = known.select(F.explode(F.regexp_extract_all("_t", F.lit(rf"\b((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.(?:{ends}))\b"), 1)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    shown = known.select(F.explode(F.regexp_extract_all("_t", F.lit(rf"(?m)^[ \t]*●.*?—\s+(\S+\.(?:{ends})):\d"), 1)).alias("path")).distinct().withColumn("_shown", F.lit(True))
    low = F.lower("path")
    stem = F.regexp_replace(basename(low), r"\.[^.]*$", "")
    named = F.lit(False)
    for k in keywords:
        if len(k) > 3:
            named = named | stem.contains(k.lower())
    tier = F.when(low.rlike("example|tutorial|demo|sample"), 2).when(low.rlike("test|spec|fixture"), 1).otherwise(0)
    rows = rows.join(shown, "path", "left").withColumn("named", named)
    total = rows.agg(F.sum("n").alias("_total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    hub = (F.col("_total") > 6) & (F.col("n") > 0.3 * F.col("_total")) & ~F.col("named") & F.col("_shown").isNull()
    rows = rows.select("path", "n", (tier + hub.cast("int")).alias("tier"), "named")
    return rows.orderBy("tier", F.desc("named"), F.desc("n"), "path").limit(most).drop("named")


def importance(g: CodeGraph, hot: DataFrame) -> DataFrame:
    """id, importance, utility: twice the outside callers, exported, twice for hot files; utility: ten caller files or more."""
    cross = g.calls.where("source_file <> target_file").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("c"), F.countDistinct("source_file").alias("f"))
    warm = hot.select(F.col("path").alias("file_path"), F.lit(2).alias("_h")).distinct()
    rows = g.symbols.join(cross, "id", "left").join(warm, "file_path", "left").na.fill(0, ["c", "f", "_h"])
    return rows.select("id", (2 * F.col("c") + F.col("exported").cast("int") + F.col("_h")).cast("long").alias("importance"), (F.col("f") >= 10).alias("utility"))


def relay_points(g: CodeGraph) -> DataFrame:
    """id, via, best, total: a callee in another file that makes up 65 % or more of what a symbol's callees reach."""
    cross = g.calls.where("source_file <> target_file").select("source_id", "target_id")
    reach = cross.groupBy(F.col("source_id").alias("target_id")).agg(F.count("*").alias("reach"))
    rows = cross.join(reach, "target_id", "left").na.fill(0, ["reach"])
    best = rows.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.sum("reach").alias("total"), F.max("reach").alias("best"), F.min(F.struct((-F.col("reach")).alias("r"), "target_id")).alias("m"))
    return best.where("n >= 2 and total >= 8 and best >= 5 and best >= 0.65 * total").select("id", F.col("m.target_id").alias("via"), "best", "total")


def silent_members(g: CodeGraph, complexity: int = 5) -> DataFrame:
    """Members without callers outside tests whose class is complex enough or is called from other files: id, parent_id."""
    called = g.calls.where(~is_test(F.col("source_file"))).select(F.col("target_id").alias("id")).distinct()
    owners = g.symbols.where("kind = 'class'").select(F.col("id").alias("parent_id"), (F.col("complexity") >= complexity).alias("_cx"))
    outside = g.calls.where(~is_test(F.col("source_file"))).where("source_file <> target_file").select(F.col("target_id").alias("parent_id")).distinct().withColumn("_out", F.lit(True))
    rows = g.symbols.where("parent_id is not null").select("id", "parent_id").join(called, "id", "left_anti").join(owners, "parent_id").join(outside, "parent_id", "left")
    return rows.where("_cx or _out").select("id", "parent_id")


def calm_zones(g: CodeGraph, now: str, importers: int = 5, most: int = 4) -> DataFrame:
    """Widely imported files that hardly change."""
    used = g.imports.where(~is_test(F.col("source_id"))).groupBy(F.col("target_id").alias("path")).agg(F.count("*").alias("importers")).where(F.col("importers") >= importers)
    rows = used.join(velocity(g, now, 14), "path", "left").na.fill(0.0, ["per_week"]).where("per_week < 2")
    return rows.orderBy(F.desc("importers"), "path").limit(most).select("path", "importers")


def badges(g: CodeGraph) -> DataFrame:
    """id, tested, dense, complex: marks that hotspot lists show."""
    lines = F.col("line_end") - F.col("line_start") + 1
    tested = g.calls.where(is_test(F.col("source_file"))).select(F.col("target_id").alias("id")).distinct().withColumn("_t", F.lit(True))
    rows = g.symbols.where(F.col("kind").isin("function", "method")).join(tested, "id", "left")
    return rows.select("id", F.col("_t").isNotNull().alias("tested"), ((F.col("complexity") >= 3) & (lines >= 5) & (F.col("complexity") / lines >= 0.5)).alias("dense"), (F.col("complexity") >= 20).alias("complex"))


def recently_active(g: CodeGraph, most: int = 3) -> DataFrame:
    return commit_counts(g).where(is_hot_source(F.col("path"))).orderBy(F.desc("commits"), "path").limit(most)


def entry_points(g: CodeGraph, most: int = 15) -> DataFrame:
    """Files and top-level symbols that start a program, outside tests, examples and benchmarks."""
    outside = ~is_test(F.col("file_path")) & ~F.lower("file_path").rlike("(^|/)(examples?|bench(marks?)?|tests?)/")
    files = g.files.where(outside & basename(F.col("file_path")).isin(*ENTRY_FILES)).select(F.col("file_path").alias("entry"))
    symbols = g.symbols.where(outside & F.col("parent_id").isNull() & F.col("name").isin(*ENTRY_SYMBOLS)).select(F.col("id").alias("entry"))
    return files.unionByName(symbols).distinct().orderBy("entry").limit(most)


def symbol_blast(g: CodeGraph, query: str, most: int = 5) -> DataFrame:
    """id, outside, local, renderers, children of a query's best hits."""
    hits = search(g, query).select("id").limit(most)
    far = F.col("source_file") != F.col("target_file")
    calls = g.calls.groupBy(F.col("target_id").alias("id")).agg(F.count_if(far).alias("outside"), F.count_if(~far).alias("local"))
    rend = g.pairs("renders").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("renderers"))
    kids = g.of_kind("contains").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("children"))
    return hits.join(calls, "id", "left").join(rend, "id", "left").join(kids, "id", "left").na.fill(0)


def diff_dependents(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """section, item: callers of changed files outside the change, tests to run, and changed files that no test reaches."""
    own = changed.select(F.col("path").alias("file_path")).distinct()
    calls = g.calls.join(own.select(F.col("file_path").alias("target_file")), "target_file", "left_semi").where("source_file <> target_file")
    imports = g.imports.join(own.select(F.col("file_path").alias("target_id")), "target_id", "left_semi")
    users = calls.select("target_file", "source_file").unionByName(imports.select(F.col("target_id").alias("target_file"), F.col("source_id").alias("source_file"))).distinct()
    outside = users.select(F.col("source_file").alias("file_path")).distinct().join(own, "file_path", "left_anti")
    test = is_test(F.col("file_path"))
    reached = users.where(is_test(F.col("source_file"))).select(F.col("target_file").alias("file_path")).distinct()
    untested = own.where(~test).join(reached, "file_path", "left_anti")
    return (
        outside.where(~test).select(F.lit("dependent").alias("section"), F.col("file_path").alias("item")).unionByName(outside.where(test).select(F.lit("test").alias("section"), F.col("file_path").alias("item")))
        .unionByName(untested.select(F.lit("untested").alias("section"), F.col("file_path").alias("item")))
    )


def parameter_idioms(g: CodeGraph, least: int = 3) -> DataFrame:
    """params, n: sets of parameter names that several functions share, self and cls aside."""
    inner = F.regexp_extract("signature", r"\(([^)]*)\)", 1)
    names = F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_extract(F.trim(p), r"^\**(\w+)", 1)), lambda p: (p != "") & ~p.isin("self", "cls"))
    rows = g.symbols.where(F.col("kind").isin("function", "method")).select(F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("params"))
    return rows.where("params <> ''").groupBy("params").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def name_series(g: CodeGraph, least: int = 3) -> DataFrame:
    """file_path, stem, n: symbols of a file that differ by a trailing number or letter only."""
    stem = F.regexp_replace("name", r"_?(\d+|[A-C])$", "")
    return g.symbols.select("file_path", "name", stem.alias("stem")).where("stem <> name and stem <> ''").groupBy("file_path", "stem").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= least)


def counterparts(g: CodeGraph) -> DataFrame:
    """id, counterpart: functions and methods of one file whose names differ by one word and its antonym."""
    pairs = [x for a, b in ANTONYMS for x in ((a, b), (b, a))]
    swap = F.create_map(*[F.lit(x) for p in pairs for x in p])
    rows = g.symbols.where(F.col("kind").isin("function", "method")).select("id", "file_path", F.regexp_replace("name", r"_\d+$", "").alias("name"))
    parts = F.split("name", "_")
    made = F.filter(F.transform(parts, lambda p, i: F.when(swap[p].isNotNull(), F.array_join(F.transform(parts, lambda q, j: F.when(j == i, swap[p]).otherwise(q)), "_"))), lambda x: x.isNotNull())
    want = rows.select("id", "file_path", F.explode(made).alias("name"))
    return want.join(rows.select(F.col("id").alias("counterpart"), "file_path", "name"), ["file_path", "name"]).select("id", "counterpart")


def stem_matches(g: CodeGraph) -> DataFrame:
    """file_path, test: tests whose base name holds a source file's stem."""
    files = g.files.select("file_path", stem_of(F.col("file_path")).alias("stem"), basename(F.col("file_path")).alias("name"))
    tests = files.where(is_test(F.col("file_path"))).select(F.col("file_path").alias("test"), "name")
    own = files.where(~is_test(F.col("file_path"))).select("file_path", "stem")
    found = holders(own.select("stem").distinct(), tests.select("name").distinct())
    return own.join(found, "stem").join(tests, "name").select("file_path", "test")


# Marks of files that a path look-up leaves out, and parts of keywords that are too general for one.
_ASIDE = ("test", "spec", "fixture", "example", "tutorial", "demo", "sample")
_ASSETS = ("templates", "static")
_GENERAL_SNAKE = (
    "response", "request", "error", "errors", "option", "options", "handler", "handlers", "helper", "helpers", "server", "client", "router", "static", "analysis", "middleware", "security",
)
_GENERAL_CAMEL = (
    "import", "test", "tests", "type", "types", "base", "core", "util", "utils", "data", "form", "list", "dict", "object", "class", "model", "models", "view", "views", "helper", "helpers",
    "mixin", "mixins", "return", "raise", "yield", "async", "await", "error", "errors", "init", "main", "common", "factory", "manager", "field", "fields", "exception", "exceptions", "json", "xml",
    "host", "method", "setter", "getter",
)


def path_fallback(g: CodeGraph, keyword: str, most: int = 5) -> DataFrame:
    """file_path: source files whose path holds a keyword without a symbol, or else the first of its parts that at most most paths hold."""
    snake = "_" in keyword
    parts = keyword.split("_") if snake else re.findall("[A-Z]?[^A-Z]+|[A-Z]", keyword)
    general = _GENERAL_SNAKE if snake else _GENERAL_CAMEL
    tokens = [keyword, *(p for p in parts if len(p) >= 4 and p.lower() not in general)]
    low = F.lower("file_path")
    files = g.symbols.select("file_path").distinct().where(~F.exists(F.split("file_path", "/"), lambda x: x.isin(*_ASSETS)))
    # a keyword has a few parts; each file is held against all of them in one pass
    held = F.array(*[F.when(low.contains(t.lower()), i) for i, t in enumerate(tokens)])
    rows = files.where(~low.rlike("|".join(_ASIDE))).select("file_path", F.explode(F.array_compact(held)).alias("place"))
    best = rows.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") <= most).agg(F.min("place").alias("place"))
    return rows.join(F.broadcast(best), "place").select("file_path")  # best is one row


def coverage(g: CodeGraph, words: list[str], files: DataFrame) -> DataFrame:
    """resolved, total, share, files, confidence: how many words of a task are names of symbols, and the number of files that its context names."""
    asked = files.sparkSession.createDataFrame([(i, w.lower()) for i, w in enumerate(words)], "i int, low string")
    known = g.symbols.select(F.lower("name").alias("low")).join(F.broadcast(asked.select("low").distinct()), "low", "left_semi").distinct()
    told = asked.join(known.withColumn("known", F.lit(True)), "low", "left").agg(F.count("known").alias("resolved"), F.count("*").alias("total"))
    share = F.col("resolved") / F.greatest("total", F.lit(1))
    number = files.select("file_path").distinct().agg(F.count("*").alias("files"))
    confidence = F.when(share > 0.75, "high").when(share >= 0.4, "medium").otherwise("low")
    return told.withColumn("share", F.round(share, 6)).crossJoin(number).withColumn("confidence", confidence)  # one row each


def staleness(g: CodeGraph, now: str) -> DataFrame:
    """id, callers: recently changed symbols' callers in files untouched for 90 days."""
    age = ages(g, now).select(F.col("path").alias("file_path"), "days")
    fresh = g.symbols.join(age.where("days < 30"), "file_path").select(F.col("id").alias("target_id"))
    old = age.where("days >= 90").select(F.col("file_path").alias("source_file"))
    rows = g.calls.where("source_file <> target_file").join(fresh, "target_id", "left_semi").join(old, "source_file", "left_semi")
    return rows.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))


def hidden_coupling(g: CodeGraph, least: float = 0.5) -> DataFrame:
    """path, partner: files that change together without an import either way."""
    pairs = cochange(g).where(F.col("frequency") >= least).select("path", "partner")
    linked = g.imports.select(F.col("source_id").alias("path"), F.col("target_id").alias("partner"))
    both = linked.unionByName(linked.select(F.col("partner").alias("path"), F.col("path").alias("partner"))).distinct()
    return pairs.join(both, ["path", "partner"], "left_anti")


def change_exposure(g: CodeGraph) -> DataFrame:
    """file_path, risk: how far a change of a file carries, by its dependents."""
    total = F.col("blast_total")
    return file_blast(g).select("file_path", F.when(total >= 16, "HIGH").when(total >= 6, "MEDIUM").otherwise("LOW").alias("risk"))
