"""Queries by operator: each takes (spark, sf_dir); where SQL can express it, its DuckDB form stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..model import CodeGraph
from ..functions.keywords import keywords_column
from ..functions.text import simple_upper
from ..operators import advice, components, context, families, focus, history, index, lookup, reports, resolve, review, scoring, search, structure, tasks, telemetry, traverse
from ..session import ship, step_folder
from ..sources.logs import export, folder_notes
from ..sources.projection import NOW, graph, table, usage
from .oracle import GRAPH, USAGE, is_test, module

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# What the look-up queries ask for.
SYMBOL = "select id from symbols where seq = 30"
QUESTION_NAME, PHRASE, TERMS = "small_ring_0", "red widget ring", "the and of"
QUESTIONS = "red widget ring | small bolt"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def over_graph(name: str, body: str | None, f: Callable, *args, **options) -> None:
    """Register f(graph, ...) with the body of its SQL."""
    query(name, GRAPH + body if body else None)(lambda spark, d: f(graph(spark, d), *args, **options))


def over_usage(name: str, body: str | None, f: Callable, **options) -> None:
    query(name, USAGE + body if body else None)(lambda spark, d: f(usage(table(spark, d, "events")), **options))


def _id(g, seq: int) -> str:
    """The id of one symbol: one row comes to the driver."""
    row = g.symbols.where(F.col("seq") == seq).select("id").first()
    return row[0] if row else ""


def _symbol_name(g, seq: int) -> str:
    """The name of one symbol."""
    return _id(g, seq).split("::")[-1]


def _file(g, seq: int) -> str:
    return _id(g, seq).split("::")[0]


# --- scans and files -------------------------------------------------------------------------------------------------
query(
    "o002_size_cutoff",
    "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) <= 20000",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes <= 20000"))

query(
    "o003_line_count",
    r"""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents""",
)(
    lambda s, d: table(s, d, "documents").select(
        "doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), 1).otherwise(0)).cast("long").alias("lines")
    )
)

query("o004_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash")))


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What a store knows and what a new scan finds: every 10th file is new, every 7th gone, every 5th edited, every 3rd touched."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    i = F.col("path")
    stored = docs.where(i % 10 != 0).select("path", "hash", i.alias("mtime"))
    found = docs.where(i % 7 != 0).select("path", F.when(i % 5 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"), F.when((i % 5 == 0) | (i % 3 == 0), i + 1).otherwise(i).alias("mtime"))
    return stored, found


_VERSIONS_SQL = """
WITH docs AS (SELECT doc_id AS path, md5(text) AS hash FROM documents),
stored AS (SELECT path, hash, path AS mtime FROM docs WHERE path % 10 <> 0),
found AS (SELECT path, CASE WHEN path % 5 = 0 THEN hash || 'x' ELSE hash END AS hash, CASE WHEN path % 5 = 0 OR path % 3 = 0 THEN path + 1 ELSE path END AS mtime FROM docs WHERE path % 7 <> 0)
"""


@query("o008_change_detection", _VERSIONS_SQL + """
SELECT coalesce(s.path, f.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'gone' WHEN s.mtime = f.mtime THEN 'same' WHEN s.hash = f.hash THEN 'touched' ELSE 'changed' END AS status
FROM stored s FULL JOIN found f ON s.path = f.path""")
def _changes(s, d):
    from ..sources.files import changes

    return changes(*_versions(s, d))


@query("o006_upsert", _VERSIONS_SQL + "SELECT path, hash FROM found UNION ALL SELECT path, hash FROM stored WHERE path NOT IN (SELECT path FROM found)")
def _upsert(s, d):
    from ..sources.files import upsert

    stored, found = _versions(s, d)
    return upsert(stored.select("path", "hash"), found.select("path", "hash"), "path")


query("o007_stale_files", _VERSIONS_SQL + "SELECT path FROM stored WHERE path NOT IN (SELECT path FROM found)")(
    lambda s, d: (lambda v: v[0].join(v[1], "path", "left_anti").select("path"))(_versions(s, d))
)

query(
    "o_import_links",
    """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""",
)(
    lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))
)

# --- look-ups --------------------------------------------------------------------------------------------------------
_BRIEF = "SELECT id, kind, file_path, line_start FROM symbols WHERE id IN "
for _name, _f, _kind, _given, _wanted in (
    ("o020_callers", lookup.callers_of, "calls", "target_id", "source_id"), ("o020_callees", lookup.callees_of, "calls", "source_id", "target_id"),
    ("o020_children", lookup.children_of, "contains", "source_id", "target_id"), ("o020_renderers", lookup.renderers_of, "renders", "target_id", "source_id"),
):
    _seq = {"o020_renderers": 31}.get(_name, 30)
    query(_name, GRAPH + f"{_BRIEF} (SELECT {_wanted} FROM edges WHERE kind = '{_kind}' AND {_given} = (SELECT id FROM symbols WHERE seq = {_seq}))")(
        lambda s, d, f=_f, q=_seq: (lambda g: f(g, _id(g, q)))(graph(s, d))
    )
query("o021_importers", GRAPH + "SELECT source_id AS file_path FROM imports WHERE target_id = (SELECT file_path FROM symbols WHERE seq = 30)")(lambda s, d: (lambda g: lookup.importers_of(g, _file(g, 30)))(graph(s, d)))
query("o021_imports", GRAPH + "SELECT target_id AS file_path FROM imports WHERE source_id = (SELECT file_path FROM symbols WHERE seq = 30)")(lambda s, d: (lambda g: lookup.imports_of(g, _file(g, 30)))(graph(s, d)))
query("o022_subtypes", GRAPH + _BRIEF + "(SELECT source_id FROM edges WHERE kind = 'inherits' AND target_id = (SELECT id FROM symbols WHERE seq = 30))")(lambda s, d: (lambda g: lookup.subtypes_of(g, _id(g, 30).split("::")[-1]))(graph(s, d)))
query("o023_symbols_in_file", GRAPH + "SELECT id, kind, file_path, line_start FROM symbols WHERE file_path = (SELECT file_path FROM symbols WHERE seq = 30)")(lambda s, d: (lambda g: lookup.symbols_in(g, _file(g, 30)))(graph(s, d)))
over_graph("o024_find_symbol", f"SELECT id, kind, file_path, line_start FROM symbols WHERE lower(name) = '{QUESTION_NAME}' OR lower(qualified_name) = '{QUESTION_NAME}'", lookup.find, QUESTION_NAME.upper())
over_graph("o025_lookup_where", f"SELECT id, kind, file_path, line_start FROM symbols WHERE lower(name) = '{QUESTION_NAME}' ORDER BY id LIMIT 10", lookup.lookup, f"where is the {QUESTION_NAME} defined?")
over_graph("o025_lookup_callers", f"{_BRIEF} (SELECT source_id FROM calls WHERE target_id IN (SELECT id FROM symbols WHERE lower(name) = '{QUESTION_NAME}')) ORDER BY id LIMIT 15", lookup.lookup, f"who calls {QUESTION_NAME}?")
over_graph("o026_rename_risk", """
SELECT s.id, coalesce(c.callers, 0) AS callers, coalesce(c.outside, 0) AS outside,
    CASE WHEN coalesce(c.callers, 0) >= 8 OR coalesce(c.outside, 0) >= 3 THEN 'HIGH' WHEN coalesce(c.callers, 0) >= 2 AND coalesce(c.outside, 0) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM symbols s LEFT JOIN (SELECT target_id, count(*) AS callers, count(DISTINCT CASE WHEN source_file <> target_file THEN source_file END) AS outside FROM calls GROUP BY 1) c ON s.id = c.target_id
WHERE s.kind IN ('function', 'method', 'class', 'interface')""", lookup.rename_risk)
over_graph("o027_test_files", f"SELECT file_path, {is_test('file_path')} AS test FROM files", lambda g: g.files.select("file_path", paths.is_test(F.col("file_path")).alias("test")))
over_graph("o028_file_class", "SELECT file_path, CASE WHEN contains(file_path, '/test_') THEN 'test' ELSE 'source' END AS class FROM files", lambda g: g.files.select("file_path", paths.file_class(F.col("file_path")).alias("class")))
over_graph("o030_domains", "SELECT regexp_replace(split_part(file_path, '/', 2), '[.][^.]*$', '') AS domain, count(*) AS n FROM files GROUP BY 1", lambda g: g.files.groupBy(paths.domain_of(F.col("file_path")).alias("domain")).agg(F.count("*").alias("n")))
over_graph("o032_resolve_path", "SELECT file_path FROM files WHERE ends_with(file_path, '/brand_1_1.py') OR ends_with(file_path, '/brand#1_1.py') ORDER BY 1 LIMIT 8", lookup.resolve_path, "brand_1_1.py")
over_graph("o034_display_paths", """
SELECT file_path, CASE WHEN count(*) OVER (PARTITION BY split_part(file_path, '/', -1)) = 1 THEN split_part(file_path, '/', -1) ELSE file_path END AS shown FROM files""", lookup.display_paths)

# --- search ----------------------------------------------------------------------------------------------------------
_T = ("red", "widget", "ring")
_W = ", ".join(f"{min(len(t) / 3, 2.0)} * CASE WHEN f{i} > 0.15 THEN 0.3 WHEN f{i} > 0.05 THEN 0.6 ELSE 1.0 END AS w{i}" for i, t in enumerate(_T))
_P = " + ".join(f"w{i} * CASE WHEN lower(name) = '{t}' THEN 10.0 WHEN contains(lower(qualified_name), '{t}') THEN 5.0 WHEN contains(lower(signature), '{t}') THEN 3.0 WHEN contains(lower(doc), '{t}') THEN 1.0 WHEN contains(lower(file_path), '{t}') THEN 0.3 ELSE 0.0 END" for i, t in enumerate(_T))
_M = " + ".join(f"CASE WHEN contains(lower(qualified_name), '{t}') OR contains(lower(signature), '{t}') OR contains(lower(doc), '{t}') THEN 1 ELSE 0 END" for t in _T)
_SEARCH = f"""
, freq AS (SELECT {', '.join(f"count(*) FILTER (contains(lower(name), '{t}')) / count(*) AS f{i}" for i, t in enumerate(_T))} FROM symbols), w AS (SELECT {_W} FROM freq),
scored AS (SELECT s.*, {_P} AS base, {_M} AS matched FROM symbols s, w),
cross_calls AS (SELECT target_id, count(*) AS n FROM calls WHERE source_file <> target_file GROUP BY 1),
hits AS (SELECT id, kind, file_path, line_start, round(base + CASE WHEN matched > 1 THEN matched * 4.0 ELSE 0 END + CASE WHEN exported THEN 2.0 ELSE 0 END + least(coalesce(n, 0), 5) * 0.5
    + CASE WHEN kind IN ('component', 'hook') THEN 1.5 WHEN kind = 'class' THEN 1.0 ELSE 0 END, 6) AS score
FROM scored LEFT JOIN cross_calls ON id = target_id WHERE base > 0)"""
over_graph("o050_symbol_search", _SEARCH + " SELECT * FROM hits", search.search, PHRASE)
_BY_SCORE = "ORDER BY score DESC, file_path, line_start, id"

_TERMS = sorted(TERMS.split())
_BM25 = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS len, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))} FROM w),
s AS (SELECT count(*) AS n, avg(len) AS av, {', '.join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(_TERMS)))} FROM t),
scored AS (SELECT doc_id, round({' + '.join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(_TERMS)))}, 6) AS score FROM t, s)
"""
query("o051_bm25", _BM25 + "SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")(lambda s, d: search.bm25(table(s, d, "documents"), TERMS))


@query("o051_index", _BM25 + "SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, asked for the documents with any of the terms."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    made = index.Index(spark, step_folder(spark))
    made.update(0, docs, text="text")
    return made.match(" OR ".join(TERMS.split()), 20).select(F.col("doc").cast("long").alias("doc_id"), "score")


def _vector(s: SparkSession, d: str) -> list[float]:
    row = table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


_KNN = """SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 6) AS distance
FROM embeddings ORDER BY distance, vec_id LIMIT 20"""
query("o052_nearest", _KNN)(lambda s, d: search.nearest(table(s, d, "embeddings"), _vector(s, d)))


@query("o053_rank_fusion", _BM25 + f"""
, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS ra FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rb FROM ({_KNN.replace('LIMIT 20', 'LIMIT 40')}))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1 / (60 + ra), 0) + coalesce(1 / (60 + rb), 0), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def _fusion(s, d):
    left = search.bm25(table(s, d, "documents"), TERMS, n=40)
    right = search.nearest(table(s, d, "embeddings"), _vector(s, d), 40).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(left, right, "doc_id", [F.desc("score"), "doc_id"], ["distance", "doc_id"])


# --- scores and dead code --------------------------------------------------------------------------------------------
_HOT = """
, up AS (SELECT target_id AS id, count(DISTINCT source_file) AS cf, count(DISTINCT CASE WHEN source_file <> target_file THEN source_file END) AS xf FROM calls GROUP BY 1),
down AS (SELECT source_id AS id, count(*) AS n FROM calls GROUP BY 1), kids AS (SELECT source_id AS id, count(*) AS n FROM edges WHERE kind = 'contains' GROUP BY 1),
rend AS (SELECT source_id AS id, count(*) AS n FROM edges WHERE kind = 'renders' GROUP BY 1), blast AS (SELECT file_path, count(*) AS n FROM dependents GROUP BY 1),
hot AS (SELECT s.id, s.file_path, s.kind, coalesce(cf, 0) AS caller_files, coalesce(xf, 0) AS cross_files, coalesce(down.n, 0) AS callees, coalesce(blast.n, 0) AS blast_total,
    round((coalesce(cf, 0) * 3.0 + coalesce(down.n, 0) * 1.5 + least(lines / 10, 50) + coalesce(kids.n, 0) * 2.0 + coalesce(xf, 0) * 5.0 + coalesce(rend.n, 0) * 2.0
        + CASE WHEN complexity > 1 THEN log2(complexity) * 3.0 ELSE 0 END) * (1 + log2(1 + coalesce(per_week, 0)) * 0.2) * (1 + log2(1 + coalesce(blast.n, 0)) * 0.1), 6) AS score
  FROM symbols s LEFT JOIN up ON s.id = up.id LEFT JOIN down ON s.id = down.id LEFT JOIN kids ON s.id = kids.id LEFT JOIN rend ON s.id = rend.id
  LEFT JOIN blast ON s.file_path = blast.file_path LEFT JOIN velocity v ON s.file_path = v.path WHERE s.kind NOT IN ('variable', 'constant', 'enum_member', 'field'))
"""
over_graph("o079_hotspots", _HOT + "SELECT * FROM hot WHERE score > 0 ORDER BY score DESC, id LIMIT 20", scoring.hotspots, NOW)
over_graph("o079_hotspots_all", _HOT + "SELECT * FROM hot WHERE score > 0", scoring.hotspots, NOW, None)
over_graph("o080_file_blast", """
SELECT file_path, count(*) AS blast_total, count(*) FILTER (NOT contains(dependent, '/test_')) AS blast_source, count(*) FILTER (contains(dependent, '/test_')) AS blast_test, 0 AS blast_config
FROM dependents GROUP BY file_path""", scoring.file_blast)
over_graph("o060_dead_code", "SELECT id, kind, file_path, lines FROM dead", lambda g: scoring.dead_code(g).select("id", "kind", "file_path", (F.col("line_end") - F.col("line_start") + 1).alias("lines")))
_TIER = "CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'medium' ELSE 'low' END AS tier"
over_graph("o061_dead_confidence", f"SELECT *, {_TIER} FROM confidence", scoring.dead_confidence)
over_graph("o062_dead_effort", """
SELECT c.file_path, count(*) AS n_dead, sum(lines) AS dead_lines, round(avg(confidence), 6) AS avg_confidence,
    CASE WHEN count(*) * (1 + avg(CASE WHEN x.target_id IS NULL THEN 0.5 ELSE 1.0 END)) > 10 THEN 'HIGH' WHEN count(*) * (1 + avg(CASE WHEN x.target_id IS NULL THEN 0.5 ELSE 1.0 END)) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS effort
FROM confidence c LEFT JOIN (SELECT DISTINCT target_id FROM calls WHERE source_file <> target_file) x ON c.id = x.target_id GROUP BY c.file_path""", scoring.dead_effort)

# --- history ---------------------------------------------------------------------------------------------------------
over_graph("o070_cochange", "SELECT path, partner, together, frequency, rank FROM cochange", history.cochange)
over_graph("o071_cochange_recency", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, partner) AS rank FROM (
    SELECT a AS path, b AS partner, round(share * exp(-0.01 * greatest(0, DATE '2001-08-02' - last)), 6) AS score, greatest(0, DATE '2001-08-02' - last) AS days FROM pairs2
    UNION ALL SELECT b, a, round(share * exp(-0.01 * greatest(0, DATE '2001-08-02' - last)), 6), greatest(0, DATE '2001-08-02' - last) FROM pairs2)) WHERE rank <= 10""", history.cochange_recency, NOW)
_F30 = "(SELECT file_path FROM symbols WHERE seq = 30)"
query("o072_cochange_pairs", GRAPH + f"""SELECT path, count(*) AS together FROM coupled WHERE commit_id IN (SELECT commit_id FROM coupled WHERE path = {_F30}) AND path <> {_F30} AND NOT contains(path, '/test_')
GROUP BY path HAVING count(*) >= 3 ORDER BY together DESC, path LIMIT 3""")(lambda s, d: (lambda g: history.cochange_of(g, _file(g, 30)))(graph(s, d)))
query("o073_cochange_ratio", GRAPH + f""", own AS (SELECT DISTINCT commit_id FROM commit_files WHERE path = {_F30}), r AS (SELECT path, count(*) AS together, round(count(*) / (SELECT count(*) FROM own), 6) AS ratio FROM commit_files WHERE commit_id IN (SELECT commit_id FROM own) AND path <> {_F30} GROUP BY path)
SELECT * FROM r WHERE together >= 3 AND ratio >= 0.5 AND (SELECT count(*) FROM own) >= 3 ORDER BY ratio DESC, path LIMIT 10""")(lambda s, d: (lambda g: history.cochange_ratio(g, _file(g, 30)))(graph(s, d)))
over_graph("o074_commit_counts", "SELECT path, count(DISTINCT commit_id) AS commits FROM commit_files GROUP BY path", history.commit_counts)
over_graph("o075_velocity", "SELECT path, round(count(DISTINCT commit_id) * 7.0 / 30, 6) AS per_week FROM commit_files WHERE day >= DATE '2001-08-02' - 30 GROUP BY path", lambda g: history.velocity(g, NOW, 30).withColumn("per_week", F.round("per_week", 6)))
over_graph("o076_file_ages", """SELECT path, days, CASE WHEN days <= 7 THEN 'HOT' WHEN days <= 30 THEN 'WARM' ELSE 'STABLE' END AS label FROM (SELECT path, DATE '2001-08-02' - max(day) AS days FROM commit_files GROUP BY path) WHERE days <= 730""", history.ages, NOW)
_LATEST = "(SELECT commit_id FROM (SELECT DISTINCT commit_id, day FROM commit_files) ORDER BY day DESC, commit_id DESC LIMIT 20)"
over_graph("o077_recent_files", f"SELECT DISTINCT path FROM commit_files WHERE commit_id IN {_LATEST}", history.recent_files)
_CHANGED = "(SELECT path FROM commit_files WHERE commit_id = (SELECT commit_id FROM commit_files GROUP BY commit_id, day HAVING count(*) >= 5 ORDER BY day DESC, commit_id DESC LIMIT 1))"
over_graph("o048_missing_partners", f"SELECT path, partner, frequency FROM cochange WHERE path IN {_CHANGED} AND frequency >= 0.01 AND partner NOT IN {_CHANGED}", lambda g: history.missing_partners(g, history.newest_change(g), 0.01))
over_graph("o094_changed_symbols", f"""SELECT s.id, count(c.source_id) AS outside_calls FROM symbols s LEFT JOIN (SELECT * FROM calls WHERE source_file <> target_file) c ON s.id = c.target_id WHERE s.file_path IN {_CHANGED} GROUP BY s.id""",
    lambda g: g.symbols.join(history.newest_change(g).withColumnRenamed("path", "file_path"), "file_path", "left_semi").join(g.calls.where("source_file <> target_file").select(F.col("target_id").alias("id"), "source_id"), "id", "left").groupBy("id").agg(F.count("source_id").alias("outside_calls")))

# --- structure -------------------------------------------------------------------------------------------------------
over_graph("o078_stats", """
SELECT 'files' AS what, 'all' AS name, count(*) AS n FROM files UNION ALL SELECT 'symbols', 'all', count(*) FROM symbols UNION ALL SELECT 'edges', 'all', count(*) FROM edges
UNION ALL SELECT 'kind', kind, count(*) FROM symbols GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM symbols GROUP BY language""", structure.stats)
over_graph("o066_folders", "SELECT module AS folder, count(DISTINCT file_path) AS files, sum(lines) AS lines, count(*) AS symbols, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM symbols GROUP BY module", structure.folders)
over_graph("o067_file_health", """
, h AS (SELECT s.file_path, count(*) AS symbols, avg(complexity) AS cx, CAST(floor(100 * count(c.id) / count(*)) AS BIGINT) AS dead_pct FROM symbols s LEFT JOIN confidence c ON s.id = c.id GROUP BY s.file_path)
SELECT file_path, symbols, dead_pct, round(cx, 6) AS avg_cx, CASE WHEN dead_pct > 80 THEN 'dead' WHEN cx > 50 THEN 'hotspot' WHEN dead_pct < 20 AND cx < 20 THEN 'healthy' ELSE 'stable' END AS health FROM h""", structure.file_health)
over_graph("o068_file_edges", """
SELECT least(x.file_path, y.file_path) AS a, greatest(x.file_path, y.file_path) AS b, count(*) AS weight FROM edges e JOIN symbols x ON e.source_id = x.id JOIN symbols y ON e.target_id = y.id
WHERE x.file_path <> y.file_path GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 2000""", structure.file_edges)
over_graph("o083_key_files", "SELECT file_path, sum(lines) + 3 * sum(complexity) AS score FROM symbols GROUP BY file_path ORDER BY score DESC, file_path LIMIT 12", structure.key_files)
over_graph("o084_hot_symbols", f"SELECT * FROM (SELECT target_id AS id, count(DISTINCT CASE WHEN NOT {is_test('source_file')} THEN source_file END) AS files, bool_or({is_test('source_file')}) AS tested FROM calls WHERE source_file <> target_file GROUP BY 1) WHERE files >= 3", structure.hot_symbols)
over_graph("o085_stable_core", f"""
SELECT i.path, i.importers, a.days FROM (SELECT target_id AS path, count(*) AS importers FROM imports WHERE NOT {is_test('source_id')} GROUP BY 1 HAVING count(*) >= 1) i
JOIN (SELECT path, DATE '2001-08-02' - max(day) AS days FROM commit_files GROUP BY path) a ON i.path = a.path WHERE days BETWEEN 3 AND 730""", structure.stable_core, NOW, 1, 3)
# files without their last number, so that tests hold the names of some of them
_SHORT = "regexp_replace({}, '_[0-9][.]py$', '.py')"


def _short(g) -> CodeGraph:
    return CodeGraph(g.symbols.withColumn("file_path", F.expr(_SHORT.format("file_path"))), g.edges, g.commit_files.withColumn("path", F.expr(_SHORT.format("path"))))


over_graph("o086_risky_untested", f"""
, g AS (SELECT DISTINCT {_SHORT.format('file_path')} AS file_path FROM files), f AS (SELECT file_path, regexp_replace(split_part(file_path, '/', -1), '[.][^.]*$', '') AS stem FROM g)
SELECT f.file_path, c.commits FROM f JOIN (SELECT {_SHORT.format('path')} AS path, count(DISTINCT commit_id) AS commits FROM commit_files GROUP BY 1 HAVING count(DISTINCT commit_id) >= 5) c ON f.file_path = c.path
WHERE NOT {is_test('f.file_path')} AND NOT EXISTS (SELECT 1 FROM g t WHERE {is_test('t.file_path')} AND contains(split_part(t.file_path, '/', -1), f.stem))""", lambda g: structure.risky_untested(_short(g)))
over_graph("o090_modules", """
SELECT m.module, files, symbols, lines, languages, exports FROM (SELECT module, count(DISTINCT file_path) AS files, count(*) AS symbols, sum(lines) AS lines, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM symbols GROUP BY module) m
LEFT JOIN (SELECT module, string_agg(name, ',' ORDER BY r) AS exports FROM (SELECT module, name, row_number() OVER (PARTITION BY module ORDER BY lines DESC, id) AS r FROM symbols WHERE exported) WHERE r <= 5 GROUP BY module) e ON m.module = e.module""", structure.modules)
_ME = f"""
, i AS (SELECT {module('source_id')} AS source, {module('target_id')} AS target, count(*) AS imports FROM imports GROUP BY 1, 2), c AS (SELECT {module('source_file')} AS source, {module('target_file')} AS target, count(*) AS calls FROM calls GROUP BY 1, 2),
m AS (SELECT coalesce(i.source, c.source) AS source, coalesce(i.target, c.target) AS target, coalesce(imports, 0) AS imports, coalesce(calls, 0) AS calls FROM i FULL JOIN c ON i.source = c.source AND i.target = c.target)
"""
over_graph("o090_module_edges", _ME + "SELECT m.*, EXISTS (SELECT 1 FROM m b WHERE b.source = m.target AND b.target = m.source) AS mutual FROM m WHERE source <> target", structure.module_edges)
over_graph("o090_module_hubs", _ME + "SELECT target AS module, count(*) AS dependents, CAST(sum(imports + calls) AS BIGINT) AS edges FROM m WHERE source <> target GROUP BY target HAVING count(*) >= 2 AND sum(imports + calls) >= 10", structure.module_hubs)
_COUPLING = _ME + f"""
, p AS (SELECT {module('a')} AS x, {module('b')} AS y FROM (SELECT DISTINCT least(path, partner) AS a, greatest(path, partner) AS b FROM cochange WHERE frequency >= SHARE) WHERE a IN (SELECT file_path FROM files) AND b IN (SELECT file_path FROM files)),
d AS (SELECT source, target FROM m WHERE source <> target), k AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS pairs FROM p WHERE x <> y GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, pairs, CASE WHEN (a, b) IN (FROM d) AND (b, a) NOT IN (FROM d) THEN b WHEN (b, a) IN (FROM d) AND (a, b) NOT IN (FROM d) THEN a END AS leads
FROM k WHERE a IN (SELECT source FROM d UNION SELECT target FROM d) AND b IN (SELECT source FROM d UNION SELECT target FROM d)"""
over_graph("o091_live_coupling", _COUPLING.replace("SHARE", "0.5"), structure.live_coupling)
over_graph("o091_loose_coupling", _COUPLING.replace("SHARE", "0.02"), structure.live_coupling, 0.02)
over_graph("o089_noisy_modules", f"""
, x AS (SELECT module, count(*) AS edges FROM (SELECT unnest([{module('source_file')}, {module('target_file')}]) AS module FROM calls WHERE {module('source_file')} <> {module('target_file')}) GROUP BY 1),
f AS (SELECT {module('file_path')} AS module, count(*) AS files FROM files GROUP BY 1)
SELECT f.module, files, coalesce(edges, 0) AS edges, (files >= 10 AND coalesce(edges, 0) = 0) OR (files >= 20 AND coalesce(edges, 0) < 3 AND files > 0.2 * (SELECT sum(files) FROM f)) AS noisy FROM f LEFT JOIN x ON f.module = x.module""", structure.noisy_modules)
_KEPT = " AND ".join(f"NOT starts_with(file_path, '{x}')" for x in structure.ASIDE)
over_graph("o097_quality", f"""
, gone AS (SELECT count(*) AS n FROM confidence WHERE confidence >= 50 AND {_KEPT}), exported AS (SELECT count(*) AS n FROM symbols WHERE exported AND {_KEPT}),
cx AS (SELECT sum(complexity) / greatest(count(*), 1) AS mean FROM symbols WHERE complexity > 0), busy AS (SELECT count(*) AS n FROM (SELECT target_id FROM imports GROUP BY 1 HAVING count(*) > 20)), f AS (SELECT greatest(count(*), 1) AS n FROM files),
names AS (SELECT language, count(*) FILTER (CASE WHEN language = 'python' THEN name LIKE '%\\_%' ESCAPE '\\' AND name = lower(name) ELSE regexp_matches(name, '^\\p{{Ll}}.*\\p{{Lu}}') END) / count(*) AS share
    FROM symbols WHERE kind = 'function' AND language IN ('python', 'typescript', 'javascript') GROUP BY 1 HAVING count(*) >= 3),
q AS (SELECT greatest(0, 100 - CAST(trunc(200.0 * gone.n / greatest(exported.n, 1)) AS BIGINT)) AS minimality, greatest(0, 100 - CAST(trunc(3 * cx.mean) AS BIGINT)) AS simplicity,
    greatest(0, 100 - CAST(trunc(500.0 * busy.n / f.n) AS BIGINT)) AS independence, coalesce(least(100, CAST(trunc((SELECT sum(share) / count(*) FROM names) * 110) AS BIGINT)), 80) AS convention FROM gone, exported, cx, busy, f)
SELECT *, (minimality + simplicity + independence + convention) // 4 AS score FROM q""", structure.quality)
over_graph("o098_families", "SELECT * FROM (SELECT regexp_extract(name, '^([A-Za-z]+)_', 1) AS prefix, count(*) AS members, count(DISTINCT name) AS names FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1) WHERE prefix <> '' AND members >= 2 AND names > 1 ORDER BY members DESC, prefix LIMIT 20", structure.families)
over_graph("o105_size_classes", "SELECT CASE WHEN lines <= 5 THEN 'tiny' WHEN lines <= 20 THEN 'small' WHEN lines <= 50 THEN 'medium' WHEN lines <= 150 THEN 'large' ELSE 'huge' END AS size, count(*) AS n, round(avg(complexity), 6) AS avg_cx FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1", structure.size_classes)
over_graph("o115_top_symbols", "SELECT * FROM (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'component' THEN 1 ELSE 2 END, line_start, id) AS r, id FROM symbols) WHERE r <= 8", structure.top_symbols)
over_graph("o117_token_budget", f"SELECT * FROM (SELECT file_path, {module('file_path')} AS module, CAST(ceil(byte_size / 400) AS BIGINT) AS tokens, CAST(sum(CAST(ceil(byte_size / 400) AS BIGINT)) OVER (PARTITION BY {module('file_path')} ORDER BY file_path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM files) WHERE running <= 600", structure.token_budget, 600)

# --- traversal -------------------------------------------------------------------------------------------------------
over_graph("o064_cycles", """
, e AS (SELECT source_id AS x, target_id AS y FROM imports WHERE source_id <> target_id), p2 AS (SELECT [x, y] AS p FROM e WHERE y > x),
p3 AS (SELECT list_append(p, y) AS p FROM p2 JOIN e ON p[-1] = x WHERE y > p[1] AND NOT list_contains(p, y)), p4 AS (SELECT list_append(p, y) AS p FROM p3 JOIN e ON p[-1] = x WHERE y > p[1] AND NOT list_contains(p, y))
SELECT array_to_string(p, ' > ') AS cycle, CAST(len(p) AS INTEGER) AS length FROM (SELECT p FROM p2 UNION ALL SELECT p FROM p3 UNION ALL SELECT p FROM p4) q JOIN e ON p[-1] = x AND p[1] = y""", traverse.cycles)
over_graph("o065_layers", None, traverse.layers)
_STARTS = "SELECT file_path AS root FROM files"
_RECURSIVE = GRAPH.replace("WITH s0", "WITH RECURSIVE s0", 1)
over_graph("o064_components", None, components.import_components)
_MUTUAL = """, reach(a, b) AS (SELECT source_id, target_id FROM imports WHERE source_id <> target_id UNION SELECT a, i.target_id FROM reach JOIN imports i ON i.source_id = b WHERE i.source_id <> i.target_id),
ends AS (SELECT source_id AS node FROM imports UNION SELECT target_id FROM imports),
parts AS (SELECT node, least(node, coalesce(min(x.b), node)) AS component FROM ends LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) x ON x.a = node GROUP BY node)"""
ORACLE_SQL["o064_components"] = _RECURSIVE + _MUTUAL + """
SELECT component, count(*) AS size, string_agg(node, ' ' ORDER BY node) AS members FROM parts GROUP BY component HAVING count(*) > 1"""
over_graph("o065_condensed_layers", None, components.condensed_layers)
ORACLE_SQL["o065_condensed_layers"] = _RECURSIVE + _MUTUAL + """, e AS (SELECT DISTINCT x.component AS a, y.component AS b FROM imports JOIN parts x ON x.node = source_id JOIN parts y ON y.node = target_id WHERE x.component <> y.component),
up(component, n) AS (SELECT DISTINCT component, 0 FROM parts UNION SELECT a, n + 1 FROM up JOIN e ON b = component)
SELECT node AS file_path, component, layer FROM parts JOIN (SELECT component, max(n) AS layer FROM up GROUP BY 1) USING (component)"""
over_graph("o069q_longest_chain", None, components.longest_chain)
ORACLE_SQL["o069q_longest_chain"] = _RECURSIVE + f""", e AS (SELECT source_id AS a, target_id AS b FROM imports WHERE source_id <> target_id AND source_id IN (SELECT file_path FROM files) AND target_id IN (SELECT file_path FROM files)
    AND NOT {is_test('source_id')} AND NOT {is_test('target_id')}),
walk(p) AS (SELECT [a, b] FROM e UNION SELECT list_append(p, b) FROM walk JOIN e ON a = p[-1] WHERE len(p) < 12 AND NOT list_contains(p, b))
SELECT array_to_string(min(p), ' > ') AS chain, CAST(len(p) AS INTEGER) AS length FROM walk WHERE len(p) = (SELECT max(len(p)) FROM walk) AND len(p) >= 5 GROUP BY len(p)"""
over_graph("o069d_cascade", None, traverse.cascade)
ORACLE_SQL["o069d_cascade"] = _RECURSIVE + f""", reach(root, node, hops) AS (
    SELECT root, root, 0 FROM ({_STARTS}) UNION SELECT root, i.source_id, hops + 1 FROM reach JOIN imports i ON i.target_id = node WHERE hops < 5)
SELECT root, hops, count(*) AS files FROM (SELECT root, node, min(hops) AS hops FROM reach GROUP BY 1, 2) WHERE hops > 0 GROUP BY 1, 2"""
over_graph("o069e_upstream", None, traverse.upstream)
ORACLE_SQL["o069e_upstream"] = _RECURSIVE + f""", c AS (SELECT source_id, target_id FROM calls WHERE NOT {is_test('source_file')} AND source_id <> target_id), reach(root, node, hops) AS (
    SELECT id, id, 0 FROM symbols UNION SELECT root, c.source_id, hops + 1 FROM reach JOIN c ON c.target_id = node WHERE hops < 4)
SELECT *, direct <= 8 AND reach >= 20 AND reach >= 4 * direct AS shown FROM (SELECT root, count(*) FILTER (hops = 1) AS direct, least(count(*), 200) AS reach, count(*) >= 200 AS capped
    FROM (SELECT root, node, min(hops) AS hops FROM reach GROUP BY 1, 2) WHERE hops > 0 GROUP BY 1)"""
over_graph("o069f_apex", None, lambda g: traverse.apex(g).drop("path"))
ORACLE_SQL["o069f_apex"] = _RECURSIVE + f""", c AS (SELECT source_id, target_id FROM calls WHERE NOT {is_test('source_file')}),
few AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY source_id) <= 8), reach(root, node, hops) AS (
    SELECT id, id, 0 FROM symbols UNION SELECT root, few.source_id, hops + 1 FROM reach JOIN few ON few.target_id = node WHERE hops < 5),
tops AS (SELECT root, min(node) AS apex, hops FROM (SELECT * FROM reach WHERE node NOT IN (SELECT target_id FROM c) QUALIFY hops = min(hops) OVER (PARTITION BY root)) GROUP BY root, hops),
real AS (SELECT id, id IN (SELECT target_id FROM c) AS really, id IN (SELECT target_id FROM calls) AS called FROM symbols WHERE kind IN ('function', 'method'))
SELECT r.id AS root, hops, apex, 'apex: ' || CASE WHEN NOT called THEN 'self [entry]' WHEN hops IS NULL THEN '5+ hops' ELSE a.name || ' [' || hops || CASE WHEN hops = 1 THEN ' hop]' ELSE ' hops]' END END AS line
FROM real r LEFT JOIN tops ON root = r.id LEFT JOIN symbols a ON a.id = apex WHERE really OR NOT called"""
over_graph("o069l_orphan_cascade", f"""
, sole AS (SELECT c.target_id AS id, s.name, c.target_file, min(source_id) AS owner FROM calls c JOIN symbols s ON s.id = c.target_id WHERE s.kind IN ('function', 'method') AND NOT {is_test('source_file')} GROUP BY 1, 2, 3 HAVING count(*) = 1),
own AS (SELECT * FROM sole WHERE id <> owner), inner_ AS (SELECT owner AS id, count(*) AS n FROM own WHERE NOT {is_test('target_file')} GROUP BY 1)
SELECT owner AS root, CAST(count(*) + sum(n) AS BIGINT) AS helpers, CAST(sum(n) AS BIGINT) AS deeper, array_to_string(list_sort(list(DISTINCT name) FILTER (n > 0))[1:3], ', ') AS via
FROM own LEFT JOIN inner_ USING (id) GROUP BY owner HAVING sum(n) >= 2""", traverse.orphan_cascade)
ORACLE_SQL["o065_layers"] = _RECURSIVE + """, chain(file_path, n) AS (
    SELECT file_path, 0 FROM (SELECT source_id AS file_path FROM imports UNION SELECT target_id FROM imports) UNION SELECT source_id, n + 1 FROM chain JOIN imports ON target_id = file_path WHERE n < 200),
far AS (SELECT file_path, max(n) AS n FROM chain GROUP BY 1)
SELECT file_path, CASE WHEN n < 200 THEN n ELSE (SELECT coalesce(max(n), -1) + 1 FROM far WHERE n < 200) END AS layer FROM far"""
over_graph("o069g_call_triangles", f"""
, e AS (SELECT source_id, target_id FROM calls WHERE source_id <> target_id AND NOT {is_test('source_file')} AND NOT {is_test('target_file')})
SELECT x.source_id AS a, x.target_id AS b, y.target_id AS c FROM e x JOIN e y ON x.target_id = y.source_id JOIN e z ON y.target_id = z.source_id AND z.target_id = x.source_id WHERE x.target_id > x.source_id AND y.target_id > x.source_id AND y.target_id <> x.target_id""", traverse.call_triangles)
over_graph("o069h_recursion", "SELECT x.source_id AS a, x.target_id AS b FROM calls x WHERE x.source_id <= x.target_id AND EXISTS (SELECT 1 FROM calls y WHERE y.source_id = x.target_id AND y.target_id = x.source_id)", traverse.mutual_recursion)
over_graph("o069l_sole_use", f"SELECT s.id, caller FROM symbols s JOIN (SELECT target_id, count(*) AS n, min(source_id) AS caller FROM calls WHERE NOT {is_test('source_file')} GROUP BY 1) c ON s.id = c.target_id WHERE n = 1 AND s.kind IN ('function', 'method')", traverse.sole_use)
over_graph("o069m_brokers", f"""
SELECT * FROM (SELECT *, CASE WHEN callers >= 5 AND callees >= 5 THEN 'broker' WHEN callees >= 6 AND callers BETWEEN 1 AND 4 THEN 'orchestrator' END AS role FROM (
    SELECT coalesce(u.id, d.id) AS id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM
    (SELECT target_id AS id, count(*) AS callers FROM calls WHERE source_file <> target_file AND NOT {is_test('source_file')} GROUP BY 1) u FULL JOIN
    (SELECT source_id AS id, count(*) AS callees FROM calls WHERE source_file <> target_file AND NOT {is_test('target_file')} GROUP BY 1) d ON u.id = d.id)) WHERE role IS NOT NULL""", traverse.brokers)
over_graph("o069o_hub_callees", f"SELECT target_id AS id, count(DISTINCT source_file) AS files FROM calls WHERE source_file <> target_file AND NOT {is_test('source_file')} GROUP BY 1 HAVING count(DISTINCT source_file) >= 3", traverse.hub_callees)
over_graph("o069p_inheritance_depth", None, traverse.inheritance_depth)
ORACLE_SQL["o069p_inheritance_depth"] = GRAPH.replace("WITH s0", "WITH RECURSIVE s0", 1) + """, i AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'inherits'), up(id, base, depth) AS (
    SELECT source_id, target_id, 1 FROM i UNION SELECT id, i.target_id, depth + 1 FROM up JOIN i ON base = i.source_id WHERE depth < 60) SELECT id, max(depth) AS depth FROM up GROUP BY id"""
over_graph("o069_focus", None, lambda g: focus.focus(g, search.search(g, PHRASE).limit(3).select("id"), hot=history.recent_files(g)))
over_graph("o069c_adaptive_focus", None, lambda g: focus.focus(g, search.search(g, PHRASE).limit(3).select("id"), None))
over_graph("o069c_multi_focus", None, lambda g: focus.focus(g, focus.multi_seeds(g, QUESTIONS), None, history.recent_files(g)))


@query("o069c_module_focus")
def _module_focus(s, d):
    """The focus of each module, about its three most important symbols."""
    g = graph(s, d)
    hot = history.recent_files(g)
    best = Window.partitionBy("module").orderBy(F.desc("importance"), "id")
    top = g.symbols.select("id", "module").join(advice.importance(g, hot).select("id", "importance"), "id").withColumn("place", F.row_number().over(best)).where("place <= 3")
    return focus.focus_each(g, top.select(F.col("module").alias("label"), "id", "place"), None, hot)


# --- telemetry -------------------------------------------------------------------------------------------------------
over_usage("o110_sessions", "SELECT event_id, session FROM sessions", lambda u: telemetry.sessions(u).select("event_id", "session"))
over_usage("o111_session_summary", """
, f AS (SELECT session, string_agg(mode, ',' ORDER BY t, e) AS modes FROM (SELECT session, mode, min(ts) AS t, min(event_id) AS e FROM sessions GROUP BY 1, 2) GROUP BY 1)
SELECT s.session, count(*) AS events, sum(tokens) AS tokens, count(*) FILTER (empty) AS empties, any_value(modes) AS modes, count(*) FILTER (empty) < 0.5 * count(*) AS success,
    substr(md5(string_agg(CAST(epoch_us(ts) AS VARCHAR), '|' ORDER BY ts, event_id)), 1, 8) AS hash
FROM sessions s JOIN f ON s.session = f.session GROUP BY s.session""", telemetry.session_summary)
# A mode for each kind of event, so that sessions have tasks.
MODES = {"view": "overview", "signup": "symbols", "click": "focus", "error": "dead", "purchase": "stats"}


def _session_tasks(u: DataFrame) -> DataFrame:
    """Users share five logs, so that these have sessions of several events; feedback is what purchases and errors say."""
    u = u.withColumn("repo", F.expr("repo % 5"))
    return tasks.session_tasks(u.withColumn("mode", F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])[F.col("mode")]), telemetry.feedback(u)).drop("session")


over_usage("o111_session_tasks", """
, m AS (SELECT * REPLACE (repo % 5 AS repo), CASE mode WHEN 'view' THEN 'overview' WHEN 'signup' THEN 'symbols' WHEN 'click' THEN 'focus' WHEN 'error' THEN 'dead' ELSE 'stats' END AS how,
    CASE mode WHEN 'view' THEN 'orientation' WHEN 'signup' THEN 'code_navigation' WHEN 'click' THEN 'code_navigation' WHEN 'error' THEN 'cleanup' END AS task FROM usage),
o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY repo ORDER BY ts, event_id) <= 1200000000 THEN 0 ELSE 1 END AS opens_ FROM m),
s AS (SELECT *, sum(opens_) OVER (PARTITION BY repo ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o),
g AS (SELECT repo, session, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS events, sum(tokens) AS tokens, count(*) FILTER (empty) AS empties,
    substr(md5(string_agg(CAST(epoch_us(ts) AS VARCHAR), '|' ORDER BY ts, event_id)), 1, 8) AS session_hash FROM s GROUP BY 1, 2 HAVING count(*) <= 30),
c AS (SELECT repo, session, string_agg(how, ',' ORDER BY t, e) AS context_modes FROM (SELECT repo, session, how, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM s WHERE how <> 'stats' GROUP BY 1, 2, 3) GROUP BY 1, 2),
k AS (SELECT repo, session, arg_min(task, (-n, t, e)) AS task_type FROM (SELECT repo, session, task, count(*) AS n, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM s WHERE task IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT g.repo, g.session, bool_or(u.mode = 'purchase') AS helpful FROM g JOIN usage u ON u.repo % 5 = g.repo AND u.mode IN ('purchase', 'error') AND abs(epoch_us(u.ts) - g.end_us) <= 3600000000 GROUP BY 1, 2)
SELECT g.repo, start_us, end_us, events, tokens, empties, context_modes, task_type, coalesce(helpful, empties < 0.5 * events) AS success, session_hash
FROM g JOIN c USING (repo, session) LEFT JOIN k USING (repo, session) LEFT JOIN b USING (repo, session)""", _session_tasks)
over_usage("o112_markov1", "SELECT * FROM markov1", telemetry.markov1)
over_usage("o113_markov2", "SELECT * FROM markov2", telemetry.markov2)
over_usage("o114_predict", """
, m AS (SELECT first, second, next, n, p, 2 AS "order" FROM markov2 WHERE p >= 0.2), f AS (SELECT a.mode AS first, b.state AS second, b.next, b.n, b.p, 1 AS "order" FROM (SELECT DISTINCT mode, m1 FROM seqs WHERE m1 <> mode) a JOIN markov1 b ON a.m1 = b.state
    WHERE b.p >= 0.2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.first = a.mode AND m.second = b.state))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY p DESC, next) AS rank FROM (SELECT * FROM m UNION ALL SELECT * FROM f)) WHERE rank <= 3""", telemetry.predict)
over_usage("o100_report", "SELECT mode, count(*) AS uses, round(avg(tokens), 6) AS avg_tokens, round(100.0 * count(*) FILTER (empty) / count(*), 6) AS empty_pct, count(DISTINCT repo) AS repos FROM usage GROUP BY mode", telemetry.report)
over_usage("o101_token_stats", """
SELECT mode, total, n, useful, wasted, CAST(CASE WHEN c < 3 THEN 4000 ELSE greatest(500, least(8000, floor(floor(1.2 * useful) / greatest(c, 1)))) END AS BIGINT) AS budget FROM (
    SELECT mode, sum(tokens) AS total, count(*) AS n, sum(CASE WHEN NOT empty THEN tokens ELSE 0 END) AS useful, sum(CASE WHEN empty THEN tokens ELSE 0 END) AS wasted, count(*) FILTER (NOT empty) AS c FROM usage GROUP BY mode)""", telemetry.token_stats)
over_usage("o103_effectiveness", """
SELECT coalesce(r.repo, t.repo) AS repo, r.n, r.rate, t.avg_tokens FROM (SELECT repo, count(*) AS n, round(count(*) FILTER (mode = 'purchase') / count(*), 6) AS rate FROM usage WHERE mode IN ('purchase', 'error') GROUP BY 1 HAVING count(*) >= 3) r
FULL JOIN (SELECT repo, round(avg(tokens), 6) AS avg_tokens FROM usage GROUP BY 1) t ON r.repo = t.repo""", telemetry.effectiveness)
# own: what a user's own log holds; every seventh user works in a scratch folder, every eleventh below /tmp
_LOGS = """
WITH every AS (SELECT event_id, ts, CASE WHEN user_id % 7 = 0 THEN 'tmp' ELSE 'repo' END || user_id AS repo, CASE WHEN user_id % 11 = 0 THEN '/tmp/' ELSE '/src/' END || user_id AS repo_path,
    CASE event_type WHEN 'view' THEN 'overview' WHEN 'signup' THEN 'stats' WHEN 'click' THEN 'focus' WHEN 'error' THEN 'dead' ELSE 'prepare' END AS mode,
    CASE WHEN event_id % 5 > 0 THEN CAST(trunc(value) AS INTEGER) END AS tokens, event_type = 'error' AS empty, CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS duration_ms, event_type, value FROM events),
own AS (FROM every WHERE event_id % 4 = 0), shared AS (SELECT * REPLACE (CASE WHEN event_id % 8 = 0 THEN 'copy' ELSE repo END AS repo) FROM every WHERE event_id % 4 IN (0, 1, 2)),
merged AS (FROM own UNION ALL FROM shared WHERE ts NOT IN (SELECT ts FROM own)),
said AS (SELECT ts, repo, repo_path, mode, value > 30 AS helpful, CASE WHEN event_id % 3 = 0 THEN repeat('note ' || event_id || ' ', 12) END AS note FROM merged WHERE event_type IN ('purchase', 'click', 'error'))"""
_REAL = "NOT (starts_with(repo, 'tmp') AND length(repo) < 20) AND NOT contains(repo_path, '/tmp/') AND NOT contains(repo_path, 'pytest')"


def _logs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A usage log merged of an own and a shared one, and the feedback in it."""
    user, i = F.col("user_id"), F.col("event_id")
    modes = F.create_map(*[F.lit(x) for kv in {"view": "overview", "signup": "stats", "click": "focus", "error": "dead"}.items() for x in kv])
    every = table(s, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.when(user % 7 == 0, "tmp").otherwise("repo"), user.cast("string")).alias("repo"),
        F.concat(F.when(user % 11 == 0, "/tmp/").otherwise("/src/"), user.cast("string")).alias("repo_path"), F.coalesce(modes[F.col("event_type")], F.lit("prepare")).alias("mode"),
        F.when(i % 5 > 0, F.col("value").cast("int")).alias("tokens"), (F.col("event_type") == "error").alias("empty"), F.when(i % 3 == 0, F.regexp_extract("props", "[0-9]+", 0).cast("int")).alias("duration_ms"), "event_type", "value",
    )
    shared = every.where(i % 4 < 3).withColumn("repo", F.when(i % 8 == 0, "copy").otherwise(F.col("repo")))
    log = reports.merged(every.where(i % 4 == 0), shared)
    note = F.when(i % 3 == 0, F.repeat(F.concat(F.lit("note "), i.cast("string"), F.lit(" ")), F.lit(12)))
    return log, log.where(F.col("event_type").isin("purchase", "click", "error")).select("ts", "repo", "repo_path", "mode", (F.col("value") > 30).alias("helpful"), note.alias("note"))


query("o100_usage_report", _LOGS + f""", u AS (FROM merged WHERE {_REAL}), f AS (FROM said WHERE {_REAL}),
n5 AS (SELECT *, row_number() OVER (ORDER BY ts DESC, item DESC) AS r FROM (SELECT ts, CASE WHEN helpful THEN '[+] ' ELSE '[-] ' END || mode || ': ' || substr(note, 1, 100) AS item FROM f WHERE note <> '') QUALIFY r <= 5)
SELECT 'repo' AS section, repo AS item, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM u GROUP BY repo UNION ALL SELECT 'total', '', count(*) FILTER (mode <> 'stats'), count(*) FILTER (mode = 'stats') FROM u HAVING count(*) > 0
UNION ALL SELECT 'mode', mode, count(*), floor(avg(tokens)) FROM u WHERE mode <> 'stats' GROUP BY mode
UNION ALL SELECT 'empty', mode, count(*) FILTER (empty), round(100 * count(*) FILTER (empty) / count(*), 6) FROM u WHERE mode <> 'stats' GROUP BY mode HAVING bool_or(empty)
UNION ALL SELECT 'duration', '', max(duration_ms), floor(avg(duration_ms)) FROM u HAVING count(duration_ms) > 0
UNION ALL SELECT 'feedback', CASE WHEN helpful THEN 'helpful' ELSE 'unhelpful' END, count(*), NULL FROM f GROUP BY helpful UNION ALL SELECT 'unhelpful', mode, count(*), NULL FROM f WHERE NOT helpful GROUP BY mode
UNION ALL SELECT 'note', item, (SELECT count(*) FROM n5) + 1 - r, NULL FROM n5""")(lambda s, d: reports.usage_report(*map(reports.real, _logs(s, d))))
query("o103_mode_effectiveness", _LOGS + """, u AS (FROM merged WHERE mode <> 'stats' AND NOT contains(repo_path, '/tmp/')),
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 1200000000 THEN 0 ELSE 1 END AS opens FROM u), x AS (SELECT *, sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
r AS (SELECT repo_path, count(*) AS n FROM (SELECT session, arg_min(repo_path, (ts, event_id)) AS repo_path FROM x GROUP BY session) GROUP BY repo_path)
SELECT * FROM (SELECT 'mode' AS section, mode AS item, n, rate, coalesce(t, 0) AS avg_tokens FROM (SELECT mode, count(*) AS n, round(count(*) FILTER (helpful) / count(*), 6) AS rate FROM said WHERE NOT contains(repo_path, '/tmp/') GROUP BY mode HAVING count(*) >= 3)
    LEFT JOIN (SELECT mode, CAST(floor(avg(tokens)) AS BIGINT) AS t FROM u WHERE tokens <> 0 GROUP BY mode) USING (mode)
UNION ALL FROM (SELECT 'repo', repo_path, n, NULL, NULL FROM r ORDER BY n DESC, repo_path LIMIT 5)) WHERE (SELECT sum(n) FROM r) >= 10""")(lambda s, d: reports.mode_effectiveness(*_logs(s, d)))
over_usage("o049b_near_session_end", """
SELECT e.session, count(*) AS n FROM (SELECT session, max(ts) AS e FROM sessions GROUP BY 1) e JOIN usage f ON f.mode IN ('purchase', 'error') AND abs(epoch_us(f.ts) - epoch_us(e.e)) <= 3600000000 GROUP BY 1""", telemetry.near_session_end)
over_usage("o133_windows", "SELECT CAST(floor(epoch_us(ts) / 604800000000) * 604800000000 AS BIGINT) AS start_us, mode, count(*) AS n, sum(tokens) AS tokens FROM usage GROUP BY 1, 2", telemetry.windows)
over_usage("o118_tail", "SELECT event_id, mode, tokens FROM usage ORDER BY ts DESC, event_id DESC LIMIT 50", telemetry.tail)

# --- resolution ------------------------------------------------------------------------------------------------------
query("o041_name_resolution", GRAPH + """
, u AS (SELECT DISTINCT source_id, split_part(source_id, '::', 1) AS f, regexp_replace(t.name, '_[0-9]+$', '') AS target, e.line FROM edges e JOIN symbols t ON e.target_id = t.id WHERE e.kind = 'calls'),
c AS (SELECT id, file_path, exported, regexp_replace(name, '_[0-9]+$', '') AS name FROM symbols),
r AS (SELECT u.source_id, u.target, u.line, c.id, row_number() OVER (PARTITION BY u.source_id, u.target, u.line ORDER BY
    CASE WHEN c.file_path = u.f THEN 0 WHEN EXISTS (SELECT 1 FROM imports i WHERE i.source_id = u.f AND i.target_id = c.file_path) THEN 3 WHEN c.exported THEN 4 ELSE 5 END, c.id) AS k
    FROM u JOIN c ON u.target = c.name)
SELECT DISTINCT source_id, id AS target_id, line FROM r WHERE k = 1""")(
    lambda s, d: (lambda g: resolve.resolve_names(
        resolve.unresolved(g),
        g.symbols.withColumn("name", F.regexp_replace("name", r"_\d+$", "")).withColumn("qualified_name", F.col("name")),
        g.imports.select(F.col("source_id").alias("file_path"), F.col("target_id").alias("target")),
        s.createDataFrame([], "file_path string, name string"),
    ).select("source_id", "target_id", "line").distinct())(graph(s, d))
)

_MEMBERS = GRAPH + """
, m AS (SELECT CASE WHEN parent_id IS NOT NULL THEN parent_id || '.' || short ELSE id END AS id, short AS name, CASE WHEN parent_id IS NOT NULL THEN split_part(parent_id, '::', 2) || '.' || short ELSE split_part(id, '::', 2) END AS qn,
    kind, file_path AS f, exported, parent_id, lead(short) OVER (PARTITION BY module, parent_id IS NULL ORDER BY seq) AS next FROM (SELECT *, regexp_replace(name, '_[0-9]+$', '') AS short FROM symbols)),
lk AS (SELECT DISTINCT name AS n, id, f, exported FROM m UNION SELECT qn, id, f, exported FROM m WHERE qn <> name),
w AS (SELECT DISTINCT id AS source_id, f, parent_id AS cls, split_part(parent_id, '::', 2) AS c, next AS b FROM m WHERE parent_id IS NOT NULL AND next IS NOT NULL),
inh AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'inherits'),
kin AS (SELECT source_id AS cls, target_id AS kin, 3 AS v FROM inh UNION SELECT target_id, source_id, 4 FROM inh UNION SELECT a.target_id, b.target_id, 5 FROM inh a JOIN inh b ON a.source_id = b.source_id AND a.target_id <> b.target_id UNION SELECT cls, cls, 1 FROM w),
imported AS (SELECT DISTINCT source_id AS f, target_id AS g FROM imports)
"""
_BEST = """
SELECT source_id, target AS target_id, coalesce(arg_min(id, (v, kin, how, pref, id)) FILTER (id IS NOT NULL), target) AS id FROM (
    SELECT x.*, CASE WHEN l.f = x.f THEN 0 WHEN i.g IS NOT NULL THEN 3 WHEN l.exported THEN 4 ELSE 5 END AS pref FROM found x LEFT JOIN lk l ON l.id = x.id AND l.n = x.n LEFT JOIN imported i ON i.f = x.f AND i.g = l.f) GROUP BY source_id, target"""
query("o042_self_calls", _MEMBERS + """
, found AS (SELECT source_id, w.f, 'self.' || b AS target, v, kin, 0 AS how, id, qn AS n FROM w JOIN kin USING (cls) JOIN m ON m.id = kin || '.' || b
    UNION ALL SELECT source_id, w.f, 'self.' || b, CASE v WHEN 1 THEN 2 ELSE v END, kin, 1, id, n FROM w JOIN kin USING (cls) JOIN lk ON n = split_part(kin, '::', 2) || '.' || b
    UNION ALL SELECT source_id, w.f, 'self.' || b, 6, '', 0, id, n FROM w JOIN lk ON n = b AND lk.f = w.f
    UNION ALL SELECT source_id, f, 'self.' || b, 9, '', 0, NULL, NULL FROM w)""" + _BEST)(lambda s, d: resolve.resolved_members(graph(s, d), True))
query("o043_type_methods", _MEMBERS + """
, found AS (SELECT source_id, w.f, c || '.' || b AS target, 0 AS v, '' AS kin, 0 AS how, id, n FROM w JOIN lk ON n = c || '.' || b
    UNION ALL SELECT source_id, w.f, c || '.' || b, 7, '', 0, id, n FROM w JOIN lk ON n = b WHERE c IN (SELECT n FROM lk JOIN m USING (id) WHERE kind = 'class')
    UNION ALL SELECT source_id, f, c || '.' || b, 9, '', 0, NULL, NULL FROM w)""" + _BEST)(lambda s, d: resolve.resolved_members(graph(s, d), False))

# --- rules -----------------------------------------------------------------------------------------------------------
from ..rules.catalogue import RULES  # noqa: E402
from ..rules.evaluate import fired, subject  # noqa: E402
from ..rules.features import CALLERS, OF_CHANGED  # noqa: E402
from ..rules.totals import CODE_LANGUAGES, PATHS, among  # noqa: E402
from ..rules.totals import SQL as _TOTALS  # noqa: E402

_FEATURES = _HOT.rstrip() + f"""
, f_symbol AS (SELECT s.id, s.name, lower(s.name) AS low, s.kind, s.file_path, s.lines, s.complexity, s.exported, s.doc, s.signature, s.parent_id, s.byte_size, {is_test('s.file_path')} AS is_test, {among('s.language', CODE_LANGUAGES)} AS code,
    coalesce(u.src_files, 0) AS src_files, coalesce(m.methods, 0) AS methods, coalesce(m.member_fns, 0) AS member_fns, coalesce(gp.n, 0) AS grandparents,
    coalesce(u.callers, 0) AS callers, coalesce(u.test_callers, 0) AS test_callers, coalesce(u.cross_files, 0) AS cross_files, coalesce(d.n, 0) AS callees, coalesce(k.n, 0) AS children, coalesce(b.n, 0) AS subtypes, coalesce(r.n, 0) AS renderers, coalesce(fi.n, 0) AS file_importers, c.confidence
  FROM symbols s LEFT JOIN (SELECT target_id, count(*) AS callers, count(*) FILTER ({is_test('source_file')}) AS test_callers, count(DISTINCT CASE WHEN source_file <> target_file THEN source_file END) AS cross_files, count(DISTINCT CASE WHEN source_file <> target_file AND NOT {is_test('source_file')} THEN source_file END) AS src_files FROM calls GROUP BY 1) u ON s.id = u.target_id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM calls GROUP BY 1) d ON s.id = d.source_id LEFT JOIN (SELECT source_id, count(*) AS n FROM edges WHERE kind = 'contains' GROUP BY 1) k ON s.id = k.source_id
  LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges WHERE kind = 'inherits' GROUP BY 1) b ON s.id = b.target_id LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges WHERE kind = 'renders' GROUP BY 1) r ON s.id = r.target_id
  LEFT JOIN confidence c ON s.id = c.id LEFT JOIN (SELECT target_id, count(*) AS n FROM imports GROUP BY 1) fi ON s.file_path = fi.target_id
  LEFT JOIN (SELECT parent_id, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (kind IN ('function', 'method')) AS member_fns FROM symbols WHERE parent_id IS NOT NULL GROUP BY 1) m ON s.id = m.parent_id
  LEFT JOIN (SELECT a.source_id, count(*) AS n FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'inherits') a JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'inherits') b ON a.target_id = b.source_id GROUP BY 1) gp ON s.id = gp.source_id),
f_file AS (SELECT f.*, {module('f.file_path')} AS module, {among('f.language', CODE_LANGUAGES)} AS code, length(f.file_path) - length(replace(f.file_path, '/', '')) AS depth, regexp_replace(f.file_path, '/?[^/]*$', '') AS folder, coalesce(x.n, 0) AS outside_importers, coalesce(o.s, 0) AS src_imports, lower(split_part(f.file_path, '/', -1)) AS base, regexp_replace(lower(split_part(f.file_path, '/', -1)), '[.][^.]*$', '') AS stem, {is_test('f.file_path')} AS is_test, coalesce(i.n, 0) AS importers, coalesce(i.t, 0) AS test_importers, coalesce(o.n, 0) AS imports, coalesce(h.commits, 0) AS commits, CASE WHEN h.days <= 730 THEN h.days END AS days
  FROM (SELECT file_path, count(*) AS symbols, count(*) FILTER (exported) AS exported, count(*) FILTER (exported AND kind IN ('function', 'method')) AS exported_fns, count(*) FILTER (exported AND kind IN ('function', 'method', 'class', 'interface')) AS exported_api, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'constant') AS constants, count(*) FILTER (kind IN ('function', 'method')) AS functions, max(complexity) AS max_cx, max(line_end) AS lines,
    CAST(sum(complexity) AS BIGINT) AS cx, min(language) AS language, count(*) FILTER (starts_with(name, 'test_')) AS test_named, count(*) FILTER (starts_with(lower(name), 'test_')) AS low_test_named, count(*) FILTER (kind IN ('function', 'method', 'class')) AS definitions,
    count(*) FILTER (kind IN ('function', 'method', 'class', 'constant')) AS interface, count(*) FILTER (exported AND kind IN ('function', 'method', 'class', 'constant')) AS interface_exported,
    count(*) FILTER (kind IN ('constant', 'variable')) AS consts, count(*) FILTER (parent_id IS NULL AND NOT starts_with(name, '_')) AS public_top,
    count(*) FILTER (parent_id IS NULL AND kind NOT IN ('constant', 'variable', 'unknown', 'module')) AS top_others, count(*) FILTER (parent_id IS NULL) AS top_symbols, count(*) FILTER (parent_id IS NULL AND kind = 'function') AS top_functions FROM symbols GROUP BY 1) f
  LEFT JOIN (SELECT target_id, count(*) AS n, count(*) FILTER ({is_test('source_id')}) AS t FROM imports GROUP BY 1) i ON f.file_path = i.target_id LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (NOT {is_test('target_id')}) AS s FROM imports GROUP BY 1) o ON f.file_path = o.source_id
  LEFT JOIN (SELECT target_id, count(*) AS n FROM imports WHERE {module('source_id')} <> {module('target_id')} GROUP BY 1) x ON f.file_path = x.target_id
  LEFT JOIN (SELECT path, count(DISTINCT commit_id) AS commits, DATE '2001-08-02' - max(day) AS days FROM commit_files GROUP BY 1) h ON f.file_path = h.path),
f_diff AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in PATHS.items())}, {is_test('file_path')} AS is_test FROM (
    SELECT p.path AS file_path, f.file_path IS NOT NULL AS known, {', '.join(f'coalesce(f.{c}, 0) AS {c}' for c in OF_CHANGED)} FROM (SELECT DISTINCT path FROM {_CHANGED}) p LEFT JOIN f_file f ON p.path = f.file_path)),
f_touched AS (SELECT s.*, coalesce(c.n, 0) AS far_files FROM f_symbol s LEFT JOIN (SELECT target_id, count(DISTINCT source_file) AS n FROM calls WHERE source_file NOT IN {_CHANGED} GROUP BY 1) c ON s.id = c.target_id WHERE s.file_path IN {_CHANGED}),
f_user AS (SELECT DISTINCT source_file AS file_path FROM calls WHERE NOT {is_test('target_file')} AND target_file IN {_CHANGED} AND source_file NOT IN {_CHANGED}),
f_leader AS (SELECT * FROM f_symbol WHERE id IN (SELECT id FROM hot WHERE score > 0 ORDER BY score DESC, id LIMIT 5)),
f_top AS (SELECT s.*, f.base, f.stem, f.symbols AS file_symbols, f.functions AS file_functions, {', '.join(f'coalesce(c.{n}, 0) AS {n}' for n in CALLERS)} FROM f_symbol s JOIN f_file f ON s.file_path = f.file_path
  LEFT JOIN (SELECT target_id, {', '.join(f'{e} AS {n}' for n, e in CALLERS.items())} FROM (SELECT *, regexp_replace(source_file, '/?[^/]*$', '') AS source_folder, regexp_replace(target_file, '/?[^/]*$', '') AS target_folder, {is_test('source_file')} AS is_test FROM calls) GROUP BY 1) c ON s.id = c.target_id
  WHERE s.id = (SELECT id FROM hot WHERE score > 0 ORDER BY score DESC, id LIMIT 1)),
f_mutual AS (SELECT a.source_id AS file_path, a.target_id AS partner FROM imports a JOIN imports b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id <> a.target_id AND NOT {is_test('a.source_id')} AND NOT {is_test('a.target_id')}),
""" + _TOTALS
_FIRED = " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, count(*) AS n, min({subject(r.scope)}) AS sample FROM f_{r.scope} WHERE {r.condition} HAVING count(*) >= {r.least}" for r in RULES
)
over_graph("signals", _FEATURES + _FIRED, fired, NOW)

# --- text and tools --------------------------------------------------------------------------------------------------
from ..functions import text as texts  # noqa: E402
from . import tools  # noqa: E402

query("o121_task_keywords")(
    lambda s, d: table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(texts.task_keywords(F.col("text")), ",").alias("keywords"))
)
query("o122_change_tasks", r"""SELECT conv_id, turn, regexp_matches(lower(text), 'merge pull request|^merge branch ''|^(fix|feat|refactor|chore|perf|style|build|ci|docs|test)(\(.+\))?:') OR regexp_matches(text, '\(#\d+\)\s*$|^\w.*#\d+') AS change FROM conversations""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", texts.is_change_task(F.col("text"), F.lit("")).alias("change"))
)
query("o092_blast_sections", GRAPH + f"""
, outside AS (SELECT * FROM calls WHERE target_file = {_F30} AND source_file <> {_F30}), imp AS (SELECT source_id AS item FROM imports WHERE target_id = {_F30})
SELECT 'importers' AS section, item, 1 AS n FROM imp UNION ALL SELECT 'callers', source_file, count(*) FROM outside GROUP BY 2 UNION ALL SELECT 'exports', target_id, count(DISTINCT source_file) FROM outside GROUP BY 2
UNION ALL SELECT 'tests', item, 1 FROM (SELECT item FROM imp UNION SELECT source_file FROM outside) WHERE {is_test('item')} UNION ALL SELECT 'imports', target_id, 1 FROM imports WHERE source_id = {_F30}""")(
    lambda s, d: (lambda g: tools.blast(g, _file(g, 30)))(graph(s, d))
)
over_graph("o095_diff_risk", f"""
SELECT p.path AS file_path, coalesce(s.symbols, 0) AS symbols, coalesce(s.exported, 0) AS exported, coalesce(c.n, 0) AS callers, coalesce(h.n, 0) AS churn, b.n AS blast, v.per_week AS active,
    CASE WHEN coalesce(c.n, 0) + 2 * coalesce(h.n, 0) >= 12 THEN 'HIGH' WHEN coalesce(c.n, 0) + 2 * coalesce(h.n, 0) >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT DISTINCT path FROM {_CHANGED}) p LEFT JOIN (SELECT file_path, count(*) AS symbols, count(*) FILTER (exported) AS exported FROM symbols GROUP BY 1) s ON p.path = s.file_path
LEFT JOIN (SELECT target_file, count(*) AS n FROM (SELECT DISTINCT target_file, target_id, source_file FROM calls WHERE source_file <> target_file) GROUP BY 1) c ON p.path = c.target_file
LEFT JOIN (SELECT path, count(DISTINCT commit_id) AS n FROM commit_files GROUP BY 1) h ON p.path = h.path LEFT JOIN (SELECT target_id, count(*) AS n FROM imports WHERE source_id <> target_id GROUP BY 1 HAVING count(*) >= 2) b ON p.path = b.target_id
LEFT JOIN (SELECT * FROM velocity WHERE per_week >= 2) v ON p.path = v.path""", lambda g: tools.diff(g, history.newest_change(g), NOW))
over_graph("o105_complexity", f"""
, f AS (SELECT * FROM symbols WHERE kind IN ('function', 'method') AND NOT {is_test('file_path')} AND complexity >= 1), b AS (SELECT file_path, sum(complexity) AS cx FROM symbols WHERE NOT {is_test('file_path')} AND complexity >= 1 GROUP BY 1)
SELECT count(*) AS n, round(avg(complexity), 6) AS mean, round(quantile_cont(complexity, 0.5), 6) AS median, round(quantile_cont(complexity, 0.9), 6) AS p90, max(complexity) AS most,
    round((SELECT sum(cx) FROM (SELECT cx FROM b ORDER BY cx DESC, file_path LIMIT 3)) / (SELECT sum(cx) FROM b), 6) AS top_share FROM f""", structure.complexity_distribution)
over_graph("o104_prepare_context", None, lambda g: tools.prepare(g, PHRASE, NOW))


@query("o049_changed_symbols_by_line", GRAPH + """
SELECT s.id, count(*) AS lines FROM symbols s JOIN (SELECT DISTINCT s.file_path, CAST(l_orderkey % 500 AS INTEGER) AS line FROM lineitem JOIN symbols s ON l_partkey = s.seq) c
ON s.file_path = c.file_path AND c.line BETWEEN s.line_start AND s.line_end GROUP BY s.id""")
def _by_line(s, d):
    from ..operators.ranges import changed_symbols

    g = graph(s, d)
    lines = table(s, d, "lineitem").join(g.symbols.select(F.col("seq").alias("l_partkey"), "file_path"), "l_partkey")
    return changed_symbols(g, lines.select(F.col("file_path").alias("path"), (F.col("l_orderkey") % 500).cast("int").alias("line")).distinct())
query("o120_change_keywords")(
    lambda s, d: (ship(s), table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(keywords_column(F.col("text")), ",").alias("keywords")))[1]
)
query("o015_export", GRAPH + "SELECT what, count(*) AS n FROM (SELECT 'file' AS what FROM files UNION ALL SELECT 'symbol' FROM symbols UNION ALL SELECT 'edge' FROM edges) GROUP BY what")(
    lambda s, d: export(graph(s, d)).groupBy("what").agg(F.count("*").alias("n"))
)
query("o017_folder_notes")(lambda s, d: folder_notes(graph(s, d)))

# --- advice ----------------------------------------------------------------------------------------------------------

_XC = "(SELECT target_id, count(*) AS c, count(DISTINCT source_file) AS f FROM calls WHERE source_file <> target_file GROUP BY 1)"
over_graph("o029_hot_sources", "SELECT file_path FROM files WHERE NOT contains(file_path, '/test_')", lambda g: g.files.where(advice.is_hot_source(F.col("file_path"))).select("file_path"))
over_graph("o031_module_of_file", f"SELECT file_path, {module('file_path')} AS module FROM files", lambda g: g.files.select("file_path", paths.module_of(F.col("file_path")).alias("module")))
query("o033_empty_results", "SELECT conv_id, turn, regexp_matches(text, '^(No symbols matching|File ''|No dead code|No results for|No external dependencies|No changed files|None of the changed files)') AS empty FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", paths.looks_empty(F.col("text")).alias("empty"))
)
over_graph("o047_commit_pairs", "SELECT a, b, together FROM pair_counts", lambda g: history.pair_counts(g).select("a", "b", "together"))
over_graph("o049c_test_stems", f"""
, f AS (SELECT file_path, regexp_replace(split_part(file_path, '/', -1), '[.][^.]*$', '') AS stem FROM (SELECT DISTINCT {_SHORT.format('file_path')} AS file_path FROM files))
SELECT f.file_path, t.file_path AS test FROM f JOIN f t ON contains(split_part(t.file_path, '/', -1), f.stem) WHERE NOT {is_test('f.file_path')} AND {is_test('t.file_path')}""", lambda g: advice.stem_matches(_short(g)))
@query("o054_hybrid_bonus", GRAPH + _SEARCH + f"""
, a AS (SELECT id, row_number() OVER ({_BY_SCORE}) AS ra FROM (SELECT * FROM hits {_BY_SCORE} LIMIT 40)),
b AS (SELECT s.id, row_number() OVER (ORDER BY distance, s.id) AS rb FROM ({_KNN.replace('LIMIT 20', 'LIMIT 40')}) k JOIN symbols s ON s.seq = k.vec_id),
f AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(1 / (60 + ra), 0) + coalesce(1 / (60 + rb), 0), 9) AS fused FROM a FULL JOIN b ON a.id = b.id)
SELECT f.id, round(fused * 100 + CASE WHEN exported THEN 2.0 ELSE 0 END + least(coalesce(c, 0), 5) * 0.5 + CASE WHEN kind IN ('component', 'hook') THEN 1.5 WHEN kind = 'class' THEN 1.0 ELSE 0 END, 6) AS score
FROM f JOIN symbols s ON f.id = s.id LEFT JOIN {_XC} x ON f.id = target_id ORDER BY score DESC, f.id LIMIT 50""")
def _hybrid(s, d):
    """Search hits and nearest vectors (vec_id is a symbol's number), fused by rank, with the structural bonus."""
    g = graph(s, d)
    words = search.search(g, PHRASE).limit(40)
    near = search.nearest(table(s, d, "embeddings"), _vector(s, d), 40).join(g.symbols.select("id", "seq"), F.col("vec_id") == F.col("seq"))
    fused = search.fuse(words, near, "id", [F.desc("score"), "file_path", "line_start", "id"], ["distance", "id"], 80)
    return advice.with_bonus(g, fused)


over_graph("o056_seeds", _SEARCH + f"""
, top AS (SELECT * FROM hits {_BY_SCORE} LIMIT 50), good AS (SELECT *, {is_test('file_path')} AS test FROM top WHERE score >= greatest(0.3 * (SELECT max(score) FROM top), 2.0))
SELECT id, score FROM good WHERE NOT test OR (SELECT bool_and(test) FROM good) {_BY_SCORE} LIMIT 10""", advice.seeds, PHRASE)
over_graph("o057_suggestions", None, advice.suggestions, PHRASE)
query("o058_orbit")(lambda s, d: (lambda g: advice.orbit(g, _file(g, 30), PHRASE))(graph(s, d)))
over_graph("o059_key_files", f"SELECT path, count(*) AS n, CASE WHEN {is_test('path')} THEN 1 ELSE 0 END AS tier FROM commit_files GROUP BY path ORDER BY tier, n DESC, path LIMIT 15",
    lambda g: advice.key_files_in(g.commit_files.select(F.concat(F.lit("see "), F.col("path"), F.lit(", changed")).alias("text"))))
# every second name ends in _old, and every third in _legacy, in place of its number
_AGED = "regexp_replace(name, '_[0-9]+$', CASE WHEN seq % 2 = 0 THEN '_old' WHEN seq % 3 = 0 THEN '_legacy' ELSE '' END)"


def _named(g, name: str) -> CodeGraph:
    return CodeGraph(g.symbols.withColumn("name", F.expr(name)), g.edges, g.commit_files)


over_graph("o063_superseded", f"""
, named AS (SELECT id, {_AGED} AS name, id IN (SELECT id FROM dead) AS gone FROM symbols)
SELECT d.id, l.id AS live_id FROM named d JOIN named l ON regexp_replace(d.name, '_(old|legacy)$', '') = l.name WHERE d.gone AND NOT l.gone AND regexp_matches(d.name, '_(old|legacy)$')""", lambda g: scoring.superseded(_named(g, _AGED)))
over_graph("o069a_importance", f"""
SELECT id, CAST(2 * coalesce(c, 0) + CASE WHEN exported THEN 1 ELSE 0 END + CASE WHEN file_path IN (SELECT path FROM commit_files WHERE commit_id IN {_LATEST}) THEN 2 ELSE 0 END AS BIGINT) AS importance, coalesce(f, 0) >= 10 AS utility
FROM symbols LEFT JOIN {_XC} x ON id = target_id""", lambda g: advice.importance(g, history.recent_files(g)))
over_graph("o069j_relay_points", """
, x AS (SELECT source_id, target_id FROM calls WHERE source_file <> target_file), r AS (SELECT source_id AS id, count(*) AS reach FROM x GROUP BY 1),
m AS (SELECT x.source_id AS id, x.target_id, coalesce(r.reach, 0) AS reach FROM x LEFT JOIN r ON x.target_id = r.id),
k AS (SELECT id, count(*) AS n, sum(reach) AS total, max(reach) AS best FROM m GROUP BY 1)
SELECT k.id, (SELECT min(target_id) FROM m WHERE m.id = k.id AND m.reach = k.best) AS via, best, total FROM k WHERE n >= 2 AND total >= 8 AND best >= 5 AND best >= 0.65 * total""", advice.relay_points)
over_graph("o069i_silent_members", f"""
SELECT s.id, s.parent_id FROM symbols s JOIN symbols p ON s.parent_id = p.id AND p.kind = 'class' WHERE s.id NOT IN (SELECT target_id FROM calls WHERE NOT {is_test('source_file')})
AND (p.complexity >= 5 OR p.id IN (SELECT target_id FROM calls WHERE source_file <> target_file AND NOT {is_test('source_file')}))""", advice.silent_members)
over_graph("o081_calm_zones", f"""
SELECT i.path, importers FROM (SELECT target_id AS path, count(*) AS importers FROM imports WHERE NOT {is_test('source_id')} GROUP BY 1 HAVING count(*) >= 2) i
LEFT JOIN (SELECT path, count(DISTINCT commit_id) * 7.0 / 14 AS w FROM commit_files WHERE day >= DATE '2001-08-02' - 14 GROUP BY 1) v ON i.path = v.path WHERE coalesce(w, 0) < 2 ORDER BY importers DESC, path LIMIT 4""", advice.calm_zones, NOW, 2)
over_graph("o082_badges", f"SELECT id, id IN (SELECT target_id FROM calls WHERE {is_test('source_file')}) AS tested, complexity >= 3 AND lines >= 5 AND complexity / lines >= 0.5 AS dense, complexity >= 20 AS complex FROM symbols WHERE kind IN ('function', 'method')", advice.badges)
over_graph("o087_recently_active", "SELECT path, count(DISTINCT commit_id) AS commits FROM commit_files WHERE NOT contains(path, '/test_') GROUP BY path ORDER BY commits DESC, path LIMIT 3", advice.recently_active)
_STARTING = "CASE WHEN seq % 50 = 1 THEN 'main' WHEN seq % 50 = 2 THEN 'serve' ELSE name END"
over_graph("o088_entry_points", f"SELECT id AS entry FROM symbols WHERE seq % 50 IN (1, 2) AND parent_id IS NULL AND NOT {is_test('file_path')} ORDER BY id LIMIT 15", lambda g: advice.entry_points(_named(g, _STARTING)))
over_graph("o093_symbol_blast", _SEARCH + f"""
SELECT id, (SELECT count(*) FROM calls WHERE target_id = id AND source_file <> target_file) AS outside, (SELECT count(*) FROM calls WHERE target_id = id AND source_file = target_file) AS local,
(SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'renders') WHERE target_id = id) AS renderers, (SELECT count(*) FROM edges WHERE kind = 'contains' AND source_id = id) AS children
FROM (SELECT * FROM hits {_BY_SCORE} LIMIT 5)""", advice.symbol_blast, PHRASE)
over_graph("o096_diff_dependents", f"""
, users AS (SELECT target_file, source_file FROM calls WHERE source_file <> target_file AND target_file IN {_CHANGED} UNION SELECT target_id, source_id FROM imports WHERE target_id IN {_CHANGED})
SELECT DISTINCT CASE WHEN {is_test('source_file')} THEN 'test' ELSE 'dependent' END AS section, source_file AS item FROM users WHERE source_file NOT IN {_CHANGED}
UNION ALL SELECT 'untested', path FROM {_CHANGED} c WHERE NOT {is_test('path')} AND path NOT IN (SELECT target_file FROM users WHERE {is_test('source_file')})""", lambda g: advice.diff_dependents(g, history.newest_change(g)))
_EVERY_CHANGE = f"""
, ch AS (SELECT DISTINCT commit_id AS change, file_path, {is_test('file_path')} AS test FROM commit_files JOIN files ON path = file_path),
imp AS (SELECT target_id AS file_path, source_id AS importer FROM imports WHERE source_id <> target_id AND source_id IN (SELECT file_path FROM files)),
out_calls AS (SELECT ch.change, s.id, s.file_path, s.line_start, ch.test, count(*) AS n FROM ch JOIN symbols s ON ch.file_path = s.file_path JOIN calls c ON c.target_id = s.id
    WHERE s.exported AND NOT EXISTS (SELECT 1 FROM ch o WHERE o.change = ch.change AND o.file_path = c.source_file) GROUP BY ALL)"""
_BASE = "split_part(file_path, '/', -1)"


def _every_change(g) -> DataFrame:
    return g.commit_files.select(F.col("commit_id").alias("change"), "path")


over_graph("o094_change_summary", _EVERY_CHANGE + f"""
, own AS (SELECT change, count(*) AS symbols, count(*) FILTER (exported) AS exported, count(*) FILTER (exported AND kind IN ('function', 'method', 'class', 'interface')) AS k,
    string_agg(name, ', ' ORDER BY file_path, line_start, id) FILTER (exported AND kind IN ('function', 'method', 'class', 'interface')) AS names FROM ch JOIN symbols USING (file_path) WHERE NOT test GROUP BY change),
b AS (SELECT change, count(DISTINCT importer) AS blast FROM ch JOIN imp USING (file_path) GROUP BY change), o AS (SELECT change, count(*) AS called FROM out_calls WHERE NOT test GROUP BY change),
f AS (SELECT change, list_sort(list(DISTINCT {module('file_path')})) AS l FROM ch WHERE NOT test GROUP BY change),
t0 AS (SELECT change, file_path, count(*) AS n FROM ch JOIN imp USING (file_path) GROUP BY ALL HAVING count(*) >= 2), t1 AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY n DESC, file_path) AS r, count(*) OVER (PARTITION BY change) AS c FROM t0),
t AS (SELECT change, string_agg({_BASE} || ' (blast:' || n || ')', ', ' ORDER BY r) AS top FROM t1 WHERE c >= 2 AND r <= 3 GROUP BY change),
j AS (SELECT x.change, coalesce(symbols, 0) AS symbols, coalesce(exported, 0) AS exported, CASE WHEN k BETWEEN 2 AND 8 THEN names END AS names, coalesce(blast, 0) AS blast, coalesce(called, 0) AS called, coalesce(len(l), 0) AS folders,
    CASE WHEN len(l) >= 3 THEN array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ' +' || (len(l) - 5) || ' more' ELSE '' END END AS scope, top
    FROM (SELECT DISTINCT change FROM ch) x LEFT JOIN own USING (change) LEFT JOIN b USING (change) LEFT JOIN o USING (change) LEFT JOIN f USING (change) LEFT JOIN t USING (change))
SELECT *, CASE WHEN symbols > 0 THEN CASE WHEN blast + 3 * called >= 16 THEN 'HIGH' WHEN blast + 3 * called >= 6 THEN 'MEDIUM' END END AS risk FROM j""", lambda g: review.summaries(g, _every_change(g)))
over_graph("o096_change_sections", _EVERY_CHANGE + f"""
, e AS (SELECT change, 'external' AS section, id AS item, n, 10 AS most, row_number() OVER (PARTITION BY change ORDER BY file_path, line_start, id) AS r FROM out_calls),
i0 AS (SELECT DISTINCT change, importer FROM ch JOIN imp USING (file_path) WHERE NOT EXISTS (SELECT 1 FROM ch o WHERE o.change = ch.change AND o.file_path = importer)),
i AS (SELECT change, 'importer', importer, NULL, 10, row_number() OVER (PARTITION BY change ORDER BY importer) FROM i0),
k0 AS (SELECT DISTINCT ch.change, s.file_path, s.line_start, s.id, b.file_path AS by_file, b.id AS painter FROM ch JOIN symbols s ON s.file_path = ch.file_path AND s.kind = 'component' JOIN edges e ON e.kind = 'renders' AND e.target_id = s.id JOIN symbols b ON e.source_id = b.id
    WHERE NOT EXISTS (SELECT 1 FROM ch o WHERE o.change = ch.change AND o.file_path = b.file_path)),
k AS (SELECT change, 'component', painter || ' renders ' || id, NULL, 5, row_number() OVER (PARTITION BY change ORDER BY file_path, line_start, id, by_file, painter) AS r FROM k0 QUALIFY r <= 5),
t0 AS (SELECT change, source_file, count(*) AS n FROM ch JOIN calls ON file_path = target_file WHERE {is_test('source_file')} GROUP BY ALL),
t AS (SELECT change, 'test', source_file, n, 5, row_number() OVER (PARTITION BY change ORDER BY n DESC, source_file) FROM t0),
u AS (SELECT change, 'untested', id, NULL, 6, row_number() OVER (PARTITION BY change ORDER BY file_path, line_start, id) FROM ch JOIN symbols s USING (file_path)
    WHERE NOT test AND kind IN ('function', 'method', 'class') AND id NOT IN (SELECT target_id FROM calls WHERE {is_test('source_file')}))
SELECT change, section, CAST(r AS INTEGER) AS r, item, CAST(n AS BIGINT) AS n, total FROM (SELECT *, count(*) OVER (PARTITION BY change, section) AS total FROM (FROM e UNION ALL FROM i UNION ALL FROM k UNION ALL FROM t UNION ALL FROM u)) WHERE r <= most""",
    lambda g: review.sections(g, _every_change(g)))
over_graph("o099_parameter_idioms", "SELECT 'a,b' AS params, count(*) AS n FROM symbols WHERE kind IN ('function', 'method') HAVING count(*) >= 3", advice.parameter_idioms)
over_graph("o116_name_series", "SELECT file_path, regexp_replace(name, '_?([0-9]+|[A-C])$', '') AS stem, count(DISTINCT name) AS n FROM symbols GROUP BY 1, 2 HAVING count(DISTINCT name) >= 3", advice.name_series)
over_graph("o127_counterparts", """
, w AS (SELECT id, file_path, regexp_replace(name, '_[0-9]+$', '') AS name FROM symbols WHERE kind IN ('function', 'method')),
p(a, b) AS (VALUES """ + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in advice.ANTONYMS) + """),
m AS (SELECT id, file_path, p.b || substr(name, length(p.a) + 1) AS name FROM w JOIN p ON starts_with(name, p.a || '_') UNION ALL SELECT id, file_path, substr(name, 1, length(name) - length(p.a)) || p.b FROM w JOIN p ON ends_with(name, '_' || p.a))
SELECT m.id, w.id AS counterpart FROM m JOIN w ON m.file_path = w.file_path AND m.name = w.name""", advice.counterparts)
over_graph("o084b_stale_callers", """
, a AS (SELECT path, DATE '2001-08-02' - max(day) AS days FROM commit_files GROUP BY path)
SELECT target_id AS id, count(*) AS callers FROM calls WHERE source_file <> target_file AND target_file IN (SELECT path FROM a WHERE days < 30) AND source_file IN (SELECT path FROM a WHERE days BETWEEN 90 AND 730) GROUP BY 1""", advice.staleness, NOW)
over_graph("o073b_hidden_coupling", "SELECT path, partner FROM cochange c WHERE frequency >= 0.02 AND NOT EXISTS (SELECT 1 FROM imports i WHERE (i.source_id = path AND i.target_id = partner) OR (i.source_id = partner AND i.target_id = path))", advice.hidden_coupling, 0.02)
over_graph("o065b_change_exposure", "SELECT file_path, CASE WHEN count(*) >= 16 THEN 'HIGH' WHEN count(*) >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM dependents GROUP BY 1", advice.change_exposure)
over_usage("o102_insights", """
, k AS (SELECT session, mode AS task_type FROM (SELECT session, mode, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, mode) AS r FROM sessions GROUP BY 1, 2) WHERE r = 1),
f AS (SELECT session, string_agg(mode, ',' ORDER BY t, e) AS modes FROM (SELECT session, mode, min(ts) AS t, min(event_id) AS e FROM sessions GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT k.task_type, any_value(f.modes) AS modes, sum(tokens) AS tokens, count(*) FILTER (empty) < 0.5 * count(*) AS success FROM sessions s JOIN k ON s.session = k.session JOIN f ON s.session = f.session GROUP BY s.session, k.task_type)
SELECT a.task_type, b.modes AS best_modes, avg_tokens, success_rate, n FROM (SELECT task_type, count(*) AS n, CAST(floor(sum(tokens) / count(*)) AS BIGINT) AS avg_tokens, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM e GROUP BY 1 HAVING count(*) >= 5) a
LEFT JOIN (SELECT task_type, modes FROM (SELECT task_type, modes, row_number() OVER (PARTITION BY task_type ORDER BY count(*) DESC, modes) AS r FROM e WHERE success GROUP BY 1, 2) WHERE r = 1) b ON a.task_type = b.task_type""", telemetry.insights)

# --- signatures, embeddings and depth --------------------------------------------------------------------------------
from ..operators import bodies, embed  # noqa: E402

over_graph("o_signatures", "SELECT id, 2 AS parameters, 0 AS annotated, 0 AS defaults, false AS variadic, false AS is_async, '' AS returns FROM symbols WHERE kind IN ('function', 'method')", bodies.signatures)
over_graph("o055_embed", None, embed.embed)
over_graph("o069q_import_depth", None, lambda g: traverse.import_depth(g, g.files.select(F.col("file_path").alias("root"))))
ORACLE_SQL["o069q_import_depth"] = GRAPH.replace("WITH s0", "WITH RECURSIVE s0", 1) + f""", i AS (SELECT * FROM imports WHERE NOT {is_test('source_id')} AND NOT {is_test('target_id')}), reach(root, node, hops) AS (
    SELECT root, root, 0 FROM ({_STARTS}) UNION SELECT root, i.source_id, hops + 1 FROM reach JOIN i ON i.target_id = node WHERE hops < 12)
SELECT root, max(hops) AS depth FROM (SELECT root, node, min(hops) AS hops FROM reach GROUP BY 1, 2) GROUP BY root"""

# --- tasks, branches and hunks ---------------------------------------------------------------------------------------
from ..functions.keywords import changes_no_source  # noqa: E402

#: A merge of a branch for each part: features, documentation, releases, and numbered branches with a body.
_MERGE = """concat('Merge pull request #', p_partkey, ' from me/', CASE p_partkey % 7 WHEN 0 THEN 'docs/' WHEN 1 THEN 'fix-' WHEN 2 THEN 'release-' WHEN 3 THEN 'add-' WHEN 4 THEN 'v1.' WHEN 5 THEN 'readme_' ELSE 'docstring-' END,
    p_size, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), chr(10), 'Bump versions of dependencies') ELSE concat(chr(10), 'Handle ', p_name) END)"""
query("o123_branches", f"""
SELECT p_partkey, regexp_matches(b, '^docs?/') OR regexp_matches(leaf, '(^|[-_])(docs?|readme|changelog|documentation|version|release)([-_]|$)') OR regexp_matches(leaf, '(^|[-_])v?[0-9]+[.][0-9]+')
    OR (regexp_matches(leaf, '^(issue|ticket|bug|patch|pr|fix|hotfix)[-_]?[0-9]|^[0-9]+[-_]') AND contains(t, 'Bump versions of dependencies')) AS skipped
FROM (SELECT p_partkey, t, regexp_extract(t, 'from me/(\\S+)', 1) AS b, split_part(regexp_extract(t, 'from me/(\\S+)', 1), '/', -1) AS leaf FROM (SELECT p_partkey, {_MERGE} AS t FROM part))""")(
    lambda s, d: table(s, d, "part").select("p_partkey", changes_no_source(F.expr(_MERGE)).alias("skipped"))
)
query("o124_hunk_lines", """
SELECT DISTINCT l_orderkey, CAST(unnest(generate_series(l_partkey, l_partkey + CAST(l_quantity AS BIGINT) % 5 - 1)) AS INTEGER) AS line FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 5 > 0""")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", F.explode(texts.hunk_lines(F.concat(F.lit("@@ -1,2 +"), "l_partkey", F.lit(","), F.col("l_quantity").cast("long") % 5, F.lit(" @@ x")))).alias("line")).distinct()
)
over_graph("o126_path_fallback", "SELECT DISTINCT file_path FROM symbols WHERE contains(file_path, 'economy/brand_11') AND NOT contains(file_path, 'test')", advice.path_fallback, "Economy/Brand_11")
over_graph("o104_coverage", """
SELECT resolved, total, round(resolved / total, 6) AS share, (SELECT count(*) FROM files) AS files, CASE WHEN resolved / total > 0.75 THEN 'high' WHEN resolved / total >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT count(*) FILTER (w IN (SELECT lower(name) FROM symbols)) AS resolved, count(*) AS total FROM (SELECT unnest(['nothing', (SELECT lower(name) FROM symbols WHERE seq = 30), (SELECT lower(name) FROM symbols WHERE seq = 31)]) AS w))""",
    lambda g: advice.coverage(g, ["Nothing", _symbol_name(g, 30), _symbol_name(g, 31)], g.files))

# --- a store that lasts ----------------------------------------------------------------------------------------------
from ..streaming.store import Store, with_files  # noqa: E402


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of files in a store, each document a file with one symbol that refers to the next one: in the second, French files change and German ones go.  What counts then, by file."""
    at = Window.partitionBy("source").orderBy("doc_id")
    path = lambda c: F.concat("source", F.lit("/"), c.cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("lang", "text", path(F.col("doc_id")).alias("path"), path(F.lead("doc_id").over(at)).alias("next"))
    store = Store(spark, step_folder(spark), {
        "files": "path string, hash string", "symbols": "id string, file_path string",
        "edges": "kind string, source_id string, target_id string, line int, source_file string, target_file string",
    })

    def relations(rows: DataFrame, name: str, text: Column, refers: bool) -> dict[str, DataFrame]:
        known = rows.where("next is not null")
        edges = known.select(F.lit("imports").alias("kind"), F.col("path").alias("source_id"), F.col("next").alias("target_id"), F.lit(0).alias("line"))
        if refers:
            edges = edges.unionByName(known.select(F.lit("references").alias("kind"), F.concat("path", F.lit("::body")).alias("source_id"), F.concat("next", F.lit("::body")).alias("target_id"), F.lit(1).alias("line")))
        symbols = rows.select(F.concat("path", F.lit(f"::{name}")).alias("id"), F.col("path").alias("file_path"))
        return {"files": rows.select("path", F.md5(text).alias("hash")), "symbols": symbols, "edges": with_files(edges)}

    store.apply(0, docs, **relations(docs, "body", F.col("text"), True))
    store.apply(1, docs.where("lang in ('fr', 'de')"), **relations(docs.where("lang = 'fr'"), "changed", simple_upper(F.col("text")), False))
    names = store.read("symbols").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("symbol"))
    edges = store.read("edges").groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "references").alias("refers"))
    return store.read("files").join(names, "path", "left").join(edges, "path", "left").na.fill(0, ["edges", "refers"])


QUERIES["o131_store"] = stored_documents
ORACLE_SQL["o131_store"] = """
WITH d AS (SELECT *, source || '/' || doc_id || '.txt' AS path, lead(doc_id) OVER w AS next_id, lead(lang) OVER w AS next_lang FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT path, CASE WHEN lang = 'fr' THEN md5(upper(text)) ELSE md5(text) END AS hash, path || CASE WHEN lang = 'fr' THEN '::changed' ELSE '::body' END AS symbol,
    CAST((next_id IS NOT NULL)::INT + refers AS BIGINT) AS edges, refers
FROM (SELECT *, CAST(next_id IS NOT NULL AND lang <> 'fr' AND next_lang NOT IN ('fr', 'de') AS BIGINT) AS refers FROM d) WHERE lang <> 'de'"""


# --- prepared contexts -----------------------------------------------------------------------------------------------
def gated_contexts(g: CodeGraph) -> DataFrame:
    """Each name without its number is a task with two keywords, the name and its last word: the files that declare them, those of classes with its first word to fall back on, files of its densest symbols as baseline."""
    named = g.symbols.select("file_path", "complexity", "kind", F.regexp_replace("name", r"_\d+$", "").alias("task"))
    last, first = F.substring_index("task", "_", -1), F.substring_index("task", "_", 1)
    tasks = named.select("task").distinct()
    pairs = tasks.select("task", F.lit(1).alias("k"), F.col("task").alias("keyword")).unionByName(tasks.select("task", F.lit(2).alias("k"), last.alias("keyword")))
    declared = named.select(F.col("task").alias("keyword"), "file_path").unionByName(named.select(last.alias("keyword"), "file_path")).distinct()
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("file_path"))
    found = pairs.join(declared.withColumn("rank", rank("keyword")), "keyword").select("task", "keyword", "k", F.col("file_path").alias("file"), "rank")
    classes = named.where("kind = 'class'").select(first.alias("_first"), "file_path").distinct().withColumn("rank", rank("_first"))
    fallback = tasks.select("task", last.alias("keyword"), first.alias("_first")).join(classes, "_first").select("task", "keyword", F.lit(2).alias("k"), F.col("file_path").alias("file"), "rank", F.lit(1).alias("way"))
    return context.gate(found, fallback, named.where("complexity >= 28").select("task", F.col("file_path").alias("file")))


over_graph("o104_prepare_context", """
, named AS (SELECT file_path AS f, complexity, kind, regexp_replace(name, '_[0-9]+$', '') AS task FROM symbols), words AS (SELECT DISTINCT task, split_part(task, '_', -1) AS last, split_part(task, '_', 1) AS first FROM named),
pairs AS (SELECT task, 1 AS k, task AS keyword FROM words UNION ALL SELECT task, 2, last FROM words),
declared AS (SELECT DISTINCT task AS keyword, f FROM named UNION SELECT DISTINCT split_part(task, '_', -1), f FROM named),
found AS (SELECT task, keyword, k, f, r, n FROM pairs JOIN (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY f) AS r, count(*) OVER (PARTITION BY keyword) AS n FROM declared) USING (keyword)),
defined AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY f) AS r FROM (SELECT DISTINCT split_part(task, '_', 1) AS first, f FROM named WHERE kind = 'class')),
ways AS (SELECT task, k, 2 AS way, r, f FROM found WHERE n BETWEEN 9 AND 15 AND r <= greatest(1, 15 - n)
    UNION ALL SELECT w.task, 2, 1, d.r, d.f FROM words w JOIN defined d USING (first) WHERE length(w.last) >= 4 AND EXISTS (SELECT 1 FROM found x WHERE x.task = w.task AND x.keyword = w.last AND x.n > 8)),
instead AS (SELECT * FROM ways QUALIFY (k, way) = min((k, way)) OVER (PARTITION BY task)),
every AS (SELECT task, 0 AS part, k, r, f FROM instead UNION ALL SELECT task, 1, k, r, f FROM found WHERE n <= 8),
places AS (SELECT task, f, min((part, k, r)) AS place FROM every GROUP BY 1, 2), base AS (SELECT DISTINCT task, f FROM named WHERE complexity >= 28),
placed AS (SELECT p.task, p.f, row_number() OVER (PARTITION BY p.task ORDER BY place, p.f) AS r, b.f IS NOT NULL AS told, max(CASE WHEN place[1] = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.task) = 1 AS focus
    FROM places p LEFT JOIN base b ON b.task = p.task AND b.f = p.f),
gathered AS (SELECT task, count(*) AS n, any_value(focus) AS focus, count(*) FILTER (told) AS shared, string_agg(f, ' ' ORDER BY r) FILTER (focus OR r <= 5) AS files FROM placed GROUP BY task),
said AS (SELECT task, count(*) AS said FROM base GROUP BY 1),
judged AS (SELECT task, n, files, CASE WHEN coalesce(said, 0) >= 2 AND shared = 0 THEN 'off the baseline' WHEN focus THEN 'focus' ELSE 'path' END AS how FROM gathered LEFT JOIN said USING (task))
SELECT DISTINCT words.task, coalesce(how, 'nothing') AS how, coalesce(n, 0) AS n, CASE WHEN how IN ('focus', 'path') THEN files ELSE '' END AS files FROM words LEFT JOIN judged USING (task)""", gated_contexts)


# --- families of names, exposure -------------------------------------------------------------------------------------
over_graph("o116_variant_groups", f"""
, v AS (SELECT DISTINCT file_path, regexp_extract(name, '^(.+)_([a-z]|[0-9]+)$', 1) AS base, CAST(regexp_extract(name, '_([0-9]+)$', 1) AS BIGINT) AS pos, name FROM symbols
    WHERE kind IN ('function', 'method') AND NOT {is_test('file_path')} AND length(ltrim(regexp_extract(name, '^(.+)_([a-z]|[0-9]+)$', 1), '_')) >= 5),
o AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 1 THEN 0 ELSE 1 END AS b FROM v WINDOW w AS (PARTITION BY file_path, base ORDER BY pos, name)),
r AS (SELECT *, sum(b) OVER (PARTITION BY file_path, base ORDER BY pos, name ROWS UNBOUNDED PRECEDING) AS run FROM o),
c AS (SELECT file_path, base, run, count(*) AS n, count(DISTINCT pos) AS long FROM r GROUP BY 1, 2, 3)
SELECT file_path, base, 'numeric series' AS series, CAST(sum(n) AS BIGINT) AS total, max(long) AS longest_run FROM c GROUP BY 1, 2 HAVING sum(n) >= 2""", families.variant_groups)
over_graph("o116_sibling_families", f"""
, f AS (SELECT id, name, file_path, regexp_replace(file_path, '/?[^/]*$', '') AS folder, split_part(name, '_', 1) AS stem FROM symbols WHERE NOT {is_test('file_path')} AND length(split_part(name, '_', 1)) >= 5)
SELECT id, stem, siblings FROM (SELECT a.id, a.stem, count(DISTINCT b.name) AS siblings FROM f a JOIN f b ON a.folder = b.folder AND a.stem = b.stem AND a.file_path <> b.file_path GROUP BY 1, 2) WHERE siblings >= 3""", families.sibling_families)
over_graph("o065c_exposure", f"""
, hot AS (SELECT path FROM velocity), t AS (SELECT DISTINCT target_id FROM calls WHERE {is_test('source_file')}),
up AS (SELECT target_id AS id, count(DISTINCT source_file) AS caller_files, count(*) FILTER (source_file IN (FROM hot)) AS hot_callers FROM calls WHERE source_file <> target_file AND NOT {is_test('source_file')} GROUP BY 1),
down AS (SELECT source_id AS id, count(*) AS callees, count(*) FILTER (target_file IN (FROM hot)) AS hot_callees, count(*) FILTER (target_id NOT IN (FROM t)) AS untested FROM calls WHERE source_file <> target_file AND NOT {is_test('target_file')} GROUP BY 1),
x AS (SELECT s.id, coalesce(caller_files, 0) AS caller_files, coalesce(hot_callees, 0) AS hot_callees, coalesce(hot_callers, 0) AS hot_callers, coalesce(callees, 0) AS callees, coalesce(untested, 0) AS untested, s.file_path IN (FROM hot) AS in_hot
    FROM symbols s LEFT JOIN up ON up.id = s.id LEFT JOIN down ON down.id = s.id),
y AS (SELECT *, (caller_files >= 8)::INT + (hot_callees >= 2)::INT + (hot_callers >= 3)::INT + (callees >= 3 AND untested / callees >= 0.5)::INT + in_hot::INT AS factors FROM x)
SELECT *, CASE WHEN factors >= 3 THEN 'CRITICAL' WHEN factors = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM y WHERE factors > 0""", lambda g: families.exposure(g, history.velocity(g, NOW, 7)))


@query("o020_most_children", GRAPH + ", c AS (SELECT source_id, target_id FROM edges WHERE kind = 'contains') SELECT id, kind, file_path, line_start FROM symbols WHERE id IN (SELECT target_id FROM c WHERE source_id = (SELECT source_id FROM c GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1))")
def most_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the symbol that contains the most symbols contains."""
    g = graph(spark, sf_dir)
    top = g.pairs("contains").groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").first()
    return lookup.children_of(g, top[0] if top else "").select("id", "kind", "file_path", "line_start")
