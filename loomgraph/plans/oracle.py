"""DuckDB SQL for the queries: the projected graph as common table expressions, then one body for each query."""

from __future__ import annotations

GRAPH = """
WITH s0 AS (
    SELECT p_partkey AS seq, lower(p_type) AS module, p_size,
        lower(p_type) || '/' || CASE WHEN p_size % 4 = 3 THEN 'test_' || lower(replace(p_brand, '#', '_'))
            ELSE lower(replace(p_brand, '#', '_')) || '_' || CAST(p_size % 4 AS VARCHAR) END || '.py' AS file_path,
        replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS name,
        CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 10 = 1 THEN 'component' WHEN p_partkey % 10 = 2 THEN 'constant'
            WHEN p_partkey % 10 IN (3, 4) THEN 'method' ELSE 'function' END AS kind,
        CAST(p_partkey % 500 + 1 AS INTEGER) AS line_start, CAST(p_partkey % 500 + p_size AS INTEGER) AS line_end,
        CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS doc, p_partkey % 4 <> 0 AS exported,
        CAST(p_size % 30 AS INTEGER) AS complexity, CAST(p_size * 40 AS BIGINT) AS byte_size
    FROM part
), symbols AS (
    SELECT *, file_path || '::' || name AS id, name AS qualified_name, 'python' AS language, 'def ' || name || '(a, b)' AS signature,
        CASE WHEN kind = 'method' THEN min(CASE WHEN kind = 'class' THEN file_path || '::' || name END) OVER (PARTITION BY file_path) END AS parent_id,
        line_end - line_start + 1 AS lines
    FROM s0
), steps AS (
    SELECT l_orderkey, l_linenumber, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS next
    FROM lineitem
), hops AS (
    SELECT h.l_orderkey AS o, h.l_linenumber AS line, s.id AS s_id, s.file_path AS s_file, t.id AS t_id, t.file_path AS t_file, t.kind AS t_kind
    FROM steps h JOIN symbols s ON h.l_partkey = s.seq JOIN symbols t ON h.next = t.seq
), edges AS (
    SELECT 'calls' AS kind, s_id AS source_id, t_id AS target_id, line FROM hops WHERE o % 8 = 0
    UNION ALL SELECT 'renders', s_id, t_id, line FROM hops WHERE o % 8 = 2 AND t_kind = 'component'
    UNION ALL SELECT 'imports', s_file, t_file, line FROM hops WHERE o % 64 = 1 AND s_file <> t_file AND (s_file > t_file OR o % 640 = 1)
    UNION ALL SELECT 'contains', parent_id, id, 0 FROM symbols WHERE parent_id IS NOT NULL
    UNION ALL SELECT 'inherits', id, base, 0 FROM (
        SELECT id, lag(id) OVER (PARTITION BY module, seq % 7 ORDER BY seq) AS base FROM symbols WHERE kind = 'class') WHERE base IS NOT NULL
), calls AS (
    SELECT DISTINCT e.source_id, e.target_id, a.file_path AS source_file, b.file_path AS target_file
    FROM edges e JOIN symbols a ON e.source_id = a.id JOIN symbols b ON e.target_id = b.id WHERE e.kind = 'calls'
), imports AS (
    SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'imports'
), files AS (
    SELECT file_path, count(*) AS n_symbols, max(line_end) AS line_count, sum(complexity) AS complexity, sum(byte_size) AS byte_size FROM symbols GROUP BY file_path
), commit_files AS (
    SELECT DISTINCT o_orderkey AS commit_id, CAST(o_orderdate AS DATE) AS day, file_path AS path
    FROM lineitem JOIN symbols ON l_partkey = seq JOIN orders ON l_orderkey = o_orderkey
), coupled AS (
    SELECT * FROM commit_files WHERE commit_id IN (SELECT commit_id FROM commit_files GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 50)
), pair_counts AS (
    SELECT a.path AS a, b.path AS b, count(*) AS together, max(a.day) AS last FROM coupled a JOIN coupled b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY 1, 2
), path_counts AS (
    SELECT path, count(*) AS n FROM coupled GROUP BY path
), pairs2 AS (
    SELECT a, b, together, round(together / least(x.n, y.n), 6) AS frequency, together / least(x.n, y.n) AS share, last
    FROM pair_counts JOIN path_counts x ON a = x.path JOIN path_counts y ON b = y.path WHERE together >= 2
), cochange AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY frequency DESC, partner) AS rank FROM (
        SELECT a AS path, b AS partner, together, frequency FROM pairs2 UNION ALL SELECT b, a, together, frequency FROM pairs2)) WHERE rank <= 10
), dependents AS (
    SELECT DISTINCT * FROM (SELECT target_file AS file_path, source_file AS dependent FROM calls UNION ALL SELECT target_id, source_id FROM imports) WHERE file_path <> dependent
), velocity AS (
    SELECT path, count(DISTINCT commit_id) * 7.0 / 7 AS per_week FROM commit_files WHERE day >= DATE '2001-08-02' - 7 GROUP BY path
), referenced AS (
    SELECT DISTINCT target_id AS id FROM edges WHERE kind <> 'contains'
), across AS (
    SELECT DISTINCT target_id AS id FROM edges WHERE kind <> 'contains' AND contains(source_id, '::') AND contains(target_id, '::')
        AND split_part(source_id, '::', 1) <> split_part(target_id, '::', 1)
), dead AS (
    SELECT * FROM symbols WHERE exported AND kind NOT IN ('module', 'unknown', 'test') AND name NOT IN ('main', '__init__', '__main__', 'init', 'Main')
        AND id NOT IN (SELECT id FROM referenced) AND (parent_id IS NULL OR parent_id IN (SELECT id FROM across))
), dead_points AS (
    SELECT d.id, d.kind, d.file_path, d.lines,
        CASE WHEN {test:d.file_path} THEN -50 ELSE 0 END + CASE WHEN d.id NOT IN (SELECT target_id FROM calls) THEN 30 ELSE 0 END
        + CASE WHEN d.file_path NOT IN (SELECT target_id FROM imports) THEN 25 ELSE 0 END
        + CASE WHEN d.id NOT IN (SELECT target_id FROM edges WHERE kind = 'renders') THEN 10 ELSE 0 END + CASE WHEN d.lines > 50 THEN 15 ELSE 0 END
        + CASE WHEN regexp_matches(lower(d.name), 'handle_|on_|test_|route|command|hook|middleware|plugin') THEN -20 ELSE 0 END
        + CASE WHEN d.doc <> '' THEN -15 ELSE 0 END
        + CASE WHEN d.parent_id IS NOT NULL AND d.parent_id NOT IN (SELECT target_id FROM calls) THEN -10 ELSE 0 END
        + CASE WHEN d.kind = 'component' AND (SELECT count(*) FROM symbols c WHERE c.file_path = d.file_path AND c.kind = 'component') = 1 THEN -20 ELSE 0 END AS points
    FROM dead d
), confidence AS (
    SELECT id, kind, file_path, lines, CAST(greatest(0, least(100, points)) AS INTEGER) AS confidence FROM dead_points
)
"""

USAGE = """
WITH usage AS (
    SELECT event_id, ts, user_id AS repo, event_type AS mode, CAST(trunc(value) AS INTEGER) AS tokens, event_type = 'error' AS empty FROM events
), gaps AS (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 1200000000 THEN 0 ELSE 1 END AS opens FROM usage
), sessions AS (
    SELECT *, CAST(sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps
), seqs AS (
    SELECT mode, lead(mode, 1) OVER (ORDER BY ts, event_id) AS m1, lead(mode, 2) OVER (ORDER BY ts, event_id) AS m2 FROM usage
), markov1 AS (
    SELECT s.mode AS state, m1 AS next, count(*) AS n, round(count(*) / any_value(u.uses), 6) AS p
    FROM seqs s JOIN (SELECT mode, count(*) AS uses FROM usage GROUP BY mode) u ON s.mode = u.mode WHERE m1 <> s.mode GROUP BY 1, 2 HAVING count(*) >= 5
), markov2 AS (
    SELECT s.mode AS first, s.m1 AS second, m2 AS next, count(*) AS n, round(count(*) / any_value(u.pairs), 6) AS p
    FROM seqs s JOIN (SELECT mode, m1, count(*) AS pairs FROM seqs WHERE m1 <> mode GROUP BY 1, 2) u ON s.mode = u.mode AND s.m1 = u.m1
    WHERE m2 <> s.m1 GROUP BY 1, 2, 3 HAVING count(*) >= 3
)
"""


def is_test(path: str) -> str:
    """The test-file predicate over a path expression; only Python files occur in the projection."""
    name = f"regexp_replace({path}, '^.*/', '')"
    return f"({name} = 'conftest.py' OR (starts_with({name}, 'test_') AND ends_with({name}, '.py')) OR ends_with({name}, '_test.py'))"


GRAPH = GRAPH.replace("{test:d.file_path}", is_test("d.file_path"))


def module(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN split_part({path}, '/', 1) ELSE '.' END"
