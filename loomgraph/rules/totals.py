"""Totals of a repository: one row of counts, sums and maxima over its files and symbols.

Each total is an SQL aggregate that Spark and DuckDB read alike.  It is a sum or
a maximum, so tasks aggregate their own rows and shuffle one each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import FN, SRC, has, like

# Languages of code, of other text, extensions, names that programs start by.
CODE_LANGUAGES = ("python", "typescript", "tsx", "javascript", "jsx", "rust", "go", "java", "csharp", "ruby")
_TEXT_LANGUAGES = ("unknown", "text", "markdown", "json", "yaml", "toml", "html", "css")
_LINED = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".rb")
_SCRIPTS = (".py", ".js", ".ts", ".jsx", ".tsx")
_ENTRY_BASES = ("main.py", "app.py", "server.py", "cli.py", "run.py", "index.js", "index.ts")
_ENTRY_STEMS = ("main", "app", "index", "server", "cli", "run", "manage", "wsgi", "asgi", "__main__", "entrypoint", "entry_point")
_STARTING_FILES = ("main.py", "app.py", "server.py", "cli.py", "__main__.py", "run.py", "index.py", "wsgi.py", "asgi.py")
_ENTRY_NAMES = ("main", "cli", "entrypoint", "entry_point", "run_app", "start")
_ENTRY_WORDS = ("main", "cli", "run", "start", "entry", "app", "serve", "launch")
_IDLE_ENTRIES = ("main", "run", "start", "app", "application", "create_app", "entry")
_STARTING_NAMES = ("main", "run", "start", "execute", "launch", "serve", "app")
_STARTING_WORDS = ("main", "run", "__main__", "start", "app", "entry", "entrypoint")
_CONFIG_WORDS = ("config", "settings", "conf", "env", "dotenv", "secrets", "options")
_CONFIG_FILES = ("config.py", "settings.py", "constants.py", "exceptions.py", "errors.py", "env.py")
_CONFIG_ENDS = (".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".cfg", ".conf")
_NO_KIND = ("", "md", "txt", "rst", "json", "yaml", "yml", "toml", "cfg", "ini")
_CODE_EXTENSIONS = ("py", "js", "ts", "jsx", "tsx", "go", "rs", "java", "kt", "cs", "cpp", "c", "h", "rb", "php", "swift", "scala", "ex", "exs")
_PAPER_STEMS = ("readme", "changelog", "contributing", "license", "history", "authors")
_DOC_WORDS = ("readme", "changelog", "docs/", "documentation", "howto", "guide")
_LANGUAGE_OF = {
    "py": "Python", "js": "JS", "ts": "TS", "tsx": "TS", "jsx": "JS", "go": "Go", "rs": "Rust", "java": "Java", "rb": "Ruby", "cs": "C#", "cpp": "C++", "c": "C", "php": "PHP",
}
_FAMILY_OF = {
    "py": "python", "js": "js", "ts": "js", "tsx": "js", "jsx": "js", "go": "go", "java": "java", "rb": "ruby", "rs": "rust", "cpp": "cpp", "cc": "cpp", "c": "c", "cs": "csharp",
}
_ERRORS = ("%Error", "%Exception", "%Warning", "%Failure", "%Fault")


def among(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(f'{v!r}' for v in values)})"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _sum(column: str, condition: str) -> str:
    return f"coalesce(sum({column}) FILTER (WHERE {condition}), 0)"


def _max(column: str, condition: str) -> str:
    return f"coalesce(max({column}) FILTER (WHERE {condition}), 0)"


_PY = f"{SRC} AND right(file_path, 3) = '.py'"
_CODE = f"{SRC} AND code"
_TOP = "parent_id IS NULL"
_TOP_KIND = f"{_TOP} AND kind NOT IN ('unknown', 'module')"
_API = "kind IN ('function', 'method', 'class')"
_CONST = "kind IN ('constant', 'variable')"
_FUNCTION = f"{SRC} AND kind = 'function'"
_CLASS = f"{SRC} AND kind = 'class'"
_TEST_FN = "is_test AND kind IN ('function', 'method', 'test') AND left(name, 5) = 'test_'"
_BARE = "coalesce(doc, '') = ''"

FILES = {
    "src": _count(SRC), "tests": _count("is_test"), "code_src": _count(_CODE), "code_tests": _count("is_test AND code"), "py_src": _count(_PY),
    "js": _count(like("file_path", "%.js", "%.ts", "%.jsx", "%.tsx")), "script_src": _count(f"{SRC} AND {like('file_path', *[f'%{e}' for e in _SCRIPTS])}"),
    "src_lines": _sum("lines", SRC), "test_lines": _sum("lines", "is_test"), "code_lines": _sum("lines", _CODE), "max_code_lines": _max("lines", _CODE),
    "lined_src": _sum("lines", f"{SRC} AND {like('file_path', *[f'%{e}' for e in _LINED])}"), "small_src": _count(f"{SRC} AND lines < 20"),
    "src_cx": _sum("cx", SRC), "cx_files": _count(f"{SRC} AND cx > 0"),
    "src_out": _sum("imports", SRC), "src_links": _sum("src_imports", SRC), "orphans": _count(f"{SRC} AND importers = 0"),
    "max_importers": _max("importers - test_importers", SRC), "max_py_importers": _max("importers - test_importers", _PY),
    "max_depth": _max("depth", SRC), "sum_depth": _sum("depth", SRC), "root_src": _count(f"{SRC} AND depth = 0"), "root_code": _count(f"{_CODE} AND depth = 0"),
    "root_py": _count(f"{_PY} AND depth = 0"), "deep_src": _count(f"{SRC} AND depth >= 3"), "deep_code": _count(f"{_CODE} AND depth >= 3"),
    "tiny_code": _count(f"{_CODE} AND symbols <= 2"), "wide_src": _count(f"{SRC} AND top_functions >= 5"),
    "max_symbols": _max("symbols", SRC), "max_defs": _max("definitions", SRC), "max_top": _max("top_symbols", SRC),
    "test_syms": _sum("symbols", "is_test"), "max_test_syms": _max("symbols", "is_test"), "max_test_named": _max("test_named", "is_test"), "thin_tests": _count("is_test AND code AND low_test_named <= 2"),
    "langs": "count(DISTINCT language)", "src_langs": f"count(DISTINCT CASE WHEN {SRC} THEN language END)", "code_langs": f"count(DISTINCT CASE WHEN {_CODE} THEN language END)",
    "prose_free_langs": f"count(DISTINCT CASE WHEN {SRC} AND NOT {among('language', _TEXT_LANGUAGES)} THEN language END)",
    "entry_bases": _count(f"{SRC} AND {among('base', _ENTRY_BASES)}"), "entries": _count(f"{_CODE} AND {among('stem', _ENTRY_STEMS)}"), "starting_files": _count(among("regexp_replace(file_path, '^.*/', '')", _STARTING_FILES)),
}
SYMBOLS = {
    "syms": _count(SRC), "exported": _count(f"{SRC} AND exported"), "defs": _count(f"{SRC} AND {_API}"), "uncalled_defs": _count(f"{SRC} AND {_API} AND callers = 0"),
    "fns": _count(f"{SRC} AND {FN}"), "idle_fns": _count(f"{SRC} AND {FN} AND callers = 0 AND file_importers = 0"), "functions": _count(_FUNCTION), "methods": _count(f"{SRC} AND kind = 'method'"),
    "classes": _count(_CLASS), "class_methods": _sum("methods", _CLASS), "class_fns": _sum("member_fns", _CLASS), "consts": _count(f"{SRC} AND {_CONST}"), "constants": _count(f"{SRC} AND kind = 'constant'"),
    "top_any": _count(f"{SRC} AND {_TOP}"), "test_top_any": _count(f"is_test AND {_TOP}"), "top": _count(f"{SRC} AND {_TOP_KIND}"), "test_top": _count(f"is_test AND {_TOP_KIND}"),
    "top_fns": _count(f"{SRC} AND {FN} AND {_TOP}"), "top_functions": _count(f"{_FUNCTION} AND {_TOP}"), "top_classes": _count(f"{_CLASS} AND {_TOP}"), "top_consts": _count(f"{SRC} AND {_CONST} AND {_TOP}"),
    "exported_api": _count(f"{SRC} AND exported AND {_API}"), "bare_api": _count(f"{SRC} AND exported AND {_API} AND {_BARE}"),
    "code_api": _count(f"{_CODE} AND exported AND {_API}"), "idle_code_api": _count(f"{_CODE} AND exported AND {_API} AND callers = 0 AND file_importers = 0"),
    "exported_fns": _count(f"{SRC} AND exported AND {FN}"), "bare_fns": _count(f"{SRC} AND exported AND {FN} AND {_BARE}"), "exported_functions": _count(f"{_FUNCTION} AND exported"),
    "exported_classes": _count(f"{_CLASS} AND exported"), "exported_errors": _count(f"{_CLASS} AND exported AND {like('name', *_ERRORS)}"),
    "public_functions": _count(f"{_FUNCTION} AND {_TOP} AND left(name, 1) <> '_'"), "told_functions": _count(f"{_FUNCTION} AND {_TOP} AND left(name, 1) <> '_' AND NOT {_BARE}"),
    "top_defs": _count(f"{SRC} AND kind IN ('function', 'class') AND {_TOP}"), "public_defs": _count(f"{SRC} AND kind IN ('function', 'class') AND {_TOP} AND left(name, 1) <> '_'"),
    "public_top": _count(f"{SRC} AND {_TOP} AND left(name, 1) <> '_'"), "dead_top": _count(f"{SRC} AND {_TOP} AND left(name, 1) <> '_' AND confidence IS NOT NULL"),
    "cx_fns": _count(f"{SRC} AND {FN} AND complexity >= 1"), "max_cx": _max("complexity", f"{SRC} AND {FN}"), "branch_fns": _count(f"{SRC} AND {FN} AND complexity > 1"), "branch_cx": _sum("complexity", f"{SRC} AND {FN} AND complexity > 1"),
    "body_fns": _count(f"{SRC} AND {FN} AND lines >= 3"), "body_lines": _sum("lines", f"{SRC} AND {FN} AND lines >= 3"),
    "code_fns": _count(f"{_CODE} AND {FN}"), "stub_fns": _count(f"{_CODE} AND {FN} AND lines <= 1"), "code_functions": _count(f"{_CODE} AND kind = 'function'"), "code_classes": _count(f"{_CODE} AND kind = 'class'"),
    "async_fns": _count(f"{SRC} AND {FN} AND left(signature, 6) = 'async '"), "sync_fns": _count(f"{SRC} AND {FN} AND left(signature, 4) = 'def '"),
    "async_functions": _count(f"{_FUNCTION} AND left(ltrim(signature), 6) = 'async '"), "exported_async": _count(f"{SRC} AND exported AND {FN} AND left(signature, 6) = 'async '"),
    "test_fns": _count(_TEST_FN), "short_test_fns": _count(f"{_TEST_FN} AND lines <= 10"), "test_cases": _count("is_test AND kind IN ('function', 'test') AND left(name, 5) = 'test_'"),
    "entry_files": f"count(DISTINCT CASE WHEN {SRC} AND {FN} AND {among('name', _ENTRY_NAMES)} THEN file_path END)", "entry_fns": _count(f"{SRC} AND {FN} AND {among('low', _ENTRY_WORDS)}"),
    "idle_entries": _count(f"{SRC} AND {FN} AND {_TOP} AND callers = 0 AND {among('name', _IDLE_ENTRIES)}"), "starting_fns": _count(f"{SRC} AND {FN} AND {_TOP} AND {among('name', _STARTING_NAMES)}"),
    "starting_functions": _count(f"{_FUNCTION} AND {_TOP} AND {among('low', _STARTING_WORDS)}"),
}
# Over the rows of strata: by (language, folder or module), key, files of code, sources, importers outside of a module.
STRATA = {
    "top_language": _max("code_src", "part = 'language'"), "top_folder": _max("src", "part = 'folder'"), "modules": _count("part = 'module'"), "top_module": _max("src", "part = 'module'"),
    "orphan_modules": _count("part = 'module' AND key <> '.' AND outside = 0"),
}
STRATUM = {"code_src": _count(_CODE), "src": _count(SRC), "outside": "coalesce(sum(outside_importers), 0)"}

#: Parts of a path.
PATHS = {
    "base": "lower(regexp_replace(file_path, '^.*/', ''))", "stem": "regexp_replace(lower(regexp_replace(file_path, '^.*/', '')), '[.][^.]*$', '')", "depth": "length(file_path) - length(replace(file_path, '/', ''))",
    "folder": "regexp_replace(file_path, '/?[^/]*$', '')", "module": "CASE WHEN instr(file_path, '/') > 0 THEN split_part(file_path, '/', 1) ELSE '.' END",
    "ext": "CASE WHEN instr(regexp_replace(file_path, '^.*/', ''), '.') > 0 THEN lower(regexp_replace(file_path, '^.*[.]', '')) ELSE '' END",
}


def _mapped(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in values.items())} END"


def _ends(*ends: str) -> str:
    return like("lower(file_path)", *[f"%{e}" for e in ends])


_DOCS = _ends(".md", ".rst", ".txt", ".adoc")
_TOLD = f"({_DOCS} OR {has('lower(file_path)', *_DOC_WORDS)})"
# Over the files of a change.
CHANGE = {
    "changed": "count(*)", "tests": _count("is_test"), "known": _count("known"), "known_src": _count(f"known AND {SRC}"), "known_tests": _count("known AND is_test"),
    "coded": _count(f"{SRC} AND NOT {_ends('.md', '.rst', '.txt')}"), "config_names": _count(f"{has('base', *_CONFIG_WORDS)}"), "config_bases": _count(among("regexp_replace(file_path, '^.*/', '')", _CONFIG_FILES)),
    "config_files": _count(_ends(*_CONFIG_ENDS)), "docs": _count(_DOCS), "more_docs": _count(_ends(".md", ".rst", ".txt", ".adoc", ".asciidoc")),
    "papers": _count(f"{_ends('.md', '.rst', '.txt', '.ipynb', '.adoc', '.wiki')} OR {among('stem', _PAPER_STEMS)}"), "told": _count(_TOLD), "untold_src": _count(f"{SRC} AND NOT {_TOLD}"),
    "roots": "count(DISTINCT split_part(file_path, '/', 1))", "places": "count(DISTINCT CASE WHEN depth = 0 THEN file_path ELSE folder END)", "folders": "count(DISTINCT folder)", "modules": "count(DISTINCT CASE WHEN depth > 0 THEN module END)",
    "open_modules": "count(DISTINCT CASE WHEN depth > 0 AND left(module, 1) <> '.' THEN module END)", "src_modules": f"count(DISTINCT CASE WHEN known AND {SRC} THEN module END)",
    "extensions": f"count(DISTINCT CASE WHEN NOT {among('ext', _NO_KIND)} THEN ext END)", "code_files": _count(among("ext", _CODE_EXTENSIONS)),
    "languages": f"count(DISTINCT {_mapped('ext', _LANGUAGE_OF)})", "families": f"count(DISTINCT {_mapped('ext', _FAMILY_OF)})",
    "symbols": "coalesce(sum(symbols), 0)", "src_lines": _sum("lines", f"known AND {SRC}"), "public_top": "coalesce(sum(public_top), 0)", "src_top_others": _sum("top_others", SRC),
    "const_files": _count("symbols > 0 AND consts = symbols"), "type_files": _count("symbols > 0 AND classes = symbols"),
}


def _aggregates(named: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in named.items()]


def strata(files: DataFrame) -> DataFrame:
    """part, key and counts: files by language, by folder and by module, in one pass."""
    places = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("key")) for p in ("language", "folder", "module")])
    return files.withColumn("_p", F.explode(places)).select("*", "_p.part", "_p.key").groupBy("part", "key").agg(*_aggregates(STRATUM))


def totals(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row, also for no files, where all totals are 0."""
    dense = files.where(f"{SRC} AND cx > 0").orderBy(F.desc("cx"), "file_path").limit(3).agg(F.expr("coalesce(sum(cx), 0)").alias("top_cx"))
    parts = [files.agg(*_aggregates(FILES)), symbols.agg(*_aggregates(SYMBOLS)), strata(files).agg(*_aggregates(STRATA)), dense]
    return reduce(DataFrame.crossJoin, parts).withColumn("repository", F.lit("repository"))  # one row each


def of_change(changed: DataFrame) -> DataFrame:
    """One row of totals over the files of a change."""
    return changed.agg(*_aggregates(CHANGE)).withColumn("repository", F.lit("repository"))


def _columns(named: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in named.items())


#: The same in SQL, over f_file and f_symbol.
SQL = f"""
f_strata AS (SELECT part, key, {_columns(STRATUM)} FROM (SELECT 'language' AS part, language AS key, * FROM f_file UNION ALL SELECT 'folder', folder, * FROM f_file UNION ALL SELECT 'module', module, * FROM f_file) GROUP BY part, key),
f_repository AS (SELECT *, 'repository' AS repository FROM (SELECT {_columns(FILES)} FROM f_file), (SELECT {_columns(SYMBOLS)} FROM f_symbol), (SELECT {_columns(STRATA)} FROM f_strata),
  (SELECT coalesce(sum(cx), 0) AS top_cx FROM (SELECT cx FROM f_file WHERE {SRC} AND cx > 0 ORDER BY cx DESC, file_path LIMIT 3))),
f_change AS (SELECT {_columns(CHANGE)}, 'repository' AS repository FROM f_diff)
"""
