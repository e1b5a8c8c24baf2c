"""Rules of a change: on its files, whether the graph knows them or not, on the symbols in them, on those who call these, and on totals."""

from __future__ import annotations

from .base import FN, SRC, Rule, has, like

# Extensions, words and names of changed files.
_CONFIG_ENDS = (".cfg", ".ini", ".toml", ".yaml", ".yml", ".json", ".conf", ".config")
_CONFIG_ASIDE = ("test", "spec", "fixture", "mock", "lock", "package-lock", "yarn.lock")
_DATA_ENDS = (".json", ".yaml", ".yml", ".toml", ".env", ".ini", ".cfg", ".csv")
_SOURCE_EXTENSIONS = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "rb", "php", "cs")
_ROOT_EXTENSIONS = ("py", "js", "ts", "go", "rs")
_MIGRATION_FOLDERS = ("/migrations/", "/migration/", "/migrate/", "/alembic/")
_MIGRATION_WORDS = ("migration", "migrate", "alembic", "schema", "flyway", "liquibase")
_SCHEMA_BASES = ("schema.py", "models.py", "model.py", "tables.py", "entities.py")
_GENERATED_ENDS = ("_pb2.py", "_pb2_grpc.py", "_generated.py", "_gen.py", "_auto.py")
_VERSION_FILES = ("version.py", "__version__.py", "VERSION", "VERSION.txt", "pyproject.toml", "package.json", "Cargo.toml", "setup.cfg")
_ENTRIES_OF_FOLDERS = ("__init__.py", "index.js", "index.ts", "mod.rs", "index.jsx", "index.tsx")
_INTERFACE_WORDS = ("abstract", "interface", "protocol", "contract", "base", "abc")
_TEST_STEMS = ("conftest", "fixtures", "test_helpers", "test_utils", "testing_utils")
_NOTICES = ("changelog", "changes", "history", "release", "readme", "contributing", "notice")
_BUILD_BASES = ("makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".travis.yml", ".circleci", "jenkinsfile", "tox.ini", "setup.cfg", "pyproject.toml", ".github")

_LOW = "lower(file_path)"
_JOINED = "replace(lower(file_path), '/', '_')"
_AS_WRITTEN = "regexp_replace(file_path, '^.*/', '')"
_INIT = f"{_AS_WRITTEN} = '__init__.py'"


def _ends(column: str, ends: tuple[str, ...]) -> str:
    return like(column, *[f"%{e}" for e in ends])


def _in(column: str, values: tuple[str, ...]) -> str:
    return like(column, *values)


# id, condition on the totals of a change, label
_TOTALS = [
    ("S705", "changed = 1", "single file"), ("S687", "changed >= 5", "five files"), ("S771", "changed >= 5", "wide change"), ("S879", "changed >= 5", "broad change"), ("S999", "changed >= 6", "six files"),
    ("S549", "changed >= 8", "eight files"), ("S497", "changed >= 10", "ten files"), ("S609", "changed >= 20", "twenty files"), ("S302", "changed >= 20", "very large change"),
    ("S477", "roots >= 5", "five first parts of paths"), ("S717", "changed >= 2 AND places = 1", "one folder"), ("S819", "modules >= 3", "three top folders"), ("S590", "modules >= 3", "three packages"), ("S837", "modules >= 2", "two packages"),
    ("S267", "open_modules >= 3", "three modules"), ("S143", "src_modules >= 3", "sources of three modules"), ("S909", "changed >= 3 AND folders >= 3", "three folders"), ("S957", "changed >= 3 AND folders >= 3", "three parent folders"),
    ("S447", "changed > 0 AND config_names = changed", "only settings by name"), ("S723", "changed > 0 AND config_names < changed AND config_bases = changed", "only settings and errors"), ("S561", "changed > 0 AND config_files = changed", "only configuration"),
    ("S681", "changed > 0 AND tests = changed", "only tests"), ("S711", "tests > 0 AND tests = changed", "tests without a source"), ("S423", "changed > 0 AND tests = changed", "all changed files are tests"),
    ("S540", "changed > 0 AND tests = changed", "nothing but tests"), ("S873", "tests > 0 AND tests = changed", "no source changed"), ("S927", "known >= 2 AND known_tests = known", "known tests only"), ("S205", "known_src = 0 AND known_tests >= 2", "tests and no known source"),
    ("S78", "known_tests BETWEEN 1 AND 4", "a few tests"), ("S149", "known_src > 0 AND known_tests > 0", "tests beside sources"), ("S181", "known >= 4 AND 2 * known_tests >= known", "half of the change is tests"), ("S313", "tests >= 2 AND coded >= 1 AND 2 * tests >= 3 * coded", "more tests than code"),
    ("S199", "known_src = 1", "one source"), ("S215", "known_src >= 5", "five sources"), ("S135", "src_lines >= 500", "500 lines in changed sources"), ("S795", "symbols >= 10", "ten symbols in changed files"),
    ("S639", "extensions >= 3", "three kinds of files"), ("S699", "changed > 0 AND code_files = 0", "no code"), ("S747", "languages >= 2", "two languages"), ("S951", "changed >= 2 AND families >= 2", "two families of languages"),
    ("S753", "known >= 2 AND public_top = 0", "only private symbols"), ("S759", "known_src >= 1 AND src_top_others = 0", "only constants in sources"), ("S831", "const_files > 0 AND const_files = known", "only files of constants"), ("S843", "type_files > 0 AND type_files = known", "only files of types"),
    ("S308", "changed > 0 AND papers = changed", "only documentation"), ("S885", "changed > 0 AND docs = changed", "all files are documentation"), ("S1005", "changed > 0 AND more_docs = changed", "documentation and nothing else"),
    ("S375", "told > 0 AND untold_src = 0", "documentation, no code"), ("S903", "docs > 0 AND docs < changed", "documentation beside code"),
]

# id, condition on a changed file, least number of them, label
_FILES = [
    ("S627", f"{_ends(_LOW, _CONFIG_ENDS)} AND NOT {has(_LOW, *_CONFIG_ASIDE)} AND {SRC}", 1, "configuration changed"),
    ("S741", _ends("file_path", _DATA_ENDS), 1, "data or configuration changed"),
    ("S603", f"{has('file_path', *_MIGRATION_FOLDERS)} OR {_ends(_LOW, ('.sql', '.migration'))}", 1, "migration by folder"),
    ("S693", has(_LOW, *_MIGRATION_WORDS), 1, "migration by path"),
    ("S735", has(_LOW, "migration", "migrate", "schema", "alembic"), 1, "schema or migration changed"),
    ("S825", has("base", "migration", "migrations", "migrate", "schema_change", "alembic", "flyway"), 1, "migration script changed"),
    ("S567", has(_LOW, "schema.sql", "migration", "alembic", "flyway", "liquibase", "_migrate"), 1, "database schema changed"),
    ("S651", f"{_in('base', _SCHEMA_BASES)} OR {_ends(_LOW, ('.sql',))} OR {has(_JOINED, 'migration', 'schema', 'models')}", 1, "models changed"),
    ("S633", f"{_ends(_LOW, _GENERATED_ENDS)} OR {has(_JOINED, 'generated', '_pb2', 'autogenerated', 'do not edit', 'do_not_edit')}", 1, "generated files changed"),
    ("S516", has(_LOW, "_pb2", "_generated", "_auto.", "/generated/", "_grpc", ".auto."), 1, "generated sources changed"),
    ("S621", "is_test AND right(file_path, 3) = '.py'", 1, "test files changed"),
    ("S282", "is_test", 1, "tests in the change"),
    ("S663", _INIT, 1, "package beginning changed"),
    ("S777", _INIT, 1, "package files changed"),
    ("S522", _INIT, 1, "package surface changed"),
    ("S573", _INIT, 1, "package interface changed"),
    ("S807", "base = 'conftest.py'", 1, "shared fixtures changed"),
    ("S669", "ext IN ('md', 'rst', 'txt')", 1, "documentation changed"),
    ("S675", _in(_AS_WRITTEN, _VERSION_FILES), 1, "version declared anew"),
    ("S765", "depth = 0 AND " + f"({' OR '.join(_in('ext', (e,)) for e in _ROOT_EXTENSIONS)})", 1, "file at the root changed"),
    ("S789", "ext <> '' AND NOT " + _in("ext", _SOURCE_EXTENSIONS), 1, "files that are no sources"),
    ("S783", f"NOT known AND {SRC}", 1, "unknown sources"),
    ("S543", f"NOT known AND {SRC}", 2, "several unknown sources"),
    ("S369", "symbols >= 20", 1, "dense file changed"),
    ("S465", "lines >= 500", 1, "long file changed"),
    ("S945", f"{SRC} AND importers - test_importers >= 5", 1, "widely imported file changed"),
    ("S915", _in(_AS_WRITTEN, _ENTRIES_OF_FOLDERS), 2, "several beginnings of packages"),
    ("S939", f"{has('base', *_INTERFACE_WORDS)} AND {SRC}", 1, "interfaces changed"),
    ("S963", _in("stem", _TEST_STEMS), 1, "test infrastructure changed"),
    ("S596", like("base", *[f"{w}%" for w in _NOTICES]), 1, "notices changed"),
    ("S975", f"{_in('base', _BUILD_BASES)} OR {has(_LOW, '.github/', '.circleci/')}", 1, "build configuration changed"),
]

DIFF: list[Rule] = [
    *[Rule("diff", i, "change", condition, 1, label) for i, condition, label in _TOTALS],
    *[Rule("diff", i, "diff", condition, n, label) for i, condition, n, label in _FILES],
    Rule("diff", "S127", "touched", f"{SRC} AND {FN} AND complexity >= 10", 1, "complex function changed"),
    Rule("diff", "S160", "touched", f"{SRC} AND exported AND callers = 0 AND kind IN ('function', 'method', 'class', 'interface')", 3, "exports without a caller"),
    Rule("diff", "S187", "touched", f"{SRC} AND exported AND kind IN ('function', 'method', 'class') AND far_files >= 5", 1, "export with five callers elsewhere"),
    Rule("diff", "S485", "touched", f"kind = 'class' AND {like('name', 'Base%', 'Abstract%', 'Mixin%', 'Interface%')}", 1, "base class changed"),
    Rule("diff", "S1028", "touched", f"{SRC} AND {FN} AND far_files >= 10", 1, "function with ten caller files elsewhere"),
    Rule("diff", "S163", "user", "file_path <> ''", 3, "callers outside of the change"),
]
