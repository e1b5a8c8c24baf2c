"""Column functions over file paths, names and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name conventions.
TEST_SUFFIXES = (".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.tsx", ".spec.js")
SIMPLE_TEST_SUFFIXES = (".test.ts", ".spec.ts", ".test.js", ".spec.js")
CONFIG_NAMES = (
    "setup.py", "setup.cfg", "pyproject.toml", "package.json", "package-lock.json", "yarn.lock", "Makefile", "makefile", "CMakeLists.txt", "tox.ini",
    "pytest.ini", ".flake8", "requirements.txt", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile", "tsconfig.json",
)
DISPATCH_WORDS = ("handle_", "on_", "test_", "route", "command", "hook", "middleware", "plugin")
EMPTY_PREFIXES = (
    "No symbols matching", "File '", "No dead code", "No results for", "No external dependencies", "No changed files", "None of the changed files",
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def is_test(path: Column) -> Column:
    """The renderers' test predicate: pytest files, conftest and JS or TS test and spec files."""
    name = basename(path)
    return (name == "conftest.py") | (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py") | _ends(name, TEST_SUFFIXES)


def is_test_simple(path: Column) -> Column:
    """The graph's own predicate: no conftest, no TSX."""
    name = basename(path)
    return (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py") | _ends(name, SIMPLE_TEST_SUFFIXES)


def is_test_history(path: Column) -> Column:
    """The history's predicate: any name that begins with test_."""
    name = basename(path)
    return name.startswith("test_") | name.endswith("_test.py") | _ends(name, SIMPLE_TEST_SUFFIXES)


def is_test_ambient(path: Column) -> Column:
    """The predicate of folder notes: files in test folders, and names that say test or spec."""
    name = basename(path)
    return F.concat(F.lit("/"), path).rlike("/tests?/") | name.startswith("test_") | name.rlike(r"_test\.|\.(test|spec)\.")


def is_test_hotspot(path: Column) -> Column:
    """The predicate of hotspot lists: also any .test. or .spec. in a name."""
    name = basename(path)
    return is_test_history(path) | name.contains(".test.") | name.contains(".spec.") | (name == "conftest.py")


def is_test_marked(path: Column) -> Column:
    """The predicate of path look-ups: a mark of tests or samples anywhere in a path."""
    return F.lower(path).rlike("test|spec|fixture|example|tutorial|demo|sample")


def file_class(path: Column) -> Column:
    """test, config or source."""
    name = basename(path)
    test = name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py") | name.contains(".test.") | name.contains(".spec.")
    return F.when(test, "test").when(name.isin(*CONFIG_NAMES) | name.contains(".config."), "config").otherwise("source")


def module_of(path: Column) -> Column:
    """The first segment of a path, '.' for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def domain_of(path: Column) -> Column:
    """The subsystem: second segment without extension (__main__ is cli), or the stem of a root file."""
    parts = F.split(path, "/")
    stem = lambda x: F.regexp_replace(x, r"\.[^.]*$", "")
    second = stem(F.get(parts, 1))
    return F.when(F.size(parts) == 1, stem(path)).when(second == "__main__", "cli").otherwise(second)


def looks_empty(text: Column) -> Column:
    out = F.lit(False)
    for p in EMPTY_PREFIXES:
        out = out | text.startswith(p)
    return out


def dispatch_like(name: Column) -> Column:
    """A name that is likely wired at run time."""
    out, low = F.lit(False), F.lower(name)
    for w in DISPATCH_WORDS:
        out = out | low.contains(w)
    return out


def trunc(x: Column) -> Column:
    """Truncation toward zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")
