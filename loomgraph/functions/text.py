"""Column functions over task and output text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a task's keywords leave out.
TASK_SKIP = (
    "the", "and", "for", "from", "with", "this", "that", "fix", "add", "update", "remove", "change", "bug", "feature", "use", "make", "new", "when", "not", "all", "can",
    "should", "would", "into", "also", "file", "function", "method", "class", "code", "need", "want", "like", "just", "please", "help", "how", "what", "why", "where",
)
TASK_TYPES = ("changelocal", "debug", "bugfix")


def task_keywords(text: Column) -> Column:
    """Identifier-like words of a task, each once whatever its case, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-zA-Z0-9]+|[a-z_][a-z0-9_]{2,})(?![\p{L}\p{N}_])"), 1)
    kept = F.filter(found, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*TASK_SKIP))
    lows = F.transform(kept, F.lower)
    return F.filter(kept, lambda w, i: F.array_position(lows, F.lower(w)) == i + 1)


def is_change_task(text: Column, task_type: Column) -> Column:
    """A pull request title, commit message or issue reference."""
    low = F.lower(text)
    return F.coalesce(
        task_type.isin(*TASK_TYPES) | low.contains("merge pull request") | low.startswith("merge branch '") | low.rlike(r"^(fix|feat|refactor|chore|perf|style|build|ci|docs|test)(\(.+\))?:")
        | text.rlike(r"\(#\d+\)\s*$") | text.rlike(r"^\w.*#\d+"),
        F.lit(False),
    )


def focus_ranges(text: Column) -> Column:
    """Structs (file, first, last) of the file:first-last marks in an output."""
    pattern = F.lit(r"— (\S+):(\d+)-(\d+)")
    parts = [F.regexp_extract_all(text, pattern, i) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("file", "first", "last"))]), lambda x: F.struct(x["file"].alias("file"), x["first"].cast("int").alias("first"), x["last"].cast("int").alias("last")))


def hunk_lines(diff: Column) -> Column:
    """The new line numbers of a unified diff's hunks; a hunk without a length has one line, one of length 0 none."""
    pattern = F.lit(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
    starts, counts = F.regexp_extract_all(diff, pattern, 1), F.regexp_extract_all(diff, pattern, 2)
    count = lambda c: F.when(c == "", 1).otherwise(c.cast("int"))
    spans = F.zip_with(starts, counts, lambda s, c: F.when(count(c) > 0, F.sequence(s.cast("int"), s.cast("int") + count(c) - 1)).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(spans))


def token_estimate(text: Column) -> Column:
    """A declared approximation: a token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


# Letters whose capital is one other character in the simple case mapping and several in the full one.
_SINGLE = {"ß": "ẞ", **{chr(c): chr(c + 8) for r in (0x1F80, 0x1F90, 0x1FA0) for c in range(r, r + 8)}, "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"}


def simple_upper(text: Column) -> Column:
    """text in capitals by the simple case mapping, which keeps one character for each; upper would write SS for ß.

    Texts without letters of several capitals, known by their length or by those of _SINGLE, go to upper at once.
    """
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))))
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(each, ""))
