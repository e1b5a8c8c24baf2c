"""What a rule is, and SQL conditions on names that Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    mode: str
    id: str
    scope: str
    condition: str
    least: int
    label: str

    @property
    def name(self) -> str:
        return f"{self.mode}.{self.id}"


def like(column: str, *patterns: str) -> str:
    """One of patterns, in which % at either end stands for any text; all other characters stand for themselves."""
    tests = []
    for p in patterns:
        text = p.strip("%")
        if p.startswith("%") and p.endswith("%"):
            tests.append(f"instr({column}, '{text}') > 0")
        elif p.startswith("%"):
            tests.append(f"right({column}, {len(text)}) = '{text}'")
        elif p.endswith("%"):
            tests.append(f"left({column}, {len(text)}) = '{text}'")
        else:
            tests.append(f"{column} = '{text}'")
    return f"({' OR '.join(tests)})"


def word(column: str, *words: str) -> str:
    """One of words alone, or as the first or last part of a name joined by underscores."""
    return like(column, *[p for w in words for p in (w, f"{w}_%", f"%_{w}")])


def has(column: str, *words: str) -> str:
    """One of words anywhere."""
    return like(column, *[f"%{w}%" for w in words])


FN = "kind IN ('function', 'method')"
SRC = "NOT is_test"
