"""Source text to symbols, edges and imports: Python by its syntax tree, other languages by tables of patterns.

Fidelity: Python follows the syntax tree.  The other languages are read line by
line, so symbols and their nesting come from declarations that start a line, and
calls from names before a parenthesis; macros, multi-line headers and
declarations within strings aren't understood.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, SYMBOL_SCHEMA
from ..session import ship

# Languages by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "swift": "swift", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "dart": "dart", "lua": "lua", "sh": "bash", "bash": "bash", "r": "r", "jl": "julia", "ex": "elixir", "exs": "elixir",
    "erl": "erlang", "hs": "haskell", "clj": "clojure", "fs": "fsharp", "ml": "ocaml", "zig": "zig",
}
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|open|override|export|default|async|pub(?:\([a-z]+\))?|unsafe|inline|virtual|sealed|data|suspend|mutating|partial|readonly|const)\s+)*"

# Declarations of each language, as (kind, pattern of a line; group name).
_C_LIKE = [("class", rf"^\s*{_MODIFIERS}class\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODIFIERS}interface\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODIFIERS}enum\s+(?:class\s+)?(?P<name>\w+)"), ("struct", rf"^\s*{_MODIFIERS}struct\s+(?P<name>\w+)")]
_JS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*[=<]"),
    ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("constant", r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]+)\s*[:=]"),
    ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>(?!(?:if|for|while|switch|return|function|catch)\b)\w+)\s*\([^)]*\)\s*(?::[^{]+)?\{"),
]
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS, "typescript": _JS,
    "go": [("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("struct", r"^type\s+(?P<name>\w+)\s+struct"), ("interface", r"^type\s+(?P<name>\w+)\s+interface"), ("constant", r"^const\s+(?P<name>\w+)"), ("variable", r"^var\s+(?P<name>\w+)")],
    "rust": [("function", rf"^\s*{_MODIFIERS}fn\s+(?P<name>\w+)"), ("struct", rf"^\s*{_MODIFIERS}struct\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODIFIERS}enum\s+(?P<name>\w+)"), ("trait", rf"^\s*{_MODIFIERS}trait\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"), ("module", rf"^\s*{_MODIFIERS}mod\s+(?P<name>\w+)"), ("constant", rf"^\s*{_MODIFIERS}(?:const|static)\s+(?P<name>[A-Z_0-9]+)\s*:")],
    "java": [*_C_LIKE, ("method", rf"^\s+{_MODIFIERS}(?!return|new|else|throw)[\w<>\[\], ?]+\s+(?P<name>\w+)\s*\([^;]*\{{")],
    "kotlin": [*_C_LIKE, ("function", rf"^\s*{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)")],
    "scala": [*_C_LIKE, ("class", r"^\s*(?:case\s+)?(?:class|object)\s+(?P<name>\w+)"), ("interface", r"^\s*trait\s+(?P<name>\w+)"), ("function", r"^\s*(?:override\s+)?def\s+(?P<name>\w+)")],
    "swift": [*_C_LIKE, ("interface", r"^\s*(?:public\s+)?protocol\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODIFIERS}func\s+(?P<name>\w+)")],
    "csharp": [*_C_LIKE, ("method", rf"^\s+{_MODIFIERS}(?!return|new|else|throw)[\w<>\[\], ?]+\s+(?P<name>\w+)\s*\([^;]*$")],
    "ruby": [("class", r"^\s*class\s+(?P<name>\w+)"), ("module", r"^\s*module\s+(?P<name>\w+)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)")],
    "php": [*_C_LIKE, ("trait", r"^\s*trait\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODIFIERS}function\s+(?P<name>\w+)")],
    "c": [("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?P<name>\w+)"), ("function", r"^(?!else|return|typedef|#)[\w*\s]+?\b(?P<name>\w+)\s*\([^;]*\)\s*\{")],
    "cpp": [*_C_LIKE, ("function", r"^(?!else|return|typedef|#)[\w*&:<>\s]+?\b(?P<name>\w+)\s*\([^;]*\)\s*(?:const\s*)?\{")],
    "dart": [*_C_LIKE, ("function", r"^\s*(?!return|if|for|while|else)[\w<>?]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+(?:\w+[.:])?(?P<name>\w+)")],
    "bash": [("function", r"^\s*(?:function\s+)?(?P<name>\w+)\s*\(\)\s*\{?"), ("constant", r"^(?:readonly\s+|export\s+)?(?P<name>[A-Z][A-Z0-9_]+)=")],
    "r": [("function", r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(")],
    "julia": [("function", r"^\s*function\s+(?P<name>\w+!?)"), ("struct", r"^\s*(?:mutable\s+)?struct\s+(?P<name>\w+)"), ("module", r"^\s*module\s+(?P<name>\w+)")],
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)")],
    "erlang": [("function", r"^(?P<name>[a-z]\w*)\s*\([^)]*\)\s*(?:when[^-]*)?->")],
    "haskell": [("type_alias", r"^(?:data|newtype|type)\s+(?P<name>\w+)"), ("interface", r"^class\s+(?:.*=>\s*)?(?P<name>\w+)"), ("function", r"^(?P<name>[a-z]\w*)\s*::")],
    "clojure": [("function", r"^\s*\(defn-?\s+(?P<name>[^\s\[]+)"), ("interface", r"^\s*\(defprotocol\s+(?P<name>\S+)"), ("class", r"^\s*\(def(?:record|type)\s+(?P<name>\S+)")],
    "fsharp": [("module", r"^\s*module\s+(?P<name>[\w.]+)"), ("type_alias", r"^\s*type\s+(?P<name>\w+)"), ("function", r"^\s*let\s+(?:rec\s+)?(?P<name>\w+)\s+[^=]+=")],
    "ocaml": [("module", r"^\s*module\s+(?P<name>\w+)"), ("type_alias", r"^\s*type\s+(?P<name>\w+)"), ("function", r"^\s*let\s+(?:rec\s+)?(?P<name>\w+)\s+[^=]+=")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(?P<name>\w+)"), ("struct", r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*struct"), ("enum", r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*enum")],
}
_IMPORT = re.compile(r"""^\s*(?:import\b.*|from\s+\S+\s+import\b.*|export\s+.*\bfrom\s+['"].*|(?:pub\s+)?use\s+[\w:]+.*|#include\s+.*|require(?:_relative)?\s+['"].*|using\s+[\w.]+;|(?:const|let|var)\s+.*=\s*require\(.*)""")
_BASES = re.compile(r"\b(?P<how>extends|implements|:|<)\s*(?P<names>[\w.,\s]+?)\s*(?:\{|$|implements)")
_CALL = re.compile(r"(?<![\w.])(?:(?P<of>self|this|[A-Za-z_]\w*)\.)?(?P<name>[A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset((
    "if", "for", "while", "switch", "return", "catch", "function", "fn", "def", "func", "new", "print", "println", "len", "range", "str", "int", "float", "list", "dict",
    "set", "super", "elif", "match", "with", "assert", "sizeof", "typeof", "defined", "fun", "class", "struct", "enum",
))
_BRANCH = re.compile(r"\b(?:if|elif|else if|for|while|case|catch|except|when|rescue)\b|&&|\|\||\?(?=[^.:?])")
_JSX = re.compile(r"<(?P<name>[A-Z]\w*)[\s/>]")


@dataclass
class Found:
    path: str
    language: str
    symbols: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)

    def add(self, name: str, kind: str, first: int, last: int, signature: str, doc: str, parent: str | None, exported: bool, complexity: int, size: int) -> str:
        qualified = f"{parent.split('::', 1)[1]}.{name}" if parent else name
        ident = f"{self.path}::{qualified}"
        self.symbols.append((ident, name, qualified, kind, self.language, self.path, first, last, signature[:200], doc[:200], parent, exported, complexity, size))
        if parent:
            self.edges.append(("contains", parent, ident, first))
        return ident


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else ""


class _Python(ast.NodeVisitor):
    def __init__(self, found: Found, lines: list[str]):
        self.found, self.lines, self.owner, self.scope, self.public = found, lines, None, None, None

    def _exported(self, name: str) -> bool:
        if self.owner:
            return True
        return name in self.public if self.public is not None else not name.startswith("_")

    def _complexity(self, node: ast.AST) -> int:
        kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension, ast.match_case)
        n = 1
        for x in ast.walk(node):
            n += isinstance(x, kinds) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
        return n

    def _add(self, node, kind: str, complexity: int) -> str:
        first, last = node.lineno, node.end_lineno or node.lineno
        text = "\n".join(self.lines[first - 1 : last])
        doc = (ast.get_docstring(node) or "").split("\n")[0]
        return self.found.add(node.name, kind, first, last, self.lines[first - 1].strip().rstrip(":"), doc, self.owner, self._exported(node.name), complexity, len(text.encode()))

    def visit_Module(self, node: ast.Module) -> None:
        for x in node.body:
            if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
                self.public = {e.value for e in x.value.elts if isinstance(e, ast.Constant)}
        self.generic_visit(node)

    def _within(self, ident: str, node, owner: str | None) -> None:
        before = self.scope, self.owner
        self.scope, self.owner = ident, owner
        for x in node.body:
            self.visit(x)
        self.scope, self.owner = before

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        ident = self._add(node, "class", 1)
        for base in node.bases:
            if name := _dotted(base):
                self.found.edges.append(("inherits", ident, name, node.lineno))
        self._decorators(node, ident)
        self._within(ident, node, ident)

    def _decorators(self, node, ident: str) -> list[str]:
        names = [_dotted(d) for d in node.decorator_list]
        for d, name in zip(node.decorator_list, names):
            if name:
                self.found.edges.append(("calls", name, ident, d.lineno))
        return names

    def visit_FunctionDef(self, node) -> None:
        names = [_dotted(d) for d in node.decorator_list]
        kind = "method" if self.owner else "function"
        if any(n.endswith(".route") for n in names):
            kind = "route"
        elif node.name.startswith("test_") or any("pytest.mark" in n for n in names):
            kind = "test"
        elif "property" in names:
            kind = "property"
        elif {"staticmethod", "classmethod"} & set(names):
            kind = "function"
        ident = self._add(node, kind, self._complexity(node))
        self._decorators(node, ident)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self._types(a.annotation, ident)
        self._types(node.returns, ident)
        self._within(ident, node, None if self.owner is None else self.owner)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _types(self, node, ident: str) -> None:
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, ast.Name) and x.id[:1].isupper():
                self.found.edges.append(("uses_type", ident, x.id, x.lineno))

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name and name.rsplit(".", 1)[-1] not in _NOT_CALLS:
            self.found.edges.append(("calls", self.scope or self.found.path, name, node.lineno))
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if self.scope is None:
            for t in node.targets:
                if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                    last = node.end_lineno or node.lineno
                    self.found.add(t.id, "constant", node.lineno, last, self.lines[node.lineno - 1].strip(), "", None, self._exported(t.id), 1, 0)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        self.found.imports.append(ast.unparse(node))

    visit_ImportFrom = visit_Import


def _lines(found: Found, text: str) -> None:
    """Symbols, calls and imports by the language's patterns; blocks nest by indentation."""
    rules = [(k, re.compile(p)) for k, p in PATTERNS.get(found.language, ())]
    lines = text.split("\n")
    open_: list[tuple[int, str, str]] = []  # indentation, id, kind
    starts: list[tuple[int, int, str, str, str | None, bool]] = []
    js = found.language in ("javascript", "typescript")
    for i, line in enumerate(lines, 1):
        if not line.strip():
            continue
        if _IMPORT.match(line):
            found.imports.append(line.strip())
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0] and line.strip() not in ("}", "end", "};", ")"):
            open_.pop()
        hit = next(((k, m) for k, r in rules if (m := r.match(line))), None)
        if hit and hit[1]["name"] not in _NOT_CALLS:
            kind, name = hit[0], hit[1]["name"]
            owner = next((o for o in reversed(open_) if o[2] in ("class", "interface", "struct", "trait", "impl", "module", "enum")), None)
            if owner and kind == "function":
                kind = "method"
            if js and kind == "function":
                kind = "component" if name[0].isupper() and found.path.endswith(("x",)) else "hook" if re.match("use[A-Z]", name) else kind
            exported = (
                ("export" in line or owner is not None) if js else name[0].isupper() if found.language == "go" else "pub" in line if found.language == "rust"
                else "public" in line if found.language in ("java",) else not name.startswith("_") and "private" not in line
            )
            last = next((j for j in range(i + 1, len(lines) + 1) if lines[j - 1].strip() and len(lines[j - 1]) - len(lines[j - 1].lstrip()) <= indent), len(lines)) if kind not in ("constant", "variable", "type_alias") else i
            body = "\n".join(lines[i - 1 : last])
            comment = lines[i - 2].strip() if i > 1 and re.match(r"\s*(//|#|--|;|\*|///)", lines[i - 2]) else ""
            ident = found.add(name, kind, i, max(i, last), line.strip().rstrip("{").strip(), comment.lstrip("/#-*; "), owner[1] if owner else None, exported, 1 + len(_BRANCH.findall(body)), len(body.encode()))
            if kind in ("class", "interface", "struct") and (b := _BASES.search(line[hit[1].end() :])):
                how = "implements" if b["how"] == "implements" else "inherits"
                found.edges += [(how, ident, n.strip(), i) for n in b["names"].split(",") if n.strip()]
                if how == "inherits" and "implements" in line:
                    found.edges += [("implements", ident, n.strip(), i) for n in line.split("implements", 1)[1].rstrip(" {").split(",") if n.strip()]
            open_.append((indent, ident, kind))
            rest = line[hit[1].end() :]
        else:
            rest = line
        scope = next((o[1] for o in reversed(open_) if o[2] not in ("class", "interface", "struct", "enum", "module", "impl", "trait")), found.path)
        for m in _CALL.finditer(rest):
            if m["name"] not in _NOT_CALLS:
                of = {"this": "self"}.get(m["of"], m["of"])
                found.edges.append(("calls", scope, f"{of}.{m['name']}" if of else m["name"], i))
        if js:
            found.edges += [("renders", scope, m["name"], i) for m in _JSX.finditer(rest)]


def parse(path: str, content: bytes) -> Found | None:
    """What a file declares and refers to; None for unknown languages.  A file that can't be parsed has nothing."""
    language = language_of(path)
    if language is None:
        return None
    found, text = Found(path, language), content.decode("utf-8", "replace")
    if language == "python":
        try:
            _Python(found, text.split("\n")).visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return Found(path, language)
    else:
        _lines(found, text)
    return found


_SCHEMA = f"path string, language string, line_count int, hash string, symbols array<struct<{SYMBOL_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>>, edges array<struct<{EDGE_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>>, imports array<string>"


def extract(files: DataFrame) -> DataFrame:
    """files (path, content) to one row each: path, language, line_count, hash, symbols, edges, imports."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(_SCHEMA))
    symbol_names, edge_names = ([f.split(" ")[0] for f in s.split(", ")] for s in (SYMBOL_SCHEMA, EDGE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (f := parse(path, content or b"")) is not None:
                    content = content or b""
                    n = content.count(b"\n") + (bool(content) and not content.endswith(b"\n"))
                    rows.append({"path": path, "language": f.language, "line_count": n, "hash": hashlib.md5(content).hexdigest(), "symbols": [dict(zip(symbol_names, s)) for s in f.symbols], "edges": [dict(zip(edge_names, e)) for e in f.edges], "imports": f.imports})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def relations(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, edges and imports (file_path, text) of extract()'s rows."""
    return (
        extracted.select(F.inline("symbols")), extracted.select(F.inline("edges")), extracted.select(F.col("path").alias("file_path"), F.explode("imports").alias("text")),
    )
