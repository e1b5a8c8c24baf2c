"""The code graph: relations, their schemas and derived adjacency."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Domain values of the relations.
SYMBOL_KINDS = (
    "module", "class", "function", "method", "variable", "constant", "interface", "type_alias", "enum", "enum_member", "property",
    "field", "struct", "trait", "impl", "component", "hook", "route", "command", "test", "unknown",
)
EDGE_KINDS = ("contains", "imports", "calls", "inherits", "implements", "renders", "references", "uses_type", "exports", "overrides")

SYMBOL_SCHEMA = (
    "id string, name string, qualified_name string, kind string, language string, file_path string, line_start int, line_end int, "
    "signature string, doc string, parent_id string, exported boolean, complexity int, byte_size long"
)
EDGE_SCHEMA = "kind string, source_id string, target_id string, line int"


def file_of(identifier) -> F.Column:
    """The file of a symbol id path::name, null for other endpoints."""
    return F.when(F.instr(identifier, "::") > 0, F.substring_index(identifier, "::", 1))


@dataclass
class CodeGraph:
    """symbols, edges and commit_files of one or many repositories.

    The relations are DataFrames; whoever builds the graph decides what is
    persisted.  Adjacency is derived lazily, with duplicates removed where the
    semantics of a relation want that.
    """

    symbols: DataFrame
    edges: DataFrame
    commit_files: DataFrame | None = None

    @cached_property
    def files(self) -> DataFrame:
        """file_path, n_symbols, line_count, complexity and byte_size of symbol-bearing files."""
        return self.symbols.groupBy("file_path").agg(
            F.count("*").alias("n_symbols"), F.max("line_end").alias("line_count"), F.sum("complexity").alias("complexity"), F.sum("byte_size").alias("byte_size")
        )

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def pairs(self, *kinds: str) -> DataFrame:
        """Distinct source_id, target_id of edges of some kinds."""
        return self.of_kind(*kinds).select("source_id", "target_id").distinct()

    @cached_property
    def calls(self) -> DataFrame:
        """Distinct calls between known symbols: source_id, target_id, source_file, target_file."""
        known = self.symbols.select(F.col("id"), F.col("file_path"))
        return (
            self.pairs("calls")
            .join(known.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file")), "source_id")
            .join(known.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file")), "target_id")
        )

    @cached_property
    def imports(self) -> DataFrame:
        """Distinct imports between files: source_id, target_id."""
        return self.pairs("imports")

    def validated(self) -> CodeGraph:
        """Unknown edge kinds are dropped; unknown symbol kinds become 'unknown'."""
        kind = F.when(F.col("kind").isin(*SYMBOL_KINDS), F.col("kind")).otherwise("unknown")
        return CodeGraph(self.symbols.withColumn("kind", kind), self.of_kind(*EDGE_KINDS), self.commit_files)
