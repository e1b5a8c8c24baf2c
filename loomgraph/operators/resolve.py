"""Resolution of imports to files and of names to symbols, as joins with a ranked choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CodeGraph
from ..session import step_folder, written

# What follows an import's path to make a file, by order of preference, and kinds of edges and owners that names resolve for.
JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
PY_SUFFIXES = (".py", "/__init__.py")
RESOLVED = ("calls", "inherits", "implements", "renders", "uses_type")
#: A name is hot when it is asked for by at least this share of all requests.
HOT = 1 / 1000
OWNERS = ("class", "interface", "struct", "enum", "module", "trait")


def _normal(parts: Column) -> Column:
    """Path segments without '.' and with '..' applied."""
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when((x == ".") | (x == ""), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )


def _folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, text, target of import texts that lead to a known file, the most preferred one.

    Each text gives a short list of candidate paths, which is joined to the
    files; package imports of JavaScript go by the file's stem, the greatest path winning.
    """
    js = F.regexp_extract("text", r"""from\s+['"]([^'"]+)['"]""", 1)
    py = F.regexp_extract("text", r"^\s*from\s+(\S+)\s+import\s", 1)
    rust = F.regexp_extract("text", r"^\s*(?:pub\s+)?use\s+(?:crate::)?([\w:]+)", 1)
    dots = F.length(F.regexp_extract(py, r"^(\.*)", 1))
    here = _folder(F.col("file_path"))
    up = F.slice(here, 1, F.greatest(F.size(here) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    rest = F.split(F.regexp_replace(py, r"^\.+", ""), r"\.")
    module = F.when(dots > 0, F.concat(up, F.filter(rest, lambda x: x != ""))).otherwise(rest)

    def paths(base: Column, suffixes: tuple[str, ...]) -> Column:
        return F.array(*[F.concat(F.array_join(base, "/"), F.lit(s)) for s in suffixes])

    segments = F.split(rust, "::")
    root = F.when(F.col("file_path").startswith("src-tauri/"), "src-tauri/src").otherwise("src")
    deep = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(segments))), lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda s: F.concat(root, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"), s))))
    candidates = (
        F.when((js != "") & js.startswith("."), paths(_normal(F.concat(here, F.split(js, "/"))), JS_SUFFIXES)).when(js != "", F.array(F.concat(F.lit("stem:"), F.substring_index(js, "/", -1))))
        .when(py != "", paths(module, PY_SUFFIXES)).when(rust != "", deep)
    )
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    known = files.select("path", F.col("path").alias("_c")).unionByName(files.groupBy(F.concat(F.lit("stem:"), stem).alias("_c")).agg(F.max("path").alias("path")))
    rows = imports.select("file_path", "text", F.posexplode(candidates).alias("_p", "_c")).join(known, "_c")
    return rows.groupBy("file_path", "text").agg(F.min_by("path", "_p").alias("target"))


def import_edges(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports edges from file to file, and calls edges from a file to the symbols that a Python import names."""
    named = F.regexp_extract("text", r"^\s*from\s+\S+\s+import\s+\(?([^)]*)\)?", 1)
    names = F.transform(F.split(named, ","), lambda x: F.trim(F.split(x, r"\s+as\s+")[0]))
    files = targets.select(F.lit("imports").alias("kind"), F.col("file_path").alias("source_id"), F.col("target").alias("target_id"), F.lit(0).alias("line"))
    ids = targets.select("file_path", "target", F.explode(names).alias("name")).select("file_path", F.concat_ws("::", "target", "name").alias("id")).join(symbols.select("id"), "id", "left_semi")
    return files.unionByName(ids.select(F.lit("calls").alias("kind"), F.col("file_path").alias("source_id"), F.col("id").alias("target_id"), F.lit(0).alias("line")))


def imported_names(imports: DataFrame) -> DataFrame:
    """file_path, name: what a file's import texts bring into scope."""
    inner = F.coalesce(F.nullif(F.regexp_extract("text", r"import\s+\(?([\w\s,.*]+)\)?", 1), F.lit("")), F.regexp_extract("text", r"\{([^}]*)\}", 1))
    names = F.transform(F.split(inner, ","), lambda x: F.trim(F.split(x, r"\s+as\s+")[0]))
    return imports.select("file_path", F.explode(names).alias("name")).where("name rlike '^[A-Za-z_]\\\\w*$'").distinct()


def _joined(rows: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """rows inner joined with single, which has one row for each key; keys of at least HOT of all rows, of which there are few, are broadcast, so no task gets all rows of a common name."""
    at = step_folder(rows.sparkSession)
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("_rows")), f"{at}/sizes")
    most = sizes.agg(F.sum("_rows")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("_rows") >= max(2.0, HOT * most)).select(key))
    head = rows.join(hot, key, "left_semi").join(F.broadcast(single.join(hot, key, "left_semi")), key)
    return head.unionByName(rows.join(hot, key, "left_anti").join(single, key))


def _lookups(symbols: DataFrame) -> DataFrame:
    """_n (a name or qualified name), id, name, file_path, exported."""
    named = symbols.select(F.col("name").alias("_n"), "id", "name", "file_path", "exported")
    return named.unionByName(symbols.where("qualified_name <> name").select(F.col("qualified_name").alias("_n"), "id", "name", "file_path", "exported"))


def picked(requests: DataFrame, symbols: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """_f, _n, id: for each file and name asked for, the best symbol of that name; names that no symbol has are left out.

    The order of preference is a symbol of the file itself, an imported name in an
    imported file, an imported name, an imported file, an exported symbol, any; of
    equals the least id.  Symbols are reduced to the least id of a name, of a name
    and file, and of a name and own name before they meet any request.
    """
    at = step_folder(symbols.sparkSession)
    named = written(_lookups(symbols), f"{at}/named")
    requests = written(requests.select("_f", "_n").distinct(), f"{at}/requests")
    first = named.groupBy("_n").agg(F.min("id").alias("any"), F.min(F.when(F.col("exported"), F.col("id"))).alias("open"))
    in_file = written(named.groupBy("_n", "file_path", "name").agg(F.min("id").alias("id")), f"{at}/in_file")
    by_name = named.groupBy("_n", "name").agg(F.min("id").alias("id"))
    known = written(_joined(requests, first, "_n"), f"{at}/known")
    asked = known.select("_f", "_n")
    scope = imports.select(F.col("file_path").alias("_f"), F.col("target").alias("file_path")).distinct()
    seen = names.select(F.col("file_path").alias("_f"), "name").distinct().withColumn("_seen", F.lit(True))
    own = asked.join(in_file, (F.col("_f") == in_file["file_path"]) & (asked["_n"] == in_file["_n"])).select("_f", asked["_n"], F.lit(0).alias("_o"), "id")
    through = asked.join(scope, "_f").join(in_file, ["_n", "file_path"]).join(seen, ["_f", "name"], "left").select("_f", "_n", F.when(F.col("_seen"), 1).otherwise(3).alias("_o"), "id")
    # an imported name: a request for the name itself, or for a qualified name of a symbol of that name
    plain = asked.join(seen.withColumnRenamed("name", "_n"), ["_f", "_n"]).join(by_name.where("_n = name").select("_n", "id"), "_n").select("_f", "_n", F.lit(2).alias("_o"), "id")
    longer = asked.where(F.instr("_n", ".") > 0).join(by_name.where("_n <> name"), "_n").join(seen, ["_f", "name"]).select("_f", "_n", F.lit(2).alias("_o"), "id")
    rest = known.select("_f", "_n", F.when(F.col("open").isNotNull(), 4).otherwise(5).alias("_o"), F.coalesce("open", "any").alias("id"))
    every = own.unionByName(through).unionByName(plain).unionByName(longer).unionByName(rest)
    return every.groupBy("_f", "_n").agg(F.min(F.struct("_o", "id"))["id"].alias("id"))


def _kin(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """class, kin, _v: the parents (3), children (4) and siblings (5, other parents of a child) of classes; a parent that isn't known by one symbol alone stays a name."""
    one = _lookups(symbols).groupBy("_n").agg(F.count("*").alias("_c"), F.min("id").alias("_id")).where("_c = 1")
    edges = rows.where("kind = 'inherits'").select("source_id", "target_id").distinct().join(one.select(F.col("_n").alias("target_id"), "_id"), "target_id", "left")
    up = edges.select(F.col("source_id").alias("class"), F.when(F.instr("target_id", "::") > 0, F.col("target_id")).otherwise(F.coalesce("_id", "target_id")).alias("kin")).distinct()
    up = written(up, f"{step_folder(symbols.sparkSession)}/up")
    down = up.select(F.col("kin").alias("class"), F.col("class").alias("kin"))
    beside = down.withColumnRenamed("kin", "_child").join(up.select(F.col("class").alias("_child"), "kin"), "_child").where("kin <> class").select("class", "kin").distinct()
    return up.withColumn("_v", F.lit(3)).unionByName(down.withColumn("_v", F.lit(4))).unionByName(beside.withColumn("_v", F.lit(5)))


def self_targets(own: DataFrame, rows: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For calls (_f, _class, _b) of a method of self: what they find by id (_class, _b, _w, id), and by a qualified name that is looked up (_class, _b, _w, _n).

    A class's own method comes first (1), then one of a class of its name (2), and
    those of its kin in order (3 to 5; of several the first that has the method, by
    id, its own before one of its name).
    """
    at = step_folder(symbols.sparkSession)
    asked = written(own.select("_class", "_b").distinct(), f"{at}/asked")
    # methods by the id of their class, and by its name
    dotted = symbols.where(F.instr(F.substring_index("id", "::", -1), ".") > 0)
    exact = written(dotted.select(F.regexp_replace("id", r"\.[^.]*$", "").alias("kin"), F.substring_index("id", ".", -1).alias("_b"), "id").groupBy("kin", "_b").agg(F.min("id").alias("id")), f"{at}/exact")
    spoken = _lookups(symbols).where(F.instr("_n", ".") > 0).select("_n").distinct()
    spoken = written(spoken.select(F.regexp_replace("_n", r"\.[^.]*$", "").alias("_cn"), F.substring_index("_n", ".", -1).alias("_b"), "_n"), f"{at}/spoken")
    name = F.substring_index("kin", "::", -1)
    itself = asked.select(F.col("_class").alias("class"), F.col("_class").alias("kin"), F.lit(1).alias("_v")).distinct()
    kin = written(itself.unionByName(_kin(rows, symbols).join(asked.select(F.col("_class").alias("class")).distinct(), "class", "left_semi")), f"{at}/kin")
    by_id = kin.join(exact, "kin").select(F.col("class").alias("_class"), "_b", F.struct(F.col("_v").alias("v"), "kin", F.lit(0).alias("how")).alias("_w"), "id", F.lit(None).cast("string").alias("_n"))
    by_name = kin.withColumn("_cn", name).join(spoken, "_cn").select(F.col("class").alias("_class"), "_b", F.struct(F.when(F.col("_v") == 1, 2).otherwise(F.col("_v")).alias("v"), "kin", F.lit(1).alias("how")).alias("_w"), F.lit(None).cast("string").alias("id"), "_n")
    best = by_id.unionByName(by_name).join(asked, ["_class", "_b"], "left_semi").groupBy("_class", "_b").agg(F.min(F.struct("_w", "id", "_n")).alias("_m"))
    best = written(best.select("_class", "_b", F.col("_m._w.v").alias("_w"), "_m.id", "_m._n"), f"{at}/best")
    return best.where("id is not null").drop("_n"), best.where("id is null").drop("id")


def resolve_names(edges: DataFrame, symbols: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """edges with symbolic targets replaced by the id of the best candidate; others stay as they are.

    imports: file_path, target (files); names: file_path, name.  Candidates are
    symbols of that name or qualified name, picked by `picked`.  Methods of self go
    by the class of the source, then by its kin (`self_targets`), then by a symbol
    of the method's name in the file; Type.method goes by the method's name where
    Type is a known type.  The first of these that finds something counts.  Edges
    are resolved once for each source and target, by these themselves.
    """
    at = step_folder(symbols.sparkSession)
    symbolic = F.col("kind").isin(*RESOLVED) & (F.instr("target_id", "::") == 0)
    source_file, inner = F.substring_index("source_id", "::", 1), F.substring_index("source_id", "::", -1)
    wanted = edges.where(symbolic).select("source_id", "target_id").distinct().select(
        "source_id", "target_id", source_file.alias("_f"), F.regexp_extract("target_id", r"^(.*)\.[^.]*$", 1).alias("_q"), F.substring_index("target_id", ".", -1).alias("_b"),
        F.when((F.instr("source_id", "::") > 0) & (F.instr(inner, ".") > 0), F.concat(source_file, F.lit("::"), F.substring_index(inner, ".", 1))).alias("_class"),
    )
    wanted = written(wanted, f"{at}/wanted")
    key = ["source_id", "target_id"]
    own = wanted.where("_q in ('self', 'cls') and _class is not null")
    by_id, by_name = self_targets(own, edges, symbols)
    types = _lookups(symbols.where(F.col("kind").isin(*OWNERS))).select(F.col("_n").alias("_q")).distinct()
    # what is looked up by name, in order: the target itself, qualified names of a method of self, the method of a type
    asks = wanted.select(*key, "_f", F.col("target_id").alias("_n"), F.lit(0).alias("_w"))
    asks = asks.unionByName(own.join(by_name, ["_class", "_b"]).select(*key, "_f", "_n", "_w"))
    asks = written(asks.unionByName(wanted.where("_q <> ''").join(types, "_q", "left_semi").select(*key, "_f", F.col("_b").alias("_n"), F.lit(7).alias("_w"))), f"{at}/asks")
    answers = asks.join(picked(asks, symbols, imports, names), ["_f", "_n"]).select(*key, "_w", "id")
    near = _lookups(symbols).groupBy(F.col("_n").alias("_b"), F.col("file_path").alias("_f")).agg(F.min("id").alias("id"))
    answers = answers.unionByName(own.join(by_id, ["_class", "_b"]).select(*key, "_w", "id")).unionByName(own.join(near, ["_b", "_f"]).select(*key, F.lit(6).alias("_w"), "id"))
    best = answers.groupBy(*key).agg(F.min(F.struct("_w", "id"))["id"].alias("_id"))
    return edges.where(symbolic).join(best, key, "left").select("kind", "source_id", F.coalesce("_id", "target_id").alias("target_id"), "line").unionByName(edges.where(~symbolic).select("kind", "source_id", "target_id", "line"))


def build(extracted: DataFrame) -> CodeGraph:
    """The code graph of extract()'s rows: imports and names resolved."""
    from ..sources.extract import relations

    symbols, edges, imports = relations(extracted)
    targets = import_targets(imports, extracted.select("path"))
    every = edges.unionByName(import_edges(targets, symbols))
    scope = targets.select("file_path", "target").distinct()
    return CodeGraph(symbols, resolve_names(every, symbols, scope, imported_names(imports))).validated()


def unresolved(g: CodeGraph) -> DataFrame:
    """The graph's calls with targets reduced to names without their number: an input with many candidates for each name."""
    names = g.symbols.select(F.col("id").alias("target_id"), F.regexp_replace("name", r"_\d+$", "").alias("_t"))
    return g.of_kind("calls").join(names, "target_id").select("kind", "source_id", F.col("_t").alias("target_id"), "line")


def members(g: CodeGraph) -> CodeGraph:
    """The graph with names less their numbers, methods below their classes, and calls as sources write them: each method calls the next method of its module as a method of self, and as one of its own class."""
    short = F.regexp_replace("name", r"_\d+$", "")
    parent = F.col("parent_id").isNotNull()
    rows = g.symbols.select(
        F.when(parent, F.concat("parent_id", F.lit("."), short)).otherwise(F.col("id")).alias("id"), short.alias("name"),
        F.when(parent, F.concat(F.substring_index("parent_id", "::", -1), F.lit("."), short)).otherwise(F.substring_index("id", "::", -1)).alias("qualified_name"),
        "kind", "file_path", "exported", "parent_id", "seq", F.substring_index("file_path", "/", 1).alias("module"),
    )
    following = F.lead("name").over(W.partitionBy("module").orderBy("seq"))
    calls = rows.where(parent).withColumn("_next", following).where("_next is not null")
    own = F.substring_index("parent_id", "::", -1)
    named = lambda target: calls.select(F.lit("calls").alias("kind"), F.col("id").alias("source_id"), target.alias("target_id"), F.lit(1).alias("line"))
    edges = named(F.concat(F.lit("self."), "_next")).unionByName(named(F.concat(own, F.lit("."), "_next"))).distinct()
    symbols = rows.drop("seq", "module").dropDuplicates(["id"])
    return CodeGraph(symbols, edges.unionByName(g.of_kind("inherits").select("kind", "source_id", "target_id", "line")))


def resolved_members(g: CodeGraph, of_self: bool) -> DataFrame:
    """source_id, target_id (as written) and id of the calls of members(): those of self, or the others."""
    m = members(g)
    calls = m.of_kind("calls").where(F.startswith("target_id", F.lit("self.")) if of_self else ~F.startswith("target_id", F.lit("self.")))
    at = step_folder(g.edges.sparkSession)
    # a call is known again by a number in its line's place
    numbered = written(calls.withColumn("line", F.pmod(F.xxhash64("source_id", "target_id"), F.lit(1 << 31)).cast("int")), f"{at}/calls")
    scope = g.imports.select(F.col("source_id").alias("file_path"), F.col("target_id").alias("target"))
    none = g.edges.sparkSession.createDataFrame([], "file_path string, name string")
    done = resolve_names(numbered.unionByName(m.of_kind("inherits")), written(m.symbols, f"{at}/symbols"), scope, none).where("kind = 'calls'")
    same = done.select("source_id", "line", F.col("target_id").alias("id"))
    return numbered.select("source_id", "target_id", "line").join(same, ["source_id", "line"]).drop("line")
