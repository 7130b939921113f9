"""Outlines, lookups and context of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.lineage import cut, small


def repo_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(section, key, n): files per top directory and language, symbols per kind; largest first, then by name."""
    dirs = files.groupBy(text.top_dir("file").alias("key")).agg(F.count("*").alias("n")).select(F.lit("directory").alias("section"), "key", "n")
    langs = files.groupBy(F.coalesce("language", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("language").alias("section"), "key", "n")
    kinds = symbols.groupBy(F.coalesce("kind", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "key", "n")
    return dirs.unionByName(langs).unionByName(kinds).orderBy("section", F.desc("n"), "key")


def file_tree(files: DataFrame, symbols: DataFrame, prefix: str = "") -> DataFrame:
    """(path, parent, name, depth, type, language, symbol_count) of directories and files under a prefix, by path."""
    f = files.where(F.col("file").startswith(prefix)) if prefix else files
    n = symbols.groupBy("repo", "file").agg(F.count("*").alias("symbol_count"))
    leaf = f.join(n, ["repo", "file"], "left").select("repo", F.col("file").alias("path"), F.lit("file").alias("type"), "language", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"))
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = f.where(F.instr("file", "/") > 0).select("repo", F.explode(ups).alias("path")).distinct().select("repo", "path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("symbol_count"))
    out = leaf.unionByName(dirs)
    depth = F.size(F.split("path", "/"))
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return out.select("repo", "path", parent.alias("parent"), text.basename("path").alias("name"), depth.alias("depth"), "type", "language", "symbol_count").orderBy("repo", "path")


def file_outline(symbols: DataFrame, file: str, cap: int = 50) -> DataFrame:
    """Symbols of a file with their depth below each other (a parent that isn't in the file makes a root), by line."""
    s = cut(symbols.where(F.col("file") == file).select("id", "name", "kind", "signature", "summary", "parent", "line", "end_line", "ord"))
    ids = s.select(F.col("id").alias("parent")).distinct()
    front = s.join(ids, "parent", "left_anti").select("id", F.lit(0).alias("depth"))
    front = cut(front.unionByName(s.where("parent is null").select("id", F.lit(0).alias("depth"))).distinct())
    seen = front
    for d in range(1, cap + 1):
        front = cut(s.join(front.select(F.col("id").alias("parent")), "parent").join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return s.join(seen, "id").orderBy("line", "ord").select("id", "name", "kind", "signature", "summary", "parent", "line", "end_line", "depth")


def symbol_at(symbols: DataFrame, file: str, line: int) -> DataFrame:
    """The innermost symbol at a line of a file, the first in index order on ties."""
    return symbols.where((F.col("file") == file) & (F.col("line") <= line) & (F.col("end_line") >= line)).orderBy(F.col("end_line") - F.col("line"), "ord").limit(1)


def with_source(symbols: DataFrame, contents: DataFrame, context: int = 0, verify: bool = False) -> DataFrame:
    """symbols with `source` (their bytes, bad ones replaced), and on request lines around and `content_verified`."""
    whole = F.col("content")
    part = F.substring(whole, (F.col("byte_offset") + 1).cast("int"), F.col("byte_length").cast("int"))
    j = symbols.join(contents.select("repo", "file", "content"), ["repo", "file"], "left").withColumn("source", F.make_valid_utf8(part.cast("string")))
    if context > 0:
        all_lines = F.split(F.make_valid_utf8(whole.cast("string")), "\n")
        first = F.greatest(F.col("line") - 1 - context, F.lit(0))
        j = j.withColumn("context_before", F.array_join(F.slice(all_lines, first + 1, F.greatest(F.col("line") - 1 - first, F.lit(0))), "\n"))
        j = j.withColumn("context_after", F.array_join(F.slice(all_lines, F.col("end_line") + 1, context), "\n"))
    if verify:
        j = j.withColumn("content_verified", F.sha2(part, 256) == F.col("content_hash"))
    return j.drop("content")


def symbols_by_ids(symbols: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows for at most 50 asked ids in the order asked for, and the ids not found. More ids are an error."""
    if len(ids) > 50:
        raise ValueError("at most 50 ids")
    spark = symbols.sparkSession
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return symbols.join(F.broadcast(asked), "id").orderBy("pos"), asked.join(symbols.select("id"), "id", "left_anti").orderBy("pos")


def context(symbols: DataFrame, symbol_id: str, edges: DataFrame | None = None, cap: int = 20) -> DataFrame:
    """(role, id, name, kind, file, line) of a symbol, its siblings (same file and parent, by line) and parent.

    With edges (rel, src, dst) also its direct callers and callees and, of a class, all ancestors and descendants that are
    symbols; at most `cap` of each, the nearest first.
    """
    cols = ["id", "name", "kind", "file", "line"]
    one = symbols.where(F.col("id") == symbol_id).limit(1)
    t = F.broadcast(one.select(F.col("id").alias("t_id"), F.col("file").alias("t_file"), F.col("parent").alias("t_parent")))
    tag = lambda df, role, pos: df.select(F.lit(pos).alias("pos"), F.lit(role).alias("role"), *cols)
    out = tag(one, "symbol", 0).unionByName(tag(symbols.join(t, (symbols["id"] == F.col("t_parent"))), "parent", 1))
    out = out.unionByName(tag(symbols.join(t, (symbols["file"] == F.col("t_file")) & symbols["parent"].eqNullSafe(F.col("t_parent")) & (symbols["id"] != F.col("t_id"))), "sibling", 2))
    if edges is not None:
        for role, a, b, pos in (("caller", "dst", "src", 3), ("callee", "src", "dst", 4)):
            ids = edges.where(F.col("rel") == "calls").where(F.col(a) == symbol_id).select(F.col(b).alias("id")).distinct().orderBy("id").limit(cap)
            out = out.unionByName(tag(symbols.join(F.broadcast(ids), "id"), role, pos))
        if one.where("kind = 'class'").count():
            types = type_hierarchy(edges, symbols, symbol_id).withColumnRenamed("node", "id").where("kind is not null")
            for role, pos in (("ancestor", 5), ("descendant", 6)):
                out = out.unionByName(tag(types.where(F.col("direction") == role).orderBy("depth", "id").limit(cap), role, pos))
    return out.orderBy("pos", "line", "id").drop("pos")


def sibling_counts(rows: DataFrame, group: list[str], at: str) -> DataFrame:
    """rows with `siblings`, the other rows of the same group (columns `group`, null equal to null) at another place `at`,
    and `first_sibling`, the least such place. By counts and the two least places of each group, not by pairs of rows."""
    key = F.struct(*[F.col(g).alias(f"k{i}") for i, g in enumerate(group)])  # structs compare nulls as equal values
    place = rows.where(F.col(at).isNotNull()).groupBy(key.alias("_key"), F.col(at).alias("_at")).agg(F.count("*").alias("_c"))
    least = place.groupBy("_key").agg(F.sum("_c").alias("_n"), F.min("_at").alias("_least"))
    later = place.select(F.col("_key").alias("_key2"), "_at").join(least, F.col("_key2").eqNullSafe(F.col("_key"))).where("_at > _least").groupBy("_key2").agg(F.min("_at").alias("_next"))
    whole = least.join(later, F.col("_key").eqNullSafe(F.col("_key2")), "left").select(F.col("_key").alias("_key1"), "_n", "_least", "_next")
    own = place.select(F.col("_key").alias("_key3"), F.col("_at").alias("_at3"), "_c")
    j = rows.withColumn("_key", key).join(own, F.col("_key").eqNullSafe(F.col("_key3")) & (F.col(at) == F.col("_at3")), "left")
    j = j.join(whole, F.col("_key").eqNullSafe(F.col("_key1")) & F.col(at).isNotNull(), "left")
    first = F.when(F.col(at) == F.col("_least"), F.col("_next")).otherwise(F.col("_least"))
    return j.select(*[F.col(c) for c in rows.columns], F.coalesce(F.col("_n") - F.col("_c"), F.lit(0)).cast("long").alias("siblings"), first.alias("first_sibling"))


def type_hierarchy(edges: DataFrame, symbols: DataFrame, symbol_id: str, depth: int = 100) -> DataFrame:
    """(direction, node, name, kind, file, line, depth, relationship): all ancestors and descendants over inherits and implements.

    Ancestors that are no symbols keep their bare name and end there; descendants are symbols.
    """
    e = edges.where(F.col("rel").isin("inherits", "implements")).select("rel", "src", "dst").distinct()
    spark, out = edges.sparkSession, None
    for direction, a, b in (("ancestor", "src", "dst"), ("descendant", "dst", "src")):
        seen = cut(spark.range(1).select(F.lit(symbol_id).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relationship")))
        front = seen
        for d in range(1, depth + 1):
            step = small(front.select(F.col("node").alias(a))).join(e, a).groupBy(F.col(b).alias("node")).agg(F.max("rel").alias("relationship"))
            front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "relationship"))
            if not front.limit(1).count():
                break
            seen = seen.unionByName(front)
        part = seen.where("depth > 0").withColumn("direction", F.lit(direction))
        out = part if out is None else out.unionByName(part)
    s = symbols.select(F.col("id").alias("node"), "name", "kind", "file", "line")
    out = out.join(s, "node", "left").where("direction = 'ancestor' or name is not null")
    return out.select("direction", "node", F.coalesce("name", "node").alias("name"), "kind", "file", "line", "depth", "relationship").orderBy("direction", "depth", "node")


def imports_of(imports: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """(module, candidates): what a file imports, with the files that each import may mean."""
    base = F.regexp_replace(text.basename("file"), r"\.[^.]*$", "")
    # the path ends with a slash and the module, or with these and .py: all suffixes of the path are keys
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    tails = F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(base, F.col("file")), tails, F.transform(F.filter(tails, lambda t: t.endswith(".py")), lambda t: F.regexp_replace(t, r"\.py$", ""))))
    keyed = files.select("file", F.explode(keys).alias("module"))
    mine = imports.where(F.col("file") == file).select("module").distinct()
    return mine.join(keyed, "module", "left").groupBy("module").agg(F.sort_array(F.collect_set("file")).alias("candidates")).orderBy("module")


def importers_of(imports: DataFrame, file: str) -> DataFrame:
    """(file, module): who imports a file by its path, path without extension or bare name; the least of these if several."""
    base = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    names = sorted({file, base, file.rsplit(".", 1)[0]})
    return imports.where(F.col("module").isin(names) & (F.col("file") != file)).groupBy("file").agg(F.min("module").alias("module")).orderBy("file")
