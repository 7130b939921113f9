"""Rankings, dead code, integrity, comparison and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text
from tessera.operators import graph
from tessera.plans.lineage import small


def _scaled(c: str, low: str, high: str) -> Column:
    span = F.col(high) - F.col(low)
    return F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(low)) / span)


def hotspots(symbols: DataFrame, call_edges: DataFrame, path: str | None = None, k: int = 20, sort_by: str = "risk") -> DataFrame:
    """Functions and methods by composite risk (min-max scaled cognitive, cyclomatic, fan-in, nesting), or by one metric."""
    s = symbols.where(F.col("kind").isin(*schemas.EXECUTABLE))
    if path:
        s = s.where(F.col("file").startswith(path))
    cx = lambda f, d: F.coalesce(F.col(f"complexity.{f}"), F.lit(d)).alias(f)
    s = s.select("id", "name", "kind", "file", "line", "ord", cx("cyclomatic", 1), cx("cognitive", 0), cx("max_nesting", 0), cx("param_count", 0), cx("loc", 0))
    deg = graph.degrees(call_edges).withColumnRenamed("node", "id")
    s = s.join(deg, "id", "left").fillna(0, ["fan_in", "fan_out"])
    if sort_by in ("complexity", "cognitive"):
        return s.orderBy(F.desc("cyclomatic" if sort_by == "complexity" else "cognitive"), "ord").limit(k)
    return risk(s).orderBy(F.desc("risk_score"), "ord").limit(k)


def risk(s: DataFrame) -> DataFrame:
    """s with risk_score; the bounds are one row, joined by broadcast."""
    weights = {"cognitive": 0.4, "cyclomatic": 0.3, "fan_in": 0.2, "max_nesting": 0.1}
    bounds = s.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    score = sum((w * _scaled(c, f"lo_{c}", f"hi_{c}") for c, w in weights.items()), F.lit(0.0))
    return s.crossJoin(F.broadcast(bounds)).withColumn("risk_score", F.round(score, 3)).drop(*[f"{n}_{c}" for c in weights for n in ("lo", "hi")])


def key_symbols(symbols: DataFrame, call_edges: DataFrame, path: str | None = None, k: int = 20, kind: str | None = None, candidates: int = 200, rounds: int = 50) -> DataFrame:
    """Symbols by PageRank over calls, of the 200 with most callers, with the size of what depends on each in 3 steps."""
    ranks = graph.pagerank(symbols.select(F.col("id").alias("node")), call_edges, rounds=rounds)
    s = symbols.where(F.col("file").startswith(path)) if path else symbols
    if kind:
        s = s.where(F.col("kind") == kind)
    deg = graph.degrees(call_edges).withColumnRenamed("node", "id")
    top = s.select("id", "name", "kind", "file", "line", "ord").join(deg, "id", "left").fillna(0, ["fan_in", "fan_out"]).orderBy(F.desc("fan_in"), "ord").limit(candidates)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fan_in"), "ord")))  # of at most `candidates` rows
    size = graph.reach(call_edges, top.select(F.col("id").alias("root"), F.col("id").alias("node")), 3, forward=False).groupBy(F.col("root").alias("id")).agg(F.count("*").alias("impact_size"))
    out = top.join(small(size), "id", "left").fillna(0, ["impact_size"]).join(ranks.select(F.col("node").alias("id"), F.round("rank", 4).alias("rank")), "id")
    return out.orderBy(F.desc("rank"), "place").limit(k).drop("place", "ord")


def dead_code(symbols: DataFrame, call_edges: DataFrame, language: str | None = None, include_tests: bool = False, k: int = 100, kinds: tuple[str, ...] = schemas.EXECUTABLE) -> DataFrame:
    """Functions and methods that nothing calls, that are no entry points and (unless asked for) not in tests, in index order."""
    s = symbols.where(F.col("kind").isin(*kinds))
    if language:
        s = s.where(F.lower("language") == language.lower())
    if not include_tests:
        s = s.where(~text.is_test_file("file"))
    s = s.where(~text.is_entry_point("name", "decorators"))
    return s.join(call_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").orderBy("ord").limit(k)


def compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, status, base_*, head_*) of symbols added, removed, modified (by content hash) or unchanged; the last row of an id counts."""

    def last(df: DataFrame, p: str) -> DataFrame:
        return df.where("id is not null").groupBy("id").agg(F.max_by(F.struct("name", "kind", "file", text.redact("signature").alias("signature"), "content_hash"), "ord").alias(p))

    j = last(base, "b").join(last(head, "h"), "id", "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b.content_hash").eqNullSafe(F.col("h.content_hash")), "unchanged").otherwise("modified")
    either = lambda f: F.coalesce(f"b.{f}", f"h.{f}").alias(f)
    return j.select("id", status.alias("status"), either("name"), either("kind"), either("file"), F.col("b.signature").alias("base_signature"), F.col("h.signature").alias("head_signature")).orderBy("id")


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, status) of files (file, sha256): changed, new or deleted."""
    j = old.select("file", F.col("sha256").alias("a")).join(new.select("file", F.col("sha256").alias("b")), "file", "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return j.select("file", status.alias("status")).where("status is not null")


def dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(module, import_count, imported_by, internal) by number of importing files."""
    use = imports.where("module <> ''").groupBy("repo", "module").agg(F.count_distinct("file").alias("import_count"), F.sort_array(F.collect_set("file")).alias("imported_by"))
    known = graph.module_map(files).where("target is not null").select("repo", F.col("key").alias("module"), F.lit(True).alias("internal"))
    return use.join(known, ["repo", "module"], "left").select("module", "import_count", "imported_by", F.coalesce("internal", F.lit(False)).alias("internal")).orderBy(F.desc("import_count"), "module")


def lint(symbols: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(type, subject, detail, reason): symbols and hashes without content, content not indexed, duplicates, broken calls, wrong hashes."""
    disk = contents.select("file").distinct()
    row = lambda df, kind, subject, detail, reason: df.select(F.lit(kind).alias("type"), subject.alias("subject"), detail.alias("detail"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    orphans = row(symbols.where("file <> ''").join(disk, "file", "left_anti"), "orphaned_symbol", F.col("id"), F.col("file"), F.lit("content file missing"))
    stray = row(disk.join(files.select("file"), "file", "left_anti"), "orphaned_content", F.col("file"), none, F.lit("not in index"))
    key = F.concat(text.text("file"), F.lit(":"), text.text("name"), F.lit("#"), text.text("kind"))
    twice = row(symbols.groupBy(key.alias("key")).count().where("count > 1"), "duplicate_symbol", F.col("key"), F.col("count").cast("string"), F.lit("duplicate file:name:kind"))
    calls = symbols.select("id", F.explode("calls").alias("callee"))
    broken = row(calls.join(symbols.select(F.col("id").alias("callee")).distinct(), "callee", "left_anti"), "call_graph_broken_ref", F.col("id"), F.col("callee"), F.lit("callee not in index"))
    sums = files.select("file", "sha256").join(contents.select("file", F.sha2("content", 256).alias("actual")), "file", "left")
    wrong = row(sums.where("actual is null or actual <> sha256"), "file_hash_mismatch", F.col("file"), F.col("actual"), F.when(F.col("actual").isNull(), "content file missing").otherwise("hash mismatch"))
    return orphans.unionByName(stray).unionByName(twice).unionByName(broken).unionByName(wrong)


def verify(repo: DataFrame, symbols: DataFrame, contents: DataFrame, now: Column | None = None, max_age_hours: int = 168) -> DataFrame:
    """(check, passed, detail): the five health checks; content is sampled from the first five files by symbol id."""
    now = F.current_timestamp() if now is None else now
    age = (F.unix_timestamp(now) - F.unix_timestamp("indexed_at")) / 3600.0
    base = repo.select("index_version", age.alias("age"))
    row = lambda df, name, ok, detail: df.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))
    out = row(base, "exists", F.lit(True), F.lit("")).unionByName(row(base, "version", F.col("index_version") == schemas.INDEX_VERSION, F.col("index_version")))
    out = out.unionByName(row(base, "freshness", F.col("age") <= max_age_hours, F.round(F.coalesce("age", F.lit(-1.0)), 1)))
    out = out.unionByName(row(symbols.agg(F.count("*").alias("n")), "symbols", F.col("n") > 0, F.col("n")))
    sample = symbols.groupBy("repo", "file").agg(F.min_by(F.struct("id", "byte_offset", "byte_length"), "id").alias("s")).orderBy("s.id").limit(5)
    part = F.substring("content", (F.col("s.byte_offset") + 1).cast("int"), F.col("s.byte_length").cast("int"))
    read = sample.join(contents.select("repo", "file", "content"), ["repo", "file"], "left").agg(F.count("*").alias("n"), F.count(F.when(F.length(part) > 0, 1)).alias("ok"))
    return out.unionByName(row(read, "content_integrity", F.col("n") == F.col("ok"), F.concat_ws("/", "ok", "n")))


def status(repos: DataFrame) -> DataFrame:
    return repos.agg(F.count("*").alias("repo_count"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("total_symbols")).withColumn("index_version", F.lit(schemas.INDEX_VERSION))


def usage_stats(usage: DataFrame, tool: str | None = None, session: str | None = None) -> DataFrame:
    """(tool_name, calls, success, errors, avg_ms) per tool, most used first."""
    u = usage.where(F.col("session_id") == session) if session else usage
    u = u.where(F.col("tool_name") == tool) if tool else u
    return u.groupBy("tool_name").agg(F.count("*").alias("calls"), F.count(F.when(F.col("success"), 1)).alias("success"), F.count(F.when(~F.col("success"), 1)).alias("errors"), F.round(F.avg("response_time_ms"), 1).alias("avg_ms")).orderBy(F.desc("calls"), "tool_name")


def unused_tools(usage: DataFrame, catalog: list[str]) -> DataFrame:
    names = usage.sparkSession.createDataFrame([(t,) for t in catalog], "tool_name string")
    return names.join(usage.select("tool_name").distinct(), "tool_name", "left_anti").orderBy("tool_name")
