"""Security rules over symbols, argument checks on candidates, and source-to-sink reachability."""

from __future__ import annotations

import ast
import textwrap

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import graph
from tessera.plans.lineage import cut, small

RULE_SCHEMA = "rule_id string, severity string, confidence string, languages array<string>, calls_any array<string>, imports_any array<string>, arg_check string, supersedes string, owasp array<string>, cwe array<string>"
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
_SUBPROCESS, _JS = ["Popen", "call", "check_call", "check_output", "run"], ["javascript", "typescript"]

# ---- fixed values: rules by id, severity, confidence, languages, calls, imports, argument check, rule superseded, taxonomy
RULES = [
    ("SEC-001", "critical", "high", [], ["eval"], [], None, None, ["A03:2021"], ["CWE-94"]),
    ("SEC-002", "critical", "high", ["python"], ["exec"], [], None, None, ["A03:2021"], ["CWE-94"]),
    ("SEC-003", "critical", "high", ["python"], ["popen", "system"], ["os"], None, None, ["A03:2021"], ["CWE-78"]),
    ("SEC-004", "high", "medium", ["python"], _SUBPROCESS, ["subprocess"], None, None, ["A03:2021"], ["CWE-78"]),
    ("SEC-005", "high", "high", _JS, ["innerHTML"], [], None, None, ["A03:2021"], ["CWE-79"]),
    ("SEC-006", "medium", "low", _JS, ["write"], [], None, None, ["A03:2021"], ["CWE-79"]),
    ("SEC-007", "high", "high", _JS, ["dangerouslySetInnerHTML"], [], None, None, ["A03:2021"], ["CWE-79"]),
    ("SEC-008", "medium", "medium", ["python"], ["MD5", "md5"], ["Crypto", "cryptography", "hashlib"], None, None, ["A02:2021"], ["CWE-328"]),
    ("SEC-009", "medium", "medium", ["python"], ["SHA1", "sha1"], ["Crypto", "hashlib"], None, None, ["A02:2021"], ["CWE-328"]),
    ("SEC-010", "critical", "high", ["python"], ["load", "loads"], ["cPickle", "pickle"], None, None, ["A08:2021"], ["CWE-502"]),
    ("SEC-011", "high", "medium", ["python"], ["load"], ["yaml"], None, None, ["A08:2021"], ["CWE-502"]),
    ("SEC-012", "high", "high", ["python"], ["loads"], ["marshal"], None, None, ["A08:2021"], ["CWE-502"]),
    ("SEC-013", "medium", "high", ["python"], ["mktemp"], ["tempfile"], None, None, [], ["CWE-377"]),
    ("SEC-014", "medium", "medium", ["python"], ["fromstring", "parse"], ["etree", "lxml", "xml"], None, None, [], ["CWE-611"]),
    ("SEC-015", "medium", "low", ["python"], ["delete", "get", "post", "put", "request", "urlopen"], ["httpx", "requests", "urllib"], None, None, ["A10:2021"], ["CWE-918"]),
    ("SEC-016", "critical", "high", ["python"], _SUBPROCESS, ["subprocess"], "shell_true", "SEC-004", ["A03:2021"], ["CWE-78"]),
    ("SEC-017", "high", "high", ["python"], ["load"], ["yaml"], "yaml_loader", "SEC-011", ["A08:2021"], ["CWE-502"]),
    ("SEC-018", "medium", "high", ["python"], ["bind", "run", "run_simple"], ["flask", "socket", "werkzeug"], "bind_all", None, ["A05:2021"], ["CWE-668"]),
    ("SEC-019", "medium", "high", ["python"], ["run", "run_simple"], ["flask", "werkzeug"], "debug_true", None, ["A05:2021"], ["CWE-215"]),
]
#: Rules on module-level assignments of Python files: id, severity, confidence, target, taxonomy.
MODULE_RULES = [("SEC-020", "medium", "medium", "DEBUG", ["A05:2021"], ["CWE-215"]), ("SEC-021", "high", "medium", "SECRET_KEY", ["A02:2021"], ["CWE-798"])]


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def match_rules(symbols: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """symbols (repo, id, calls, imports, language) with each rule that fits: a call it names and, if it lists any, an import.

    Calls are exploded and hash-joined with the rules' triggers, so no symbol is compared with every rule.
    """
    trigger = rule_rows.withColumn("trigger", F.explode("calls_any"))
    calls = symbols.select("repo", "id", F.explode(F.array_distinct("calls")).alias("trigger"))
    hit = calls.join(small(trigger), "trigger").groupBy("repo", "id", "rule_id").agg(F.sort_array(F.collect_set("trigger")).alias("matched_calls"))
    hit = hit.join(symbols, ["repo", "id"]).join(small(rule_rows), "rule_id")
    lang = (F.size("languages") == 0) | F.array_contains("languages", F.col("language"))
    need = (F.size("imports_any") == 0) | F.coalesce(F.arrays_overlap("imports_any", "imports"), F.lit(False))
    return hit.where(lang & need)


def _call_name(node: ast.Call) -> str:
    return node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")


def _is(node, value) -> bool:
    return isinstance(node, ast.Constant) and node.value is value


def check_arguments(kind: str, source: str) -> bool | None:
    """Whether a call in the source has the dangerous argument; null if the source can't be parsed."""
    try:
        calls = [n for n in ast.walk(ast.parse(textwrap.dedent(source))) if isinstance(n, ast.Call)]
    except (SyntaxError, ValueError, RecursionError):
        return None
    key = lambda n, k: next((w.value for w in n.keywords if w.arg == k), None)
    if kind == "shell_true":
        return any(_is(key(n, "shell"), True) for n in calls if _call_name(n) in _SUBPROCESS)
    if kind == "debug_true":
        return any(_is(key(n, "debug"), True) for n in calls if _call_name(n) in ("run", "run_simple"))
    if kind == "bind_all":
        everywhere = lambda v: isinstance(v, ast.Constant) and v.value in ("0.0.0.0", "")
        first = lambda n: n.args[0].elts[0] if n.args and isinstance(n.args[0], ast.Tuple) and n.args[0].elts else (n.args[0] if n.args else None)
        return any(everywhere(first(n)) if _call_name(n) == "bind" else everywhere(key(n, "host") or (first(n) if _call_name(n) == "run_simple" else None)) for n in calls if _call_name(n) in ("bind", "run", "run_simple"))
    loaders = [(key(n, "Loader") or (n.args[1] if len(n.args) > 1 else None)) for n in calls if _call_name(n) == "load"]
    named = lambda v: v.attr if isinstance(v, ast.Attribute) else getattr(v, "id", "")
    return any(v is None or named(v) not in ("SafeLoader", "CSafeLoader", "BaseLoader") for v in loaders)


@F.pandas_udf(T.BooleanType())
def _checked(kind: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or s is None else check_arguments(k, s) for k, s in zip(kind, source)], dtype="object")


def findings(symbols: DataFrame, sources: DataFrame | None = None, category: str | None = None, severity: str | None = None, rule_rows: DataFrame | None = None) -> DataFrame:
    """All findings (rank of the severity, file, line, rule_id, ...) of the rules over symbols, in no order.

    A symbol without imports has those of its file. Rules with an argument check run on their candidates only, and only
    if sources (repo, id, source) are given; where the check could be made, the superseded rule is silent for the symbol.
    """
    spark = symbols.sparkSession
    rule_rows = rules(spark) if rule_rows is None else rule_rows
    if category:
        c = category.upper()
        if c.startswith("OWASP-"):
            rule_rows = rule_rows.where(F.exists("owasp", lambda t: F.upper(t).contains(c[6:])))
        else:
            rule_rows = rule_rows.where(F.exists("cwe", lambda t: F.upper(t).contains(c)))
    if severity:
        keep = [s for s, r in SEVERITY.items() if r <= SEVERITY.get(severity, 3)]
        rule_rows = rule_rows.where(F.col("severity").isin(keep))
    per_file = symbols.where(F.size("imports") > 0).groupBy("repo", "file").agg(F.array_distinct(F.flatten(F.collect_list("imports"))).alias("file_imports"))
    s = symbols.join(per_file, ["repo", "file"], "left").withColumn("imports", F.when(F.coalesce(F.size("imports"), F.lit(0)) > 0, F.col("imports")).otherwise(F.col("file_imports")))
    s = s.select("repo", "id", "name", "file", "line", "language", "calls", "imports").where(F.size("calls") > 0)
    hit = match_rules(s, rule_rows)
    if sources is None:
        hit = hit.where("arg_check is null")
    else:
        plain = hit.where("arg_check is null").withColumn("bad", F.lit(True))
        deep = hit.where("arg_check is not null").join(sources.select("repo", "id", "source"), ["repo", "id"]).withColumn("bad", _checked("arg_check", "source")).where("bad is not null").drop("source")
        over = deep.where("supersedes is not null").select("repo", "id", F.col("supersedes").alias("rule_id")).distinct()
        hit = plain.join(over, ["repo", "id", "rule_id"], "left_anti").unionByName(deep.where("bad")).drop("bad")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity")), F.lit(3))
    return hit.select(rank.alias("rank"), "repo", "rule_id", "severity", "confidence", "id", F.col("name").alias("symbol"), "file", "line", "matched_calls", "owasp", "cwe")


def scan(symbols: DataFrame, sources: DataFrame | None = None, category: str | None = None, severity: str | None = None, k: int = 100, rule_rows: DataFrame | None = None) -> DataFrame:
    """The worst k findings of the rules over symbols, by severity, file, line and rule."""
    found = findings(symbols, sources, category, severity, rule_rows)
    return found.orderBy("rank", "file", "line", "rule_id").limit(k).drop("rank")


def by_severity(found: DataFrame) -> DataFrame:
    """(severity, n) of findings, worst first: a partial count, one row a severity."""
    n = found.groupBy("rank", "severity").agg(F.count("*").alias("n"))
    return n.orderBy("rank", "severity").drop("rank")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("line", T.IntegerType())])))
def _module_hits(source: pd.Series) -> pd.Series:
    def one(s):
        out = []
        try:
            body = ast.parse(s or "").body
        except (SyntaxError, ValueError, RecursionError):
            return out
        for n in body:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) and n.value else []
            for t in targets:
                if getattr(t, "id", "") == "DEBUG" and _is(n.value, True):
                    out.append({"rule_id": "SEC-020", "line": n.lineno})
                if getattr(t, "id", "") == "SECRET_KEY" and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and n.value.value:
                    out.append({"rule_id": "SEC-021", "line": n.lineno})
        return out

    return source.map(one)


def scan_modules(contents: DataFrame) -> DataFrame:
    """(repo, file, rule_id, severity, line) of unsafe settings assigned at the top level of Python files (content STRING)."""
    kinds = contents.sparkSession.createDataFrame([r[:3] for r in MODULE_RULES], "rule_id string, severity string, confidence string")
    hit = contents.where(F.col("file").endswith(".py")).select("repo", "file", F.explode(_module_hits("content")).alias("h")).select("repo", "file", "h.*")
    return hit.join(F.broadcast(kinds), "rule_id")


def taint_pairs(call_edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int = 10, cap: int = 20) -> DataFrame:
    """(source, sink, depth) of sinks (id) that a source (id, ord) reaches by calls, by source order and sink id; at most cap.

    Sources are searched in their order, some at a time, until there are cap pairs: later sources have only later pairs.
    """
    call_edges = cut(call_edges.select("src", "dst").distinct())
    ends = cut(_near_sinks(call_edges, sinks, depth))
    able = cut(sources.join(ends.select(F.col("node").alias("id")), "id", "left_semi"))  # each has a pair
    # ties in order are searched together; a null order comes first
    heads = [r["ord"] for r in able.select("ord").distinct().orderBy("ord").limit(cap).collect()]
    hit, i, step = _reached(call_edges, able.limit(0), sinks, depth, ends), 0, 1
    while i < len(heads):
        some = F.lit(False)
        for o in heads[i : i + step]:
            some = some | F.col("ord").eqNullSafe(F.lit(o))
        hit = hit.unionByName(cut(_reached(call_edges, able.where(some), sinks, depth, ends)))
        i, step = i + step, 2 * step
        if hit.limit(cap).count() >= cap:
            break
    return hit.orderBy("ord", "node").limit(cap).select(F.col("root").alias("source"), F.col("node").alias("sink"), "depth")


def _near_sinks(call_edges: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """(node, left): how many steps each node is from the sink nearest to it, up to depth; one search from all sinks at once."""
    starts = sinks.select(F.lit(0).alias("root"), F.col("id").alias("node"))
    return graph.reach(call_edges, starts, depth, forward=False, inclusive=True).select("node", F.col("depth").alias("left"))


def _reached(call_edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int, ends: DataFrame | None = None) -> DataFrame:
    """All pairs, searched only through nodes from which a sink is near enough (ends, where they are at hand)."""
    ends = cut(_near_sinks(call_edges, sinks, depth)) if ends is None else ends
    able = sources.join(ends.select(F.col("node").alias("id")), "id", "left_semi")
    got = graph.reach(call_edges, able.select(F.col("id").alias("root"), F.col("id").alias("node")), depth, inclusive=True, ends=ends)
    return got.join(small(sinks.select(F.col("id").alias("node")).distinct()), "node").join(small(sources.select(F.col("id").alias("root"), "ord")), "root")


#: Calls that bring in outside data, unless the caller names others (fixed values).
SOURCE_CALLS = "input readline read recv recvfrom getenv".split()


#: What the paths do not show.
LIMITATIONS = ["paths are calls from function to function, arguments are not followed", "sources and findings are known by the bare names of the functions called", "a path does not prove that outside data takes it"]


def taint_ends(symbols: DataFrame, source_calls: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols that take in outside data (id, ord), and all symbols with a finding of high severity (id)."""
    starts = symbols.where(F.arrays_overlap("calls", F.array(*[F.lit(c) for c in source_calls or SOURCE_CALLS]))).select("id", "ord")
    return starts, findings(symbols, severity="high").select("id").distinct()


def taint_summary(symbols: DataFrame, call_edges: DataFrame, source_calls: list[str] | None = None, depth: int = 10, cap: int = 20) -> DataFrame:
    """One row: sources_found, sinks_found, paths_found (all pairs), paths_returned, truncated, limitations."""
    starts, sinks = taint_ends(symbols, source_calls)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = n(starts, "sources_found").crossJoin(n(sinks, "sinks_found")).crossJoin(n(_reached(call_edges, starts, sinks, depth), "paths_found"))  # one row each
    return row.select("*", F.least("paths_found", F.lit(cap)).alias("paths_returned"), (F.col("paths_found") > cap).alias("truncated"), F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"))


def trace_taint(symbols: DataFrame, call_edges: DataFrame, source_calls: list[str] | None = None, depth: int = 10, cap: int = 20) -> DataFrame:
    """(source, sink, depth, path): symbols that take in outside data and the high-severity findings they reach, one path each."""
    starts, sinks = taint_ends(symbols, source_calls)
    pairs = taint_pairs(call_edges, starts, sinks, depth, cap)
    out = None
    for r in pairs.collect():  # at most `cap` rows
        if r["source"] == r["sink"]:
            p = symbols.sparkSession.createDataFrame([([r["source"]],)], "path array<string>")
        else:
            p = graph.paths(call_edges, r["source"], r["sink"], depth, 1).select("path")
        p = p.select(F.lit(r["source"]).alias("source"), F.lit(r["sink"]).alias("sink"), F.lit(r["depth"]).alias("depth"), "path")
        out = p if out is None else out.unionByName(p)
    return out if out is not None else pairs.withColumn("path", F.array().cast("array<string>"))
