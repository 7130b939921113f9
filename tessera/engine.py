"""The public surface: one method per query over a warehouse of indexes, and run(name, **args).

    engine = Engine(spark, "/data/warehouse")
    engine.index_folder("/src/project")
    engine.search_symbols("project", "parse file").show()
"""

from __future__ import annotations

import datetime
import inspect
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.extract import run as extraction
from tessera.operators import graph, outline, quality, render, search, security
from tessera.plans.lineage import cut
from tessera.sources import diff, manifests, scanner, tree
from tessera.sources.store import Store, folder_identity

#: Ranges of the integer arguments of queries.
CLAMPS = {"context_lines": (0, 100), "max_results": (1, 50), "max_depth": (1, 10), "limit": (1, 100), "line": (1, 1_000_000)}
#: Length of a text argument, but for those that are whole documents.
MAX_TEXT, WHOLE_TEXTS = 2_000, ("diff_text", "ignore")


def checked(tool, args: dict) -> dict:
    """args as the query's signature has them: no unknown or missing ones, texts without control characters and at most
    MAX_TEXT long, integers within their ranges, true and false also as words. Raises ValueError."""
    known = {k: p for k, p in inspect.signature(tool).parameters.items() if k != "self"}
    if unknown := sorted(set(args) - set(known)):
        raise ValueError(f"unknown arguments: {', '.join(unknown)}")
    if missing := [k for k, p in known.items() if p.default is inspect.Parameter.empty and k not in args]:
        raise ValueError(f"missing arguments: {', '.join(missing)}")

    def text_of(k: str, v: str) -> str:
        if len(v) > MAX_TEXT or any(ord(c) < 32 and c not in "\t\n\r" for c in v) and k not in WHOLE_TEXTS:
            raise ValueError(f"{k} is too long or holds control characters")
        return v

    out = {}
    for k, v in args.items():
        kind = str(known[k].annotation)
        if kind.startswith("int") and v is not None:
            if isinstance(v, bool) or not re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", str(v)):
                raise ValueError(f"{k} is a whole number")
            v = int(v)
            lo, hi = CLAMPS.get(k, (v, v))
            v = min(max(v, lo), hi)
        elif kind.startswith("bool"):
            word = str(v).strip().lower()
            if word not in ("true", "false", "1", "0"):
                raise ValueError(f"{k} is true or false")
            v = word in ("true", "1")
        elif kind.startswith("float") and v is not None:
            try:
                v = float(v)
            except (TypeError, ValueError):
                raise ValueError(f"{k} is a number") from None
        elif kind.startswith("str") and v is not None:
            if not isinstance(v, str):
                raise ValueError(f"{k} is a text")
            v = v if k in WHOLE_TEXTS else text_of(k, v)
        elif kind.startswith("list") and v is not None:
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise ValueError(f"{k} is a list of texts")
            v = [text_of(k, x) for x in v]
        out[k] = v
    return out


class Engine:
    """embed(texts) -> vectors is needed only for searches by meaning; there is no model inside."""

    def __init__(self, spark: SparkSession, warehouse: str, usage: str | None = None, embed=None, model: str = "user"):
        self.spark, self.store, self.usage, self.embed, self.model = spark, Store(spark, warehouse), usage, embed, model

    def run(self, tool: str, **args):
        """A query by name, its arguments checked against its signature and integers clamped to their ranges."""
        if tool not in TOOLS:
            raise LookupError(f"no such tool: {tool}")
        return getattr(self, tool)(**checked(getattr(Engine, tool), args))

    def safe_message(self, error: Exception) -> str:
        """What may be told of an error: its first line without the warehouse's and other absolute paths, at most 500 characters."""
        said = (str(error) or type(error).__name__).splitlines()[0]
        said = said.replace(self.store.folder, "<warehouse>")
        return re.sub(r"(?<![\w.<>])(?:[A-Za-z]:)?(?:[/\\][\w.@ +-]+){2,}", "<path>", said)[:500]

    def catalog(self) -> DataFrame:
        rows = [(t, str(inspect.signature(getattr(Engine, t))).replace("(self, ", "(").replace("(self)", "()"), (getattr(Engine, t).__doc__ or "").strip().split("\n")[0]) for t in TOOLS]
        return self.spark.createDataFrame(rows, "name string, signature string, description string")

    def register_views(self, repo: str | None = None) -> None:
        """The tables as temporary views, for SQL."""
        for t in ("symbols", "files", "contents", "repos", "edges", "imports", "embeddings"):
            self.store.table(t, repo and self.store.resolve(repo)).createOrReplaceTempView(t)

    def _t(self, name: str, repo: str) -> DataFrame:
        return self.store.table(name, self.store.resolve(repo))

    def _calls(self, repo: str) -> DataFrame:
        return self._t("edges", repo).where("rel = 'calls'")

    def _content_rows(self, repos: list[str]) -> DataFrame:
        f = self.store.table("files", repos).select("repo", "file", "ord")
        c = self.store.table("contents", repos)
        return c.join(f, ["repo", "file"]).select("repo", "file", "ord", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))

    # ---- indexing

    def index_folder(self, path: str, extra_ignore_patterns: list[str] | None = None, owner: str = "local", name: str | None = None) -> DataFrame:
        """Index a local folder; only files that changed since the last time are parsed again. Returns (file, status)."""
        ignore = None
        if os.path.isfile(f"{path}/.gitignore") and os.path.getsize(f"{path}/.gitignore") <= tree.IGNORE_BYTES:
            with open(f"{path}/.gitignore", encoding="utf-8", errors="replace") as f:
                ignore = f.read()
        name = name or folder_identity(path)
        files = tree.read_folder(self.spark, path, f"{owner}/{name}", ignore, extra_ignore_patterns)
        head = diff.git_head(path) if os.path.isdir(f"{path}/.git") else None
        return self._index(owner, name, files, head)

    def _index(self, owner: str, name: str, files: DataFrame, head: str | None = None) -> DataFrame:
        files = cut(files)
        if self.store.table("repos", f"{owner}/{name}").limit(1).count():
            return self.store.update(owner, name, files, extraction.extract, head)
        self.store.save(owner, name, files, cut(extraction.extract(files)), head)
        return files.select("file", F.lit("new").alias("status"))

    def index_repo(self, url: str, entries: DataFrame, fetch, ignore: str | None = None) -> DataFrame:
        """Index a remote repository from its listing (path, type, size); fetch(path) -> bytes runs on the executors."""
        owner, name = tree.parse_repo_url(url)
        repo = f"{owner}/{name}"
        paths = tree.filter_entries(entries, ignore).select(F.col("path").alias("file"))

        def load(batches):
            for pdf in batches:
                yield pdf.assign(content=[fetch(p) for p in pdf["file"]])

        got = paths.repartition(10).mapInPandas(load, "file string, content binary").where(F.length("content") <= schemas.MAX_FILE_BYTES)
        got = got.select(F.lit(repo).alias("repo"), "file", tree.language("file").alias("language"), "content", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_bytes"))
        from pyspark.sql import Window

        return self._index(owner, name, got.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("file")).cast("int") - 1))

    def list_repos(self) -> DataFrame:
        """All indexes with their sizes, at most 500."""
        return self.store.table("repos").orderBy("repo").limit(500)

    def invalidate_cache(self, repo: str, confirm: bool = False) -> bool:
        """Delete an index, if confirmed."""
        return self.store.drop(self.store.resolve(repo), confirm)

    # ---- outlines and lookups

    def get_repo_outline(self, repo: str) -> DataFrame:
        """Files per top directory and language, symbols per kind."""
        return outline.repo_outline(self._t("files", repo), self._t("symbols", repo))

    def get_file_tree(self, repo: str, path_prefix: str = "") -> DataFrame:
        """Directories and files below a prefix."""
        return outline.file_tree(self._t("files", repo), self._t("symbols", repo), path_prefix)

    def get_file_outline(self, repo: str, file_path: str) -> DataFrame:
        """Symbols of a file with their nesting."""
        return outline.file_outline(self._t("symbols", repo), file_path)

    def get_symbol(self, repo: str, symbol_id: str = "", file_path: str | None = None, line: int | None = None, verify: bool = False, context_lines: int = 0) -> DataFrame:
        """One symbol with its source, by id or as the innermost at a line."""
        s = self._t("symbols", repo)
        if symbol_id:
            s = s.where(F.col("id") == symbol_id)
        elif file_path is not None and line is not None:
            s = outline.symbol_at(s, file_path, line)
        else:
            raise ValueError("symbol_id, or file_path and line, are needed")
        return outline.with_source(s, self._t("contents", repo), min(max(context_lines, 0), schemas.MAX_CONTEXT), verify)

    def get_symbols(self, repo: str, symbol_ids: list[str]) -> tuple[DataFrame, DataFrame]:
        """Up to 50 symbols with source in the order asked for, and the ids not found."""
        found, missing = outline.symbols_by_ids(self._t("symbols", repo), symbol_ids)
        return outline.with_source(found, self._t("contents", repo)).orderBy("pos"), missing

    def get_symbol_context(self, repo: str, symbol_id: str, include_graph: bool = False) -> DataFrame:
        """A symbol with siblings and parent, on request with callers, callees and, of a class, its hierarchy."""
        return outline.context(self._t("symbols", repo), symbol_id, self._t("edges", repo) if include_graph else None)

    # ---- search

    def _repos(self, repo: str | None, repos: list[str] | None) -> list[str]:
        asked = repos or [repo]
        if len(asked) > schemas.MAX_REPOS:
            raise ValueError(f"at most {schemas.MAX_REPOS} repositories")
        return [self.store.resolve(r) for r in asked]

    def search_symbols(self, repo: str | None = None, query: str = "", kind: str | None = None, file_pattern: str | None = None, language: str | None = None, max_results: int = 10, semantic: bool = False, semantic_weight: float = 0.7, semantic_only: bool = False, repos: list[str] | None = None) -> DataFrame:
        """Symbols by keywords, by meaning, or both."""
        names = self._repos(repo, repos)
        if kind and kind not in schemas.KINDS:
            raise ValueError(f"kind is one of {schemas.KINDS}")
        s, k = self.store.table("symbols", names), min(max(max_results, 1), schemas.MAX_RESULTS)
        if not (semantic or semantic_only):
            return search.keyword_search(s, query, names, kind, language, file_pattern, k)
        if self.embed is None:
            raise ValueError("a search by meaning needs an embedding function")
        self.embed_missing(names)
        return search.semantic_search(s, self.store.table("embeddings", names).where(F.col("model") == self.model), list(self.embed([query])[0]), query, names, kind, language, file_pattern, k, semantic_weight, semantic_only)

    def embed_missing(self, repos: list[str]) -> None:
        """Vectors for the symbols that have none, made on the executors."""
        todo = search.missing_embeddings(self.store.table("symbols", repos), self.store.table("embeddings", repos), self.model)
        embed, model = self.embed, self.model

        def run(batches):
            import pandas as pd

            for pdf in batches:
                v = [[float(x) for x in e] for e in embed(pdf["text"].tolist())] if len(pdf) else []
                yield pd.DataFrame({"repo": pdf["repo"], "symbol_id": pdf["id"], "model": model, "dim": [len(x) for x in v], "vec": v})

        made = cut(todo.mapInPandas(run, schemas.EMBEDDINGS))
        if made.limit(1).count():
            self.store.upsert_embeddings(made)

    def search_text(self, repo: str | None = None, query: str = "", file_pattern: str | None = None, max_results: int = 20, repos: list[str] | None = None) -> DataFrame:
        """Lines that hold a text, in file order; secrets are replaced before the search."""
        names = self._repos(repo, repos)
        return search.text_search(search.lines(self._content_rows(names)), query, names, file_pattern, min(max(max_results, 1), schemas.MAX_RESULTS))

    def search_references(self, repo: str, query: str, file_pattern: str | None = None, max_results: int = 20) -> DataFrame:
        """Lines that hold a text, with the innermost symbol around each."""
        name = self.store.resolve(repo)
        return search.search_references(search.lines(self._content_rows([name])), self._t("symbols", repo), query, file_pattern, min(max(max_results, 1), schemas.MAX_RESULTS))

    # ---- graph

    def _named(self, repo: str, rows: DataFrame) -> DataFrame:
        s = self._t("symbols", repo).select(F.col("id").alias("node"), "name", "kind", "file", "line")
        return rows.join(s, "node", "left").orderBy("depth", "node")

    def get_callers(self, repo: str, symbol_id: str, max_depth: int = 1) -> DataFrame:
        """Who calls a symbol, directly or in up to 5 steps."""
        return self._named(repo, graph.callers(self._calls(repo), symbol_id, min(max(max_depth, 1), 5)))

    def get_callees(self, repo: str, symbol_id: str, max_depth: int = 1) -> DataFrame:
        """What a symbol calls, directly or in up to 5 steps."""
        return self._named(repo, graph.callees(self._calls(repo), symbol_id, min(max(max_depth, 1), 5)))

    def get_call_chain(self, repo: str, from_symbol: str, to_symbol: str, max_depth: int = 10) -> DataFrame:
        """Up to five call paths between two symbols, shortest first."""
        return graph.paths(self._calls(repo), from_symbol, to_symbol, min(max(max_depth, 1), 10))

    def get_type_hierarchy(self, repo: str, symbol_id: str) -> DataFrame:
        """All ancestors and descendants of a type."""
        return outline.type_hierarchy(self._t("edges", repo), self._t("symbols", repo), symbol_id)

    def get_imports(self, repo: str, file: str, direction: str = "imports") -> DataFrame:
        """What a file imports, or who imports it."""
        if direction == "importers":
            return outline.importers_of(self._t("imports", repo), file)
        return outline.imports_of(self._t("imports", repo), self._t("files", repo), file)

    def get_impact(self, repo: str, symbol_id: str, max_depth: int = 3) -> DataFrame:
        """What depends on a symbol by calls, inheritance and imports."""
        s, e = self._t("symbols", repo), self._t("edges", repo).where("resolved").select("rel", "src", "dst")
        one = s.where(F.col("id") == symbol_id).select("file").first()
        if one:  # symbols of files that import the symbol's file depend on it directly
            files = outline.importers_of(self._t("imports", repo), one["file"]).select("file")
            own = s.join(F.broadcast(files), "file", "left_semi").select(F.lit("imports").alias("rel"), F.col("id").alias("src"), F.lit(symbol_id).alias("dst"))
            e = e.unionByName(own)
        return self._named(repo, graph.impact(e, symbol_id, min(max(max_depth, 1), 10)))

    def get_diagram(self, repo: str, diagram_type: str, symbol_id: str | None = None, path: str | None = None, max_depth: int = 2, direction: str = "TD") -> str:
        """Mermaid text of a call graph, hierarchy, import graph or impact."""
        return render.diagram(diagram_type, self._t("edges", repo), self._t("imports", repo), self._t("files", repo), self._t("symbols", repo), symbol_id, path, max_depth, direction)

    def get_dependencies(self, repo: str) -> tuple[DataFrame, DataFrame]:
        """Imported modules, internal and external, and import cycles (at most 20)."""
        i, f = self._t("imports", repo), self._t("files", repo)
        return quality.dependencies(i, f), graph.cycles(graph.file_graph(i, f)).orderBy("comp").limit(20)

    # ---- quality

    def analyze_complexity(self, repo: str, path: str | None = None, limit: int = 20, sort_by: str = "risk") -> DataFrame:
        """Functions by risk or by one metric."""
        return quality.hotspots(self._t("symbols", repo), self._calls(repo), path, limit, sort_by)

    def get_key_symbols(self, repo: str, path: str | None = None, limit: int = 20, kind: str | None = None) -> DataFrame:
        """Symbols by rank in the call graph."""
        return quality.key_symbols(self._t("symbols", repo), self._calls(repo), path, limit, kind)

    def get_dead_code(self, repo: str, language: str | None = None, include_tests: bool = False, limit: int = 100) -> DataFrame:
        """Functions that nothing calls."""
        return quality.dead_code(self._t("symbols", repo), self._calls(repo), language, include_tests, limit)

    def compare_symbols(self, base_repo: str, head_repo: str) -> DataFrame:
        """Symbols added, removed and modified between two indexes."""
        return quality.compare(self._t("symbols", base_repo), self._t("symbols", head_repo))

    def get_changes(self, repo: str, git_ref: str = "HEAD~1..HEAD", repo_path: str | None = None, include_impact: bool = False, diff_text: str | None = None) -> DataFrame:
        """Symbols that a diff touches, on request with what calls them in up to 3 steps."""
        d = diff.git_diff(repo_path, git_ref) if diff_text is None else diff_text
        s = self._t("symbols", repo)
        hit = cut(search.changed_symbols(s, diff.hunks(self.spark, d, self.store.resolve(repo))))
        if not include_impact:
            return hit
        starts = hit.select(F.col("id").alias("root"), F.col("id").alias("node"))
        down = graph.reach(self._calls(repo), starts, 3, forward=False).select(F.col("node").alias("id")).distinct()
        down = s.join(down, "id", "left_semi").join(hit, "id", "left_anti").select("repo", "id", "name", "kind", "file", F.col("line").alias("first"), F.col("end_line").alias("last"))
        return hit.withColumn("role", F.lit("changed")).unionByName(down.withColumn("role", F.lit("downstream")))

    def lint_index(self, repo: str) -> DataFrame:
        """Integrity findings of an index."""
        return quality.lint(self._t("symbols", repo), self._t("files", repo), self._t("contents", repo))

    def verify(self, repo: str, max_age_hours: int = 168) -> DataFrame:
        """Five health checks of an index."""
        return quality.verify(self._t("repos", repo), self._t("symbols", repo), self._t("contents", repo), None, max_age_hours)

    def get_status(self) -> DataFrame:
        """How many indexes and symbols there are."""
        return quality.status(self.store.table("repos"))

    def get_usage_stats(self, tool_name: str | None = None, session: str = "all") -> tuple[DataFrame, DataFrame]:
        """Calls per tool, and the tools never called in any session."""
        if self.usage is None:
            raise ValueError("the engine was made without a usage folder")
        u = self.spark.read.schema(schemas.USAGE).json(self.usage)
        return quality.usage_stats(u, tool_name, None if session == "all" else session), quality.unused_tools(u, list(TOOLS))

    # ---- security and supply chain

    def _sources(self, repo: str) -> DataFrame:
        return outline.with_source(self._t("symbols", repo).where(F.size("calls") > 0), self._t("contents", repo)).select("repo", "id", "source")

    def scan_security(self, repo: str, category: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
        """Findings of the security rules."""
        return security.scan(self._t("symbols", repo), self._sources(repo), category, severity, limit)

    def count_findings(self, repo: str, category: str | None = None, severity: str | None = None) -> DataFrame:
        """Findings of the security rules by severity, all of them."""
        return security.by_severity(security.findings(self._t("symbols", repo), self._sources(repo), category, severity))

    def scan_module_settings(self, repo: str) -> DataFrame:
        """Unsafe settings at the top level of Python files."""
        return security.scan_modules(self._content_rows([self.store.resolve(repo)]))

    def trace_taint(self, repo: str, source_calls: list[str] | None = None, max_depth: int = 10, semgrep: bool = False, repo_path: str | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
        """Paths from symbols that read outside data to findings of high severity; with semgrep also the scanner's findings.

        Where the scanner can't run, its findings are one row that says so.
        """
        paths = security.trace_taint(self._t("symbols", repo), self._calls(repo), source_calls, min(max(max_depth, 1), 10))
        return (paths, scanner.findings(self.spark, repo_path)) if semgrep and repo_path else paths

    def summarize_taint(self, repo: str, source_calls: list[str] | None = None, max_depth: int = 10) -> DataFrame:
        """How many sources, findings and paths between them there are, and what the paths do not show."""
        return security.taint_summary(self._t("symbols", repo), self._calls(repo), source_calls, min(max(max_depth, 1), 10))

    def generate_sbom(self, repo_path: str, format: str = "table"):
        """Dependencies of a project's lock files, as rows or as a CycloneDX or SPDX document."""
        files = manifests.read_files(repo_path)
        deps = manifests.dependencies(self.spark, files)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        if format == "cyclonedx":
            return manifests.cyclonedx(deps, now)
        return manifests.spdx(deps, [n for n in files if n in manifests.PARSERS], now) if format == "spdx" else deps

    def check_licenses(self, repo_path: str) -> DataFrame:
        """Licences of a project and its locked packages, classified."""
        return manifests.licenses(self.spark, manifests.read_files(repo_path))


TOOLS = [n for n, f in vars(Engine).items() if inspect.isfunction(f) and not n.startswith("_") and n not in ("run", "safe_message", "catalog", "register_views", "embed_missing", "scan_module_settings", "count_findings", "summarize_taint")]
