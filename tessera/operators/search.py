"""Symbol search, text search and reference search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, vec
from tessera.plans.lineage import small


def _filters(df: DataFrame, kind: str | None, language: str | None, glob: str | None) -> DataFrame:
    if kind:
        df = df.where(F.col("kind") == kind)
    if language:
        df = df.where(F.col("language") == language)
    return df.where(text.glob_match("file", glob)) if glob else df


def repo_position(repos: list[str]) -> Column:
    """Place of a row's repository in the order asked for."""
    out = F.when(F.lit(False), 0)
    for i, r in enumerate(repos):
        out = out.when(F.col("repo") == r, i)
    return out


def keyword_search(symbols: DataFrame, query: str, repos: list[str] | None = None, kind: str | None = None, language: str | None = None, glob: str | None = None, k: int = 10) -> DataFrame:
    """The k best symbols by keyword score, of several repositories k of each before they are merged.

    Ties keep index order (ord), and between repositories the order in which they were asked for.
    """
    hits = _filters(symbols, kind, language, glob).withColumn("score", text.keyword_score(query)).where("score > 0")
    return _merge(hits, repos, k, 0)


def _merge(hits: DataFrame, repos: list[str] | None, k: int, digits: int | None) -> DataFrame:
    if not repos or len(repos) == 1:
        return hits.orderBy(F.desc("score"), "ord").limit(k)
    hits = hits.where(F.col("repo").isin(repos)).withColumn("rank_in_repo", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "ord"))).where(F.col("rank_in_repo") <= k)
    return hits.orderBy(F.desc(F.round("score", 2)), repo_position(repos), "rank_in_repo").limit(k)


def embedding_text() -> Column:
    """What of a symbol is embedded: its parts that are not empty."""
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("qualified_name", "kind", "summary", "docstring", "signature", "file")])
    return F.array_join(F.filter(parts, lambda p: p != ""), " | ")


def missing_embeddings(symbols: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Symbols that have no vector of the model yet, with the text to embed."""
    have = embeddings.where(F.col("model") == model).select("repo", F.col("symbol_id").alias("id"))
    return symbols.join(have, ["repo", "id"], "left_anti").select("repo", "id", embedding_text().alias("text"))


def semantic_search(symbols: DataFrame, embeddings: DataFrame, query_vector: list[float], query: str = "", repos: list[str] | None = None, kind: str | None = None, language: str | None = None, glob: str | None = None, k: int = 10, weight: float = 0.7, only: bool = False) -> DataFrame:
    """The k best symbols by vector similarity (only), or by a blend of keyword score and similarity.

    Pure: similarity above 0.1. Blended: rows with no keyword hit and less than 0.1 go, at weight 1 all below 0.1.
    """
    weight = min(max(weight, 0.0), 1.0)
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    v = embeddings.select("repo", F.col("symbol_id").alias("id"), "vec")
    rows = _filters(symbols, kind, language, glob).join(v, ["repo", "id"]).withColumn("similarity", vec.cosine(F.col("vec"), q)).drop("vec")
    if only:
        hits = rows.where("similarity > 0.1").withColumn("score", F.col("similarity"))
    else:
        rows = rows.withColumn("keyword", text.keyword_score(query))
        drop = (F.col("similarity") < 0.1) & ((F.col("keyword") <= 0) | F.lit(weight == 1.0))
        hits = rows.where(~drop).withColumn("score", vec.hybrid(F.col("keyword"), F.col("similarity"), weight))
    return _merge(hits, repos, k, 2)


def lines(contents: DataFrame, redacted: bool = True) -> DataFrame:
    """(repo, file, ord, line, text) of file contents (repo, file, content STRING, ord), secrets replaced before splitting."""
    body = text.redact("content", limit=None) if redacted else F.col("content")
    # outer, as an inner generator would make its array twice, once to filter empty ones
    rows = contents.select("repo", "file", "ord", F.posexplode_outer(F.split(body, "\n")).alias("pos", "text")).where("text is not null")
    return rows.select("repo", "file", "ord", (F.col("pos") + 1).alias("line"), "text")


def text_search(line_rows: DataFrame, query: str, repos: list[str] | None = None, glob: str | None = None, k: int = 20) -> DataFrame:
    """The first k lines that hold the query in any case, in repository, file and line order."""
    hits = line_rows.where(F.lower("text").contains(query.lower()))
    if glob:
        hits = hits.where(text.glob_match("file", glob))
    order = ["ord", "line"]
    if repos:
        hits = hits.where(F.col("repo").isin(repos))
        order = [repo_position(repos), *order]
    return hits.orderBy(*order).limit(k)


def enclosing(hits: DataFrame, symbols: DataFrame, hit_keys: list[str]) -> DataFrame:
    """hits (repo, file, line, more) with the narrowest symbol around each line, the first in index order on ties.

    Lines meet symbols by file and by a bucket of 64 lines, so that a file with very many of both isn't all compared;
    symbols that start or end at no line are skipped; hits without a symbol stay, with nulls.
    """
    s = symbols.where("line > 0 and end_line > 0 and end_line >= line").select("repo", "file", F.struct((F.col("end_line") - F.col("line")).alias("span"), "ord", "id", "name", "kind", "line", "end_line").alias("sym"))
    s = s.select("repo", "file", "sym", F.explode(F.sequence(F.floor(F.col("sym.line") / 64), F.floor(F.col("sym.end_line") / 64))).alias("bucket"))
    h = hits.withColumn("bucket", F.floor(F.col("line") / 64))
    best = h.join(s, ["repo", "file", "bucket"]).where((F.col("line") >= F.col("sym.line")) & (F.col("line") <= F.col("sym.end_line"))).groupBy(*hit_keys).agg(F.min("sym").alias("symbol"))
    return hits.join(best, hit_keys, "left")


def search_references(line_rows: DataFrame, symbols: DataFrame, query: str, glob: str | None = None, k: int = 20) -> DataFrame:
    """text_search with the innermost symbol around each hit."""
    hits = text_search(line_rows, query, None, glob, k)
    out = enclosing(hits, symbols, ["repo", "file", "line"])
    return out.orderBy("ord", "line").select("repo", "file", "line", "text", F.col("symbol.id").alias("symbol_id"), F.col("symbol.name").alias("symbol_name"), F.col("symbol.kind").alias("symbol_kind"))


def changed_symbols(symbols: DataFrame, hunks: DataFrame, cap: int = 100) -> DataFrame:
    """Symbols that a hunk (repo, file, start, end, hunk_ord) overlaps, once each, in hunk and index order, at most cap."""
    s = symbols.select("repo", "file", F.col("line").alias("first"), F.col("end_line").alias("last"), "id", "name", "kind", "ord")
    hit = s.join(small(hunks), ["repo", "file"]).where((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")))
    return hit.groupBy("repo", "id", "name", "kind", "file", "first", "last").agg(F.min(F.struct("hunk_ord", "ord")).alias("at")).orderBy("at").limit(cap).drop("at")
