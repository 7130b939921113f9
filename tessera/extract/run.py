"""Extraction over a contents table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.extract import patterns, python_source
from tessera.extract.languages import LANGUAGES
from tessera.functions import text

RAW = "repo STRING, file STRING, name STRING, qualified_name STRING, kind STRING, language STRING, parent STRING, line INT, end_line INT, byte_offset BIGINT, byte_length BIGINT, content_hash STRING, signature STRING, docstring STRING, decorators ARRAY<STRING>, calls ARRAY<STRING>, imports ARRAY<STRING>, inherits_from ARRAY<STRING>, implements ARRAY<STRING>, " + f"complexity {schemas.COMPLEXITY}, id STRING, seq INT, file_ord BIGINT"


def symbol_id(file: str, qualified: str, kind: str) -> str:
    return f"{file.replace('::', '%3A%3A')}::{qualified.replace('#', '%23')[:400]}{'#' + kind if kind and qualified != '(module)' else ''}"[:500]


def parse(content: str, file: str, language: str) -> list[dict]:
    """Rows of one file in order; ids of overloads get ~1, ~2 and so on, and children point at the first."""
    lang = LANGUAGES.get(language)
    if lang is None:
        return []
    rows = python_source.extract(content, file) if language == "python" else patterns.extract(content, file, lang)
    for r in rows:
        r["id"] = symbol_id(file, r["qualified_name"], r["kind"])
    count: dict[str, int] = {}
    for r in rows:
        count[r["id"]] = count.get(r["id"], 0) + 1
    seen: dict[str, int] = {}
    base = {id(r): r["id"] for r in rows}
    for r in rows:
        b = base[id(r)]
        if count[b] > 1:
            seen[b] = seen.get(b, 0) + 1
            r["id"] = f"{b}~{seen[b]}"
    for i, r in enumerate(rows):
        p = r["parent"]
        r["parent"] = None if p is None else (f"{base[id(p)]}~1" if count[base[id(p)]] > 1 else base[id(p)])
        r["seq"] = i
    return rows


def extract(contents: DataFrame) -> DataFrame:
    """Symbol rows (schema SYMBOLS) of contents (repo, file, language, content BINARY, ord); files without symbols give none."""
    fields = [f.strip().split(" ", 1)[0] for f in ("repo", "file", "name", "qualified_name", "kind", "language", "parent", "line", "end_line", "byte_offset", "byte_length", "content_hash", "signature", "docstring", "decorators", "calls", "imports", "inherits_from", "implements", "complexity", "id", "seq", "file_ord")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for repo, file, language, content, ord_ in zip(pdf["repo"], pdf["file"], pdf["language"], pdf["content"], pdf["ord"]):
                for r in parse(bytes(content or b"").decode("utf-8", "replace"), file, language):
                    out.append([repo, *[r.get(f) for f in fields[1:-1]], int(ord_)])
            yield pd.DataFrame(out, columns=fields)

    raw = contents.select("repo", "file", "language", "content", "ord").mapInPandas(run, RAW)
    redacted = raw.withColumn("signature", text.redact("signature")).withColumn("docstring", text.redact("docstring"))
    for c in ("calls", "imports", "inherits_from", "implements", "decorators"):
        redacted = redacted.withColumn(c, text.clean_list(c))
    first = text.docstring_summary("docstring")
    out = redacted.withColumn("summary", F.when(F.length(first) > 0, first).otherwise(text.signature_summary()))
    # index order: by file, then by place in the file
    order = F.shiftleft("file_ord", 20) + F.col("seq")
    return out.select("repo", "id", "file", "name", "qualified_name", "kind", "language", "signature", "docstring", "summary", "decorators", F.array().cast("array<string>").alias("keywords"), "parent", "line", "end_line", "byte_offset", "byte_length", "content_hash", "calls", "imports", "inherits_from", "implements", "complexity", order.alias("ord"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
