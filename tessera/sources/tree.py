"""Source trees: local folders and listings, filtered to indexable files."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.extract.languages import EXTENSIONS
from tessera.functions import text

# ---- fixed values: path parts that are never indexed, and directories that come first when there are too many files
SKIP = "../ node_modules/ vendor/ venv/ .venv/ __pycache__/ dist/ build/ .git/ .tox/ .mypy_cache/ target/ .gradle/ test_data/ testdata/ fixtures/ snapshots/ migrations/ .min.js .min.ts .bundle.js package-lock.json yarn.lock go.sum generated/ proto/".split()
FIRST_DIRS = "src/ lib/ pkg/ cmd/ internal/".split()
IGNORE_BYTES, IGNORE_LINES, IGNORE_LENGTH = 65_536, 2_000, 200


def should_skip(path: str | Column = "path") -> Column:
    c = F.replace(text.col(path), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for s in SKIP:
        out = out | c.contains(s)
    return out


def priority(path: str | Column = "path") -> list[Column]:
    """Sort keys: preferred directory, depth, path."""
    c = text.col(path)
    rank = F.when(F.lit(False), 0)
    for i, d in enumerate(FIRST_DIRS):
        rank = rank.when(c.startswith(d), i)
    return [rank.otherwise(len(FIRST_DIRS)), F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))), c]


def language(path: str | Column = "path") -> Column:
    """Language by extension, which is case-sensitive."""
    m = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(m, text.extension(path))


def safe_path(path: str | Column = "path") -> Column:
    """No control characters, no backslashes, no empty or dot segments, not too long or deep."""
    c = text.col(path)
    return ~c.rlike(r"[\x00-\x1f\x7f\\]") & ~c.rlike(r"(^|/)\.{1,2}(/|$)|^/|//") & (F.length(c) <= schemas.MAX_PATH) & (F.size(F.split(c, "/")) <= schemas.MAX_DEPTH + 1)


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regex on paths, negated) of one line of an ignore file; None for blanks and comments."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#") or len(p) > IGNORE_LENGTH:
        return None
    negated, p = p.startswith("!"), p.removeprefix("!")
    folder, p = p.endswith("/"), p.strip("\\").rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + f"[{'^' + body[1:] if body[0] == '!' else body}]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), negated


def ignored(path: str | Column, ignore: str | None) -> Column:
    """Whether an ignore file covers a path: the last line that fits decides."""
    c, out = text.col(path), F.lit(False)
    if not ignore or len(ignore) > IGNORE_BYTES:
        return out
    for rx in filter(None, map(ignore_regex, ignore.split("\n")[:IGNORE_LINES])):
        out = F.when(c.rlike(rx[0]), not rx[1]).otherwise(out)
    return out


def capped(files: DataFrame, path: str = "path", cap: int = schemas.MAX_FILES) -> DataFrame:
    """Over the cap only the first files by priority stay."""
    if files.limit(cap + 1).count() <= cap:
        return files
    return files.orderBy(*priority(path)).limit(cap)


def filter_entries(entries: DataFrame, ignore: str | None = None, cap: int = schemas.MAX_FILES, max_bytes: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    """Rows of a listing (path, type, size) that are indexable files: one filter over pushed-down predicates, then the cap."""
    ok = (F.col("type") == "blob") & safe_path() & language().isNotNull() & ~should_skip() & ~text.is_secret_file("path") & ~text.is_binary_file("path")
    ok = ok & (F.coalesce(F.expr("try_cast(size AS BIGINT)"), F.lit(0)) <= max_bytes) & ~ignored("path", ignore)
    return capped(entries.where(ok), "path", cap)


def read_folder(spark: SparkSession, folder: str, repo: str, ignore: str | None = None, extra: list[str] | None = None, cap: int = schemas.MAX_FILES, max_bytes: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    """(repo, file, language, content, sha256, n_bytes, ord) of the indexable files below a folder.

    Size and path predicates come before the content column is used, so skipped files are not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.sub(r"^file:/+", "/", folder.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/"), "^" + re.escape(re.sub("^[a-z]+:/+", "/", root)).replace("\\/", "/") + "/", "")
    f = raw.where(F.col("length") <= max_bytes).withColumn("file", rel)
    more = ignore if not extra else "\n".join([ignore or "", *extra[:20]])
    f = f.where(safe_path("file") & language("file").isNotNull() & ~should_skip("file") & ~text.is_secret_file("file") & ~text.is_binary_file("file") & ~ignored("file", more))
    f = f.where(~text.is_binary_content("content"))
    f = capped(f.select(F.lit(repo).alias("repo"), "file", language("file").alias("language"), "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes")), "file", cap)
    # at most `cap` files of one repository
    return f.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("file")).cast("int") - 1)


def parse_repo_url(url: str) -> tuple[str, str]:
    """Owner and name of https://github.com/owner/name or owner/name."""
    m = re.fullmatch(r"(?:https://github\.com/)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?", url.strip())
    if not m or ".." in url:
        raise ValueError("not a repository address")
    return m.group(1), m.group(2)


def glob_any(names: list[str], patterns: list[str]) -> list[str]:
    return [n for n in names if any(fnmatch.fnmatch(n, p) for p in patterns)]
