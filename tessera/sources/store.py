"""The index: Parquet tables in a warehouse folder, partitioned by repository."""

from __future__ import annotations

import os
import re
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import graph, quality
from tessera.plans.lineage import cut, small

TABLES = {"symbols": schemas.SYMBOLS, "files": schemas.FILES, "contents": schemas.CONTENTS, "repos": schemas.REPOS, "edges": schemas.EDGES, "imports": schemas.IMPORTS, "embeddings": schemas.EMBEDDINGS}
NAME = re.compile(r"[A-Za-z0-9_\-.]{1,100}")


def guarded(folder: str) -> str:
    """folder, if an index may be kept there: an absolute path or an address; a local one that exists must belong to this user
    and not be open to writing by all. Raises ValueError."""
    scheme, _, rest = folder.partition(":")
    path = rest if scheme == "file" else folder
    if scheme != "file" and re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", folder):
        return folder  # another file system judges by its own rights
    if not os.path.isabs(path):
        raise ValueError("the warehouse is an absolute path")
    if os.path.exists(path):
        at = os.stat(path)
        if at.st_uid != os.getuid() or at.st_mode & 0o002:
            raise ValueError("the warehouse belongs to another user or all may write to it")
    return folder


class Store:
    """Reads and writes one warehouse folder. Writers of a repository take turns by a lock file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, guarded(folder).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def table(self, name: str, repos: list[str] | str | None = None) -> DataFrame:
        """A table, of some repositories (partitions not asked for are not read); empty if never written."""
        if not self.exists(self.path(name)):
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.schema(TABLES[name]).parquet(self.path(name))
        return df if repos is None else df.where(F.col("repo").isin([repos] if isinstance(repos, str) else repos))

    def resolve(self, repo: str) -> str:
        """The repository that a name means: owner/name, a bare name, or a folder's name without its hash."""
        same = [F.col("repo") == repo, F.col("name") == repo, F.regexp_replace("name", "-[0-9a-f]{12}$", "") == repo]
        how = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(same)])
        hits = self.table("repos").select("repo", how.alias("how")).where("how is not null").orderBy("how").limit(2).collect()
        if len(hits) == 2 and hits[0]["how"] == hits[1]["how"] or not hits:
            raise LookupError(f"repository {'is ambiguous' if hits else 'not found'}: {repo}")
        return hits[0]["repo"]

    @contextmanager
    def _lock(self, repo: str, wait: float = 30.0):
        """A lock file made by exclusive creation; one older than an hour is taken over."""
        fs, p = self._fs(f"{self.folder}/_locks/{repo.replace('/', '__')}")
        deadline = time.time() + wait
        while not fs.createNewFile(p):
            if time.time() * 1000 - fs.getFileStatus(p).getModificationTime() > 3_600_000:
                fs.delete(p, False)
            elif time.time() > deadline:
                raise TimeoutError(f"{repo} is being written")
            else:
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(p, False)

    def _partition(self, name: str, repo: str) -> str:
        return f"{self.path(name)}/repo={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)}"

    def _replace(self, name: str, df: DataFrame, repo: str | None = None) -> None:
        """Replace the partitions of the repositories in df; the new files are complete before the old ones go.

        A dynamic overwrite leaves partitions alone that get no row: with `repo`, one left without rows is deleted.
        """
        if repo is not None:
            df = cut(df)
            if not df.limit(1).count():
                fs, p = self._fs(self._partition(name, repo))
                fs.delete(p, True)
                return
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(self.path(name))

    def save(self, owner: str, name: str, files: DataFrame, symbols: DataFrame, git_head: str | None = None) -> str:
        """Write an index: files (repo, file, language, content, sha256, n_bytes, ord) and their symbols."""
        if not NAME.fullmatch(owner) or not NAME.fullmatch(name) or ".." in owner + name:
            raise ValueError("not a repository name")
        repo = f"{owner}/{name}"
        with self._lock(repo):
            self._replace("contents", files.select("repo", "file", "content").repartitionByRange("file").sortWithinPartitions("file"), repo)
            self._replace("files", files.select("repo", "file", "language", "sha256", "n_bytes", "ord"), repo)
            self._replace("symbols", symbols.repartitionByRange("file").sortWithinPartitions("file", "line"), repo)
            self._derive(repo, owner, name, git_head)
        return repo

    def _derive(self, repo: str, owner: str, name: str, git_head: str | None) -> None:
        s, f = self.table("symbols", repo), self.table("files", repo)
        self._replace("edges", graph.edges(s), repo)
        self._replace("imports", graph.import_edges(s), repo)
        langs = f.join(s.select("repo", "file").distinct(), ["repo", "file"], "left_semi").groupBy("language").agg(F.count("*").cast("int").alias("n"))
        langs = langs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
        row = s.agg(F.count("*").alias("symbol_count")).crossJoin(f.agg(F.count("*").alias("file_count"))).crossJoin(langs)
        row = row.select(F.lit(repo).alias("repo"), F.lit(owner).alias("owner"), F.lit(name).alias("name"), F.current_timestamp().alias("indexed_at"), F.lit(schemas.INDEX_VERSION).alias("index_version"), F.lit(git_head).cast("string").alias("git_head"), "symbol_count", "file_count", "languages")
        self._replace("repos", row)

    def update(self, owner: str, name: str, files: DataFrame, extract, git_head: str | None = None) -> DataFrame:
        """Bring an index up to date with files: only changed and new ones are extracted anew, deleted ones go.

        Returns (file, status). Vectors of symbols whose text changed or that are gone are dropped.
        """
        repo = f"{owner}/{name}"
        old_f, old_s = self.table("files", repo), self.table("symbols", repo)
        changes = cut(quality.detect_changes(old_f, files))
        touched = changes.select("file")
        fresh = extract(files.join(touched, "file", "left_semi"))
        merged = cut(old_s.join(touched, "file", "left_anti").unionByName(fresh))
        stale = cut(self.stale(old_s, merged))
        kept = cut(self.table("embeddings", repo).join(stale.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti"))
        self.save(owner, name, cut(files), merged, git_head)
        if self.exists(self.path("embeddings")):
            self._replace("embeddings", kept, repo)
        return changes

    @staticmethod
    def stale(old: DataFrame, new: DataFrame) -> DataFrame:
        """Ids whose summary or signature changed, or that are gone."""
        n = new.select("id", F.struct("summary", "signature").alias("n"))
        return old.select("id", F.struct("summary", "signature").alias("o")).join(n, "id", "left").where(~F.col("o").eqNullSafe(F.col("n"))).select("id")

    def upsert_embeddings(self, rows: DataFrame) -> None:
        """Add vectors; a new vector of a symbol and model replaces the old one."""
        key = ["repo", "symbol_id", "model"]
        before = self.table("embeddings").join(small(cut(rows.select("repo").distinct())), "repo", "left_semi")
        self._replace("embeddings", cut(before.join(rows.select(*key), key, "left_anti").unionByName(rows)))

    def drop(self, repo: str, confirm: bool = False) -> bool:
        """Delete all that belongs to a repository, if confirmed."""
        if not confirm:
            return False
        with self._lock(repo):
            for t in TABLES:
                fs, p = self._fs(self._partition(t, repo))
                fs.delete(p, True)
        self.spark.catalog.clearCache()
        return True


def folder_identity(folder: str) -> str:
    """The name of a local folder's index: its base name and a hash of its path."""
    import hashlib

    real = os.path.realpath(folder)
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '-', os.path.basename(real)) or 'root'}-{hashlib.sha256(real.encode()).hexdigest()[:12]}"
