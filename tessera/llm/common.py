"""Shared pieces: lineage cutting, size-checked broadcasts, connected components, word hashing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of a text are the maximal runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a counted side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: Bytes up to which it is, whatever its rows.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that one vectorised step takes at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 20

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever the driver imported it from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def with_fields(df: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """The schema of the columns `keep` of df followed by the fields `more`."""
    return T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(more).fields])


def release() -> None:
    """Give freed memory of this Python worker back; workers live on from task to task beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        for out in f(batches):
            yield out
            del out
            release()

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], f, schema) -> DataFrame:
    ship(df.sparkSession)

    def run(key, tbl):
        out, large = f(key, tbl), tbl.nbytes > 4 << 20
        if large:
            del tbl
            release()
        return out

    return df.groupBy(*keys).applyInArrow(run, schema)


def _shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of the warehouse, which executors share too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
    return spark.sparkContext.getCheckpointDir()


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Plans made inside delete their shuffle files as soon as their action has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so lost executors cost no recomputation.

    The shuffle files behind it go at once; Spark removes the checkpoint once nothing refers to it (cleanCheckpoints).
    """
    _shared(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own: df itself stays usable


def written(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path; remove() deletes it."""
    path = f"{_shared(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path, **options)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value, as it is sent."""
    if isinstance(kind, T.StructType):
        out = F.lit(8)
        for f in kind.fields:
            out = out + _width(f"{name}.`{f.name}`", f.dataType)
        return out
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        each = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(each, (T.StringType, T.BinaryType)) and isinstance(kind, T.ArrayType):
            return F.aggregate(F.coalesce(name, F.array().cast(kind)), F.lit(16).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
        return F.coalesce(F.size(name), F.lit(0)) * 64 + 16
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most `limit` rows and BROADCAST_BYTES, else df as it is.

    The measure runs df's plan: cut df first unless it is cheap.
    """
    size = F.lit(8).cast("long")
    for f in df.schema.fields:
        size = size + _width(f"`{f.name}`", f.dataType)
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b): one row (node, comp) per node, comp the smallest id reachable.

    Distributed union-find by alternating large-star and small-star steps. Both steps use partial minima and
    joins, never a list of neighbours, so a node with very many links is split like any skewed join key.
    Null ends and self loops are left out; repeated rows change nothing; empty input gives no rows.
    """
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("a is not null and b is not null and u > v").distinct()
    e, seen = cut(e), None
    for _ in range(max_rounds):
        # large star: every larger neighbour of x goes to x's smallest neighbour (or x)
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: x and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# ---------------------------------------------------------------- vectorised word hashing (numpy)

_rng = np.random.default_rng(20240611)
#: A random 64-bit value per byte (A-Z as a-z), and an odd base with its inverse modulo 2**64.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_RAW = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1 << 62, 2**63, dtype=np.uint64)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        n = max(n, SLICE_BYTES) + 1
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.ones(1, np.uint64)
            while len(x) < n:  # doubling: x[k + len] = x[k] * base**len
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))])
            _POW[key] = x[:n]
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of buf[start:end] for all spans at once (prefix sums of a polynomial hash)."""
    p, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE if fold else _RAW)[buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of the texts buf[offsets[i]:offsets[i+1]]; text i has words first[i]:first[i+1]."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def slices(column):
    """(first row, uint8 buffer, offsets) over an Arrow string column, some SLICE_BYTES at a time; nulls are empty texts."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles (A-Z lower-cased).

    A text of fewer than k words has its whole sequence as the one shingle; without words, none.
    """
    start, end, first = words_of(buf, offsets)
    h = span_hashes(buf, start, end)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = mix(rolled + h[j : len(h) - k + 1 + j]) if len(rolled) else rolled
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = mix(np.array([x + w], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
