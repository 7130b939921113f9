"""Exact top-k inner products by MaxScore.

A vector is a document whose terms are (component, sign) pairs. Vectors are dealt over shards, each with a posting list
per term; queries are packed in blocks, and every block meets every shard. For a query, a term's score bound is its
weight times the largest value in the list. Terms are taken from the largest bound down; once the bounds of the rest
add up to less than the k-th best score so far, the rest is non-essential: only vectors in an essential list can still
enter. These candidates are probed in the other terms, largest bound first, while their score plus the remaining bounds
reaches the k-th best. Shard results (k rows a query and shard) are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, group_arrow, map_arrow, table

SHARD_ROWS, BLOCK_QUERIES, FIRST_ROWS = 8192, 1024, 1024


def _pack(key, tbl):
    import pyarrow as pa

    ids = tbl.column("vec_id").to_numpy().astype(np.int64)
    x = np.concatenate([np.asarray(v.values if hasattr(v, "values") else v, np.int64) for v in (c.flatten() for c in tbl.column("x").chunks)])
    order = np.argsort(ids, kind="stable")
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[1].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "x": [x.reshape(len(ids), -1)[order].tobytes()]})


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """(query, vector, score) of each query's k best rows of one shard; a row with the query's own id is left out."""
    n, dim = x.shape
    # sums of products below 2**53 are exact in doubles, whose products are faster
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2**52
    lists = np.ascontiguousarray(x.T.astype(np.float64) if exact else x.T)
    q = q.astype(lists.dtype)
    posting = {1: np.maximum(lists, 0), -1: np.minimum(lists, 0)}
    high, low = posting[1].max(1, initial=0), posting[-1].min(1, initial=0)
    out = []
    for qid, w in zip(qids.tolist(), q):
        bound = np.where(w > 0, w * high, w * low)
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))
        # the k-th best exact score of the first rows starts the threshold
        first = (w @ lists[:, :FIRST_ROWS])[ids[:FIRST_ROWS] != qid]
        least = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else None
        if least is None:
            at, cand = 0, np.flatnonzero(ids != qid)
            score = np.zeros(len(cand), lists.dtype)
        else:
            # essential terms: up to the first whose bound, with all after it, is below the threshold
            at = min(int(np.searchsorted(-rest, -least, "right")), int((bound > 0).sum()))
            up, down = terms[:at][w[terms[:at]] > 0], terms[:at][w[terms[:at]] < 0]
            acc = w[up] @ posting[1][up] + w[down] @ posting[-1][down]
            cand = np.flatnonzero((acc + rest[at] >= least) & (ids != qid))
            # the candidates' exact scores in the essential terms
            score = w[terms[:at]] @ lists[terms[:at]][:, cand]
        for i in range(at, dim):
            if least is not None and i % 4 == at % 4:
                fit = score + rest[i] >= least
                cand, score = cand[fit], score[fit]
            score = score + w[terms[i]] * lists[terms[i], cand]
        best = np.lexsort((ids[cand], -score))[:k]
        out += [(qid, int(ids[cand[j]]), int(score[j])) for j in best]
    return out


def _search(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                x, q = np.frombuffer(r["x"], np.int64).reshape(len(ids), -1), np.frombuffer(r["q"], np.int64).reshape(len(qids), -1)
                got = search_shard(ids, x, qids, q, k)
                cols = list(zip(*got)) if got else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of `vectors` with the highest integer inner product for each row of `queries`.

    Both need vec_id long and x array<long>; only vectors of one length are compared. Rows: query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id; fewer rows if there are fewer vectors. A row with the query's own id
    is no result for it; repeated rows each count. Null ids, null or empty vectors and vectors with a null component
    take no part. Empty tables give no rows. Sums must fit 64 bits.
    """

    def packed(df: DataFrame, rows: int) -> DataFrame:
        df = df.where("vec_id is not null and size(x) > 0 and not exists(x, v -> v is null)").select("vec_id", "x", F.size("x").alias("dim"))
        slots = df.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("slots"))
        df = df.join(slots, "dim").select("vec_id", "x", "dim", F.pmod(F.xxhash64("vec_id"), F.col("slots")).cast("int").alias("slot"))
        return cut(group_arrow(df, ["dim", "slot"], _pack, "dim int, slot int, ids binary, x binary"))

    shards, blocks = packed(vectors, SHARD_ROWS), packed(queries, BLOCK_QUERIES).select("dim", F.col("slot").alias("block"), F.col("ids").alias("qids"), F.col("x").alias("q"))
    # every block of queries meets every shard of its dimension; both are packed rows of bounded size
    per = blocks.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    # one task or so for each: a fixed number of partitions is not merged into fewer
    n = max(1, min(10_000, shards.count() * max(1, blocks.count())))
    meet = shards.join(per, "dim").withColumn("block", F.explode("blocks")).drop("blocks").join(blocks, ["dim", "block"]).repartition(n, "dim", "slot", "block")
    found = map_arrow(meet.select("ids", "x", "qids", "q"), _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x = floor(scale * component) in double; vectors that are null or hold a null, NaN or infinity go."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def op2_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integers(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return top_k(v, v.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(generate_series(1, len(v.x)), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
