"""MinHash near-duplicate documents by min-max hashing.

Under each of `perms` permutations both the minimum and the maximum of a document's shingle hashes are kept, which
gives two signature values per hash evaluation. Bands of `rows` values make bucket keys. The work runs on *classes*
(documents with equal shingle sets), so exact copies cost one row each and are never paired:

1. one Python pass: shingle set size, a 128-bit set fingerprint, the band keys;
2. each class is paired with the smallest class of each of its buckets (linear in rows, whatever a bucket's size);
   pairs that agree in at least `agree` bands join a cluster;
3. clusters are cut into blocks of about `block` classes, and every pair of blocks is compared exactly on full
   shingle sets by one task, which returns only a spanning forest of the links it found;
4. distributed union-find over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, group_arrow, map_arrow, mix, shingles, slices, table

#: Texts of one block together hold about this many shingles at most (one longer text stands alone).
BLOCK_SHINGLES = 400_000


def _signer(k: int, bands: int, rows: int):
    perms = -(-bands * rows // 2)
    mult = np.random.default_rng(7).integers(1, 2**63, perms, dtype=np.uint64) | np.uint64(1)

    def sign(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            size, s1, s2, keys = [], [], [], []
            for _, buf, offsets in slices(batch.column(1)):
                sets = shingles(buf, offsets, k)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                size.append(n)
                sums = np.zeros((2, len(n)), np.uint64)
                sig = np.zeros((len(n), 2 * perms), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    sums[0, full] = mix(np.add.reduceat(flat, at))
                    sums[1, full] = mix(np.add.reduceat(mix(flat), at))
                    for j in range(perms):
                        x = flat * mult[j]
                        sig[full, j], sig[full, perms + j] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
                key = np.zeros((len(n), bands), np.uint64)  # all minima first: a band's values come from different permutations
                for b in range(bands):
                    x = np.full(len(n), b + 1, np.uint64)
                    for r in range(rows):
                        x = mix(x + sig[:, b * rows + r])
                    key[:, b] = x
                s1.append(sums[0])
                s2.append(sums[1])
                keys.append(key)
            n, key = np.concatenate(size), np.concatenate(keys).view(np.int64)
            none = n == 0
            ints = lambda x: pa.array(np.concatenate(x).view(np.int64), mask=none)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(none, 0, bands)))).astype(np.int32)), pa.array(key[~none].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), ints(s1), ints(s2), lists], ["doc_id", "key", "n", "s1", "s2", "keys"])

    return sign


def _links(k: int, percent: int):
    """Exact links in one block or between two: rows of a spanning forest (a, b)."""

    def near(key, tbl):
        import pyarrow as pa

        lo, hi = key[1].as_py(), key[2].as_py()
        cid, block = tbl.column("cid").to_numpy(), tbl.column("block").to_numpy()
        sets = [s for _, buf, off in slices(tbl.column("text")) for s in shingles(buf, off, k)]
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, word, df = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)
        shared = df[word] > 1  # what only one text has adds nothing to an intersection
        renum = np.cumsum(df > 1) - 1
        word, owner = renum[word[shared]], owner[shared]
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        both = np.zeros((len(n), len(n)), np.float64)
        step = max(256, 4_000_000 // max(len(n), 1))
        for w in range(0, int(word[-1]) + 1 if len(word) else 0, step):
            a, b = np.searchsorted(word, [w, w + step])
            dense = np.zeros((len(n), step), np.float32)
            dense[owner[a:b], word[a:b] - w] = 1
            both += dense @ dense.T
        inter = np.rint(both).astype(np.int64)
        union = n[:, None] + n[None, :] - inter
        ok = 100 * inter >= percent * union
        if lo != hi:
            ok &= block[:, None] != block[None, :]
        root = list(range(len(n)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1)))):
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((cid[i], cid[j]))
        e = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return near


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, agree: int = 3, block: int = 160) -> DataFrame:
    """Components of documents whose k-word shingle sets have Jaccard similarity of percent/100 or more.

    docs needs doc_id and text; other columns, also clashing ones, are not looked at. One row per input row:
    doc_id, n_shingles (set size), component_id (smallest doc_id reachable, itself included), kept, key (hash of the text).
    Words are runs of anything but ASCII white space, A-Z lower-cased; whole texts count, of any length. Null and
    empty texts have no shingles and are linked with nothing. Rows are told apart by their shingle set: repeated rows
    and equal texts share a component. A null doc_id never becomes a component_id as long as the component has
    another; such rows are linked like all others, and kept if their component has no id. One doc_id on several texts is
    several documents of that id. Empty table: no rows.
    """
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    signed = cut(map_arrow(base, _signer(k, bands, rows), "doc_id long, key long, n long, s1 long, s2 long, keys array<long>"))
    cls = cut(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("key", "doc_id")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")).withColumnRenamed("s1", "cid"))
    spread = cls.select("cid", F.explode("keys").alias("key"))
    lead = spread.groupBy("key").agg(F.min("cid").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "lead")
    pairs = spread.join(lead, "key").where("cid <> lead").select("cid", "lead").distinct()
    sig = cls.select("cid", "keys")
    close = pairs.join(sig, "cid").join(sig.select(F.col("cid").alias("lead"), F.col("keys").alias("of_lead")), "lead").where(F.size(F.array_intersect("keys", "of_lead")) >= agree)
    cluster = components(close.select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    mass = cluster.join(cls.select(F.col("cid").alias("node"), "rep", "n"), "node")
    mass = mass.join(mass.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "comp")
    members = mass.select(F.col("node").alias("cid"), F.col("n").alias("set_size"), "rep", "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # each block meets every block of its cluster once, itself included
    mine = (F.col("key") == F.col("rep.key")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))
    texts = base.join(members, mine).select("cid", "comp", "blocks", "block", "text").dropDuplicates(["cid"])
    meet = texts.select("comp", "cid", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", "block", "text")
    links = group_arrow(meet, ["comp", "lo", "hi"], _links(k, percent), "a long, b long")
    comp = components(links)
    of = cls.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "s2", "least", F.coalesce("comp", "cid").alias("comp"))
    least = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = of.join(least, "comp").select(F.col("cid").alias("s1"), "s2", "component_id")
    out = signed.select("doc_id", "key", "n", "s1", "s2").join(of, ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("key")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM n
  UNION
  SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
