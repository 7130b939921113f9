"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. For each source a threshold on that hash is found whose documents sum to the words
still wanted: sizes are summed by source and hash bucket (512 buckets a level), the bucket in which the running sum
passes the target is split again, and so on until it holds a single hash value. The mix is then a filter; no documents
are sorted, and a rerun or another partitioning gives the same result. Thresholds are nested: a larger target takes a
superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, free_name, small, table, text_of

LEVEL_BITS, LEVELS = 9, 7


def size_of(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def hash_of(doc_id: str, text: str) -> Column:
    """63 bits of a document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)), 1)


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `pos`, the position in code-point order (nulls last), ranked without one sorting task."""
    s = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # one row per partition of a bounded number of partitions
    parts = sorted((r[0], r[1]) for r in s.groupBy(part).count().collect())
    start, seen = {}, 0
    for p, n in parts:
        start[p] = seen
        seen += n
    if not start:
        return s.withColumn("pos", F.col("at"))
    lookup = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    return s.withColumn("pos", lookup[part] + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sizes (source, size): `share` of all sizes by weight, none above most * size.

    What a source can't take is reshared by weight among the rest, until none is above its limit.
    """
    src = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("pos", F.lit(len(weights))) + 1).cast("int"))
    src = cut(src.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")))
    total, weight = src.agg(F.sum("source_size"), F.sum("w")).first()
    budget, level, full = share * float(total or 0), 0.0, -1
    if weight:
        level = budget / weight
        while True:
            over = F.col("cap") <= level * F.col("w")
            n, taken, rest = src.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
            if n == full or not rest:
                break
            full, level = n, max(level, (budget - taken) / rest)
    return src.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def thresholds(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, upto): a document is taken `copies` times, once more if its hash is <= upto."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    want = cut(goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("upto", F.lit(-1).cast("long")))
    for level in range(LEVELS):
        above, shift = 63 - LEVEL_BITS * level, 63 - LEVEL_BITS * (level + 1)
        at = want.where("rest > 0").select(F.col("source").alias("s"), "prefix")
        inside = slim.join(small(at), slim["source"].eqNullSafe(F.col("s")) & (F.shiftright(slim["h"], above) == F.col("prefix"))) if level else slim
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")).where("words > 0")
        if not level:
            hist = cut(hist)
        run = hist.withColumn("below", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        run = run.withColumn("below", F.coalesce("below", F.lit(0))).select(F.col("source").alias("s"), "bucket", "words", "low", "high", "below")
        edge = F.col("source").eqNullSafe(F.col("s")) & (F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("words"))
        hit = want.join(run, edge, "left")
        rest = F.col("rest") - F.col("below")
        done = F.col("low") == F.col("high")
        # the last hash value goes in if that comes nearer to the target
        upto = F.when(done, F.when(2 * rest >= F.col("words"), F.col("low")).otherwise(F.col("low") - 1)).when(F.col("low").isNotNull(), F.shiftleft("bucket", shift) - 1).otherwise(F.col("upto"))
        want = cut(hit.select("source", "source_size", "target", "copies", F.when(F.coalesce(done, F.lit(True)), F.lit(0.0)).otherwise(rest).alias("rest"), F.coalesce("bucket", "prefix").alias("prefix"), upto.alias("upto")))
        if not want.where("rest > 0").limit(1).count():
            break
    return want.select("source", "source_size", "target", "copies", "upto")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source, more) with a last struct column `mix`: size, source_size, target, taken, copies.

    A source's words come within half a document of its target; whole documents are taken, at most `most` times each.
    Rows that agree in doc_id and text share a hash and are taken or left together. Null texts and texts of white
    space alone have size 0; a null source is a source of its own; a source without words has target 0. All columns
    of docs stay as they are (the struct's name gets underscores on a clash). Empty table: no rows.
    """
    slim = cut(docs.select("source", hash_of("doc_id", "text").alias("h"), size_of("text").alias("size")))
    plan = thresholds(slim, targets(slim, weights, share, most))
    plan = plan.select(F.struct("*").alias("plan"))
    r = free_name(docs, "row")
    row = docs.select(F.struct("*").alias(r), "source", hash_of("doc_id", "text").alias("h"), size_of("text").alias("size"))
    row = row.join(small(plan), F.col("source").eqNullSafe(F.col("plan.source")))
    copies = F.col("plan.copies") + (F.col("h") <= F.col("plan.upto")).cast("long")
    mixed = F.struct("size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))
    # the result before the star: an expanded column would take the place of one of the same name here
    name = free_name(docs, "mix")
    return row.select(r, mixed.alias(name)).select(f"{r}.*", name)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
