"""From raw documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, line_dedup, mixing, near_dup
from tessera.llm.common import cut, free_name, remove, small, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: without letters, or ambiguous with less than even odds, they go.

    Learns from the rows' own lang labels; where no row has one, only texts without letters go. Null, empty and blank
    texts have no letters and go. Rows that stay are unchanged, repeated ones included; texts of any length are read
    whole; further columns, whatever their names, stay. An empty table stays empty.
    """
    r = free_name(docs, "row")
    packed = docs.select(F.struct("*").alias(r), "doc_id", "text", "lang")
    if not docs.where("lang is not null and text is not null").limit(1).count():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.identify(packed, F.lit(True), keep=(r,), text_in=r)
    return known.where((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < 0.5))).select(f"{r}.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that near or equal lines precede; documents that had lines and kept none go.

    Null, empty and blank texts stay as they are. Rows that agree in doc_id and text are one document. n_chars, where
    there is one, follows the text. Texts of any length are read whole, ties go to the first position; further columns
    stay whatever their names. An empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs)
    made = F.col(out.columns[-1])
    left = made["n_dropped"] > 0
    blank = F.btrim(made["text"], F.lit(" \t\r\n\x0b\x0c")) == ""
    text = F.when(left, made["text"]).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left, F.length(made["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~(left & blank)).select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the least doc_id.

    Of rows that agree in doc_id and text the one that is least as JSON stays. Null, empty and blank texts are near to
    nothing and stay (one for each doc_id). Several texts under one doc_id are several documents. Texts of any length are
    read whole; further columns stay whatever their names. An empty table stays empty.
    """
    found = near_dup.near_duplicates(docs, k=5, percent=80)
    i, k = free_name(docs, "at_id"), free_name(docs, "at_key")
    gone = small(cut(found.where(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()))
    same = (F.xxhash64("text") == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i))
    rest = docs.join(gone, same, "left_anti")
    twice = docs.select(F.col("doc_id").alias(i), F.xxhash64("text").alias(k)).groupBy(i, k).agg(F.count("*").alias("rows"))
    twice = small(cut(twice.where("rows > 1").select(i, k)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = rest.join(twice, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return rest.join(twice, same, "left_anti").unionByName(again.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither copied nor re-parameterised; all rows of a text share its fate.

    Null and empty texts hold nothing and stay, as do repeated rows. Texts of any length are read whole; further columns
    stay whatever their names. An empty table, of documents or of the benchmark, takes nothing away.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    k = free_name(docs, "at_key")
    bad = cut(decontam.contaminated(docs, items).select(F.col("key").alias(k)).distinct())
    return docs.join(small(bad), F.xxhash64("text") == F.col(k), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and copies (1 or 2 times the document).

    The new columns are mix_size, mix_source_size, mix_target, mix_taken and mix_copies (with underscores on a clash).
    Null, empty and blank texts have no words and are not taken. A null source is a source. Rows that agree in doc_id and
    text are taken alike. An empty table stays empty.
    """
    out = mixing.mix_sources(docs)
    made = F.col(out.columns[-1])
    return out.where(made["taken"] > 0).select(*docs.columns, *[made[c].alias(free_name(docs, f"mix_{c}")) for c in ("size", "source_size", "target", "taken", "copies")])


STAGES = [("language", language), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontaminate", benchmark), ("mix", mix)]
#: SQL can't express the trained classifier, the hash thresholds and the template slots; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents; what a stage returns is written to the shared folder and read again by the next.

    Each table goes when the next one is written; the result is a checkpoint, which Spark removes when it is not needed.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), last
        if i < len(STAGES) - 1:
            docs, last = written(docs)
        else:
            docs = cut(docs)
        if before:
            remove(spark, before)
    return docs
