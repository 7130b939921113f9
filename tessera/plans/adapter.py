"""The engine's tables as views over the driver's tables, which hold no source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: brand as file, name as name, type as kind, size as first line."""
    p = table(spark, sf_dir, "part")
    cx = F.struct((F.col("p_size") % 9 + 1).cast("int").alias("cyclomatic"), (F.col("p_size") % 13).cast("int").alias("cognitive"), (F.col("p_partkey") % 5).cast("int").alias("max_nesting"), (F.col("p_partkey") % 4).cast("int").alias("param_count"), F.col("p_size").alias("loc"))
    return p.select(
        F.lit("parts").alias("repo"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"),
        F.lit("function").alias("kind"), F.col("p_type").alias("language"), F.col("p_type").alias("signature"), F.col("p_brand").alias("summary"), F.lit("").alias("docstring"),
        F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("decorators"), F.col("p_size").alias("line"), (F.col("p_size") + 10).alias("end_line"),
        F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("content_hash"), cx.alias("complexity"), F.col("p_partkey").alias("ord"),
    )


SYMBOLS_SQL = "SELECT p_partkey AS id, p_brand AS file, p_name AS name, p_type AS language, p_size AS line, p_size + 10 AS end_line, p_size % 9 + 1 AS cyclomatic, p_size % 13 AS cognitive, p_partkey % 5 AS max_nesting FROM part"


def call_edges(spark: SparkSession, sf_dir: str, least: int = 35) -> DataFrame:
    """An order's lines of `least` units and more give one edge between its lowest and highest part."""
    e = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a <> b")
    even = (F.col("a") + F.col("b")) % 2 == 0
    return e.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("dst")).distinct()


def edges_sql(least: int = 35) -> str:
    return f"SELECT DISTINCT CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS src, CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS dst FROM (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem WHERE l_quantity >= {least} GROUP BY l_orderkey) WHERE a <> b"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file contents: source as repository, id as file and as order."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("tool_name"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time_ms"), F.col("user_id").cast("string").alias("session_id"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the url without scheme as path, its last part's language directory as language."""
    p = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("repo"), F.regexp_replace(p, "[?#].*$", "").alias("file"), F.regexp_extract(p, "^[^/]+/([a-z]{2})/", 1).alias("language")).distinct()
