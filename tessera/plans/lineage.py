"""Cutting lineage in iterative plans, and broadcasts behind a size check."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
#: Rows of a table in one of its fixed partitions, about.
PARTITION_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (one in the warehouse where that is unset) and read from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
    return df.checkpoint()


@contextlib.contextmanager
def fixed(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hash partitions, of a number for so many rows, stay from step to step (adaptive plans forget them): tables that are
    cut after repartition(key) are joined on the key without a shuffle."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(4, rows // PARTITION_ROWS + 1))}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
