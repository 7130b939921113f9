"""Usage records as a stream, and the call limiter."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas

#: Calls a tool and all tools together may make within the window; timestamps further in the future are not believed.
PER_TOOL, GLOBAL, WINDOW_S, FUTURE_S = 60, 300, 60.0, 5.0
#: Calls that one Python call decides on, about (a stretch without a pause is never parted).
BUNDLE = 20_000


def read_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage records from a folder of JSON lines, as a stream."""
    return spark.readStream.schema(schemas.USAGE).json(folder)


def usage_windows(usage: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, errors and mean time per tool and window; records later than `late` behind the newest are left out.

    Works on streams and on tables alike.
    """
    u = usage.withWatermark("ts", late)
    out = u.groupBy("tool_name", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), F.count(F.when(~F.col("success"), 1)).alias("errors"), F.round(F.avg("response_time_ms"), 1).alias("avg_ms"))
    return out.select("tool_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "errors", "avg_ms")


def admit(calls: Iterable[tuple[str, float]], taken: list[tuple[str, float]], limit: int = PER_TOOL, overall: int = GLOBAL, window: float = WINDOW_S) -> tuple[list[bool], list[tuple[str, float]]]:
    """Which calls (tool, time; in order) are let through, given those `taken` before, and what is taken then.

    A tool may make `limit` calls in the window and all tools together `overall`. Calls that are denied don't count
    against later ones, nor do times more than FUTURE_S ahead. A call without a time is denied.
    """
    out, now, per = [], deque(sorted(taken, key=lambda x: x[1])), Counter(t for t, _ in taken)
    for tool, at in calls:
        if at is None or math.isnan(at):
            out.append(False)
            continue
        while now and now[0][1] <= at - window:
            per[now.popleft()[0]] -= 1
        while now and now[-1][1] > at + FUTURE_S:
            per[now.pop()[0]] -= 1
        ok = per[tool] < limit and len(now) < overall
        if ok:
            now.append((tool, at))
            per[tool] += 1
        out.append(ok)
    return out, list(now)


ALLOWED = "tool_name string, ts timestamp, call_id long, allowed boolean"


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["ts", "call_id"])


def _events(pdf: pd.DataFrame) -> list[tuple[str, float | None]]:
    return [(tool, None if pd.isna(t) else t.timestamp()) for tool, t in zip(pdf["tool_name"], pdf["ts"])]


def limited(calls: DataFrame, limit: int = PER_TOOL, overall: int = GLOBAL, window: float = WINDOW_S) -> DataFrame:
    """calls (tool_name, ts, call_id) of a table with `allowed`, in time order.

    A pause longer than the window makes what follows independent of what came before: calls are cut into stretches at
    such pauses (found among the distinct window-long slots that hold a call), and bundles of stretches run apart. A
    bundle passes through Python batch by batch in time order, with the calls let through within the window as the state.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(int(window * 1e6)))
    rows = calls.select("tool_name", "ts", "call_id", slot.alias("slot"))
    order = Window.orderBy("slot")  # over slots that hold a call, of which a day has 1,440 at most
    slots = rows.groupBy("slot").count().withColumn("new", (F.col("slot") - F.lag("slot").over(order) > 1).cast("int"))
    slots = slots.select("slot", (F.sum("count").over(order) - F.col("count")).alias("before"), F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(order), F.lit(0)).alias("stretch"))
    slots = slots.select(F.col("slot").alias("at"), F.floor(F.min("before").over(Window.partitionBy("stretch")) / BUNDLE).alias("bundle"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, bundle = [], None  # all that is kept from batch to batch
        for pdf in batches:
            allowed = []
            for at, some in pdf.groupby("bundle", sort=False):  # a partition has one bundle after the other
                taken = taken if at == bundle else []
                passed, taken = admit(zip(some["tool_name"], (some["micros"] / 1e6).tolist()), taken, limit, overall, window)
                allowed, bundle = allowed + passed, at
            pdf["allowed"] = allowed
            yield pdf[["tool_name", "micros", "call_id", "allowed"]]

    timed = rows.where("ts is not null").join(slots, F.col("slot") == F.col("at")).select("tool_name", F.unix_micros("ts").alias("micros"), "call_id", "bundle")
    timed = timed.repartition("bundle").sortWithinPartitions("bundle", "micros", "call_id").mapInPandas(run, "tool_name string, micros long, call_id long, allowed boolean")
    timed = timed.select("tool_name", F.timestamp_micros("micros").alias("ts"), "call_id", "allowed")
    return timed.unionByName(rows.where("ts is null").select("tool_name", "ts", "call_id", F.lit(False).alias("allowed")))


def limited_stream(calls: DataFrame, limit: int = PER_TOOL, overall: int = GLOBAL, window: float = WINDOW_S) -> DataFrame:
    """The same on a stream. As all tools share one limit there is one state, of the calls let through within the window
    (at most `overall`)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        taken = list(zip(*state.get)) if state.exists else []
        rows = _in_order(pd.concat(list(batches)))
        allowed, taken = admit(_events(rows), taken, limit, overall, window)
        state.update(([t for t, _ in taken], [x for _, x in taken]))
        rows["allowed"] = allowed
        yield rows[["tool_name", "ts", "call_id", "allowed"]]

    grouped = calls.select("tool_name", "ts", "call_id", F.lit(0).alias("all")).groupBy("all")
    return grouped.applyInPandasWithState(run, ALLOWED, "tools array<string>, times array<double>", "append", "NoTimeout")


def log_usage(rows: DataFrame, folder: str) -> None:
    """Append usage records as JSON lines, times rounded to ten milliseconds."""
    from tessera.functions import text

    rows.withColumn("response_time_ms", text.rounded_ms("response_time_ms")).write.mode("append").json(folder)


def reindex_stream(spark: SparkSession, folder: str, update) -> object:
    """Watch a folder of changed source files; each batch of paths and bytes goes to update(batch_df)."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.writeStream.foreachBatch(lambda df, _: update(df))
