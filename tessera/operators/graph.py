"""Graph operators over edge tables (src, dst): resolution of names to symbols, bounded searches, paths, ranks, cycles.

Searches grow a frontier by one join a level and cut lineage at every level, so their cost follows what they reach and
not the size of the whole graph. A depth is at most MAX_DEPTH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, fixed, small

MAX_DEPTH = 50
#: Extensions whose modules are imported by dotted names (fixed values).
DOTTED = ".py .java .kt .kts .scala .groovy .clj .cljs .cljc .ex .exs .erl .hrl .jl".split()


# ---------------------------------------------------------------- building


def resolve(refs: DataFrame, symbols: DataFrame, keep_unresolved: bool = False) -> DataFrame:
    """refs (repo, src, file, name) to edges (repo, src, dst, resolved).

    A name means the one symbol of that name in the same file, else the only one in the repository, else nothing (or,
    with keep_unresolved, the bare name). Edges of a symbol to itself are dropped. Uniqueness comes from two small
    aggregates over names, not from windows over all candidate pairs, so a very common name costs no more than others.
    """
    by_file = symbols.groupBy("repo", "file", "name").agg(F.count("*").alias("n"), F.min("id").alias("local")).where("n = 1").drop("n")
    # names in one file more than once are not settled by the file
    clash = symbols.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1").drop("n")
    refs = refs.select("repo", "src", "file", "name").where("name is not null").distinct()
    out = refs.join(by_file, ["repo", "file", "name"], "left").join(clash, ["repo", "name"], "left")
    found = F.coalesce("local", "only")
    dst = F.coalesce(found, F.col("name")) if keep_unresolved else found
    return out.select("repo", "src", dst.alias("dst"), found.isNotNull().alias("resolved")).where("dst is not null and src <> dst").distinct()


def edges(symbols: DataFrame) -> DataFrame:
    """(repo, rel, src, dst, resolved) of calls, inherits and implements."""

    def of(rel: str, column: str, keep: bool) -> DataFrame:
        refs = symbols.select("repo", F.col("id").alias("src"), "file", F.explode(column).alias("name"))
        return resolve(refs, symbols.select("repo", "id", "file", "name"), keep).withColumn("rel", F.lit(rel)).select("repo", "rel", "src", "dst", "resolved")

    return of("calls", "calls", False).unionByName(of("inherits", "inherits_from", True)).unionByName(of("implements", "implements", True))


def import_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select("repo", "file", F.explode("imports").alias("module")).distinct()


def module_map(files: DataFrame) -> DataFrame:
    """(repo, key, target): what an import string means; target is null if several files fit.

    Keys of a file are its path, its path without extension, its bare name and, for some languages, the dotted path.
    """
    dot = F.instr("file", ".") > 0
    stem = F.when(dot, F.regexp_replace("file", r"\.[^.]*$", "")).otherwise(F.col("file"))
    ext = F.when(dot, F.regexp_extract("file", r"(\.[^.]*)$", 1)).otherwise("")
    keys = F.array(F.col("file"), stem, F.substring_index(stem, "/", -1), F.when(ext.isin(DOTTED), F.replace(stem, F.lit("/"), F.lit("."))))
    keyed = files.select("repo", "file", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
    return keyed.groupBy("repo", "key").agg(F.when(F.count_distinct("file") == 1, F.min("file")).alias("target"))


def file_graph(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst) between files by their resolved imports."""
    hit = imports.join(module_map(files).withColumnRenamed("key", "module"), ["repo", "module"])
    return hit.where("target is not null and target <> file").select("repo", F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


# ---------------------------------------------------------------- searches


def reach(edge: DataFrame, starts: DataFrame, depth: int, forward: bool = True, inclusive: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): the least number of steps from each start (root, node) to what it reaches in 1 to depth steps.

    Starts are at depth 0 and only returned if inclusive. Searches of several roots run together. With ends (node, left)
    nodes are left out from which what is searched for is more steps away than are left.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edge.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    step = cut(step) if depth > 1 else step
    seen = cut(starts.select("root", "node", F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        new = small(front).join(step, "node").select("root", F.col("next").alias("node")).distinct()
        if ends is not None:
            new = new.join(ends.where(F.col("left") <= depth - d).select("node"), "node", "left_semi").select("root", "node")
        front = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen if inclusive else seen.where("depth > 0")


def callers(edge: DataFrame, start: Column | str, depth: int = 1, cap: int = 500) -> DataFrame:
    """Who reaches `start` within depth steps: (node, depth), nearest first, then by id, at most cap."""
    return _ordered(edge, start, depth, False, cap)


def callees(edge: DataFrame, start: Column | str, depth: int = 1, cap: int = 500) -> DataFrame:
    return _ordered(edge, start, depth, True, cap)


def _ordered(edge: DataFrame, start, depth: int, forward: bool, cap: int) -> DataFrame:
    one = edge.sparkSession.range(1).select(F.lit(0).alias("root"), F.lit(start).cast(edge.schema["src"].dataType).alias("node"))
    return reach(edge, one, depth, forward).select("node", "depth").orderBy("depth", "node").limit(cap)


def paths(edge: DataFrame, source, target, depth: int = 10, cap: int = 5) -> DataFrame:
    """(path, hops): simple paths of at most depth steps, shortest first, then by their ids; at most cap.

    Only nodes that lie on some path short enough (reachable from the source, reaching the target) are walked.
    """
    kind = edge.schema["src"].dataType
    at = lambda v: edge.sparkSession.range(1).select(F.lit(0).alias("root"), F.lit(v).cast(kind).alias("node"))
    down = reach(edge, at(source), depth, True, True).select("node", F.col("depth").alias("down"))
    up = reach(edge, at(target), depth, False, True).select("node", F.col("depth").alias("up"))
    on = cut(down.join(up, "node").where(F.col("down") + F.col("up") <= depth))
    step = edge.select("src", "dst").distinct().join(small(on.select(F.col("node").alias("src"))), "src").join(small(on.select(F.col("node").alias("dst"), "up")), "dst")
    step = cut(step)
    front = at(source).select(F.array("node").alias("path"), F.col("node").alias("last"))
    done = None
    for d in range(1, depth + 1):
        front = front.join(small(step), front["last"] == step["src"]).where(~F.array_contains("path", F.col("dst")) & (F.col("up") + d <= depth))
        front = cut(front.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        hit = front.where(F.col("last") == F.lit(target).cast(kind)).select("path", F.lit(d).alias("hops"))
        done = hit if done is None else done.unionByName(hit)
        front = front.where(F.col("last") != F.lit(target).cast(kind))
        if done.limit(cap).count() >= cap or not front.limit(1).count():
            break
    return done.orderBy("hops", "path").limit(cap)


def impact(tagged: DataFrame, start, depth: int = 3, cap: int = 500) -> DataFrame:
    """What depends on `start` over edges (rel, src, dst): (node, depth, rel), nearest first; the relation is the first of
    calls, inherits, implements, imports by which a node is met at its depth."""
    order = F.when(F.col("rel") == "calls", 0).when(F.col("rel") == "inherits", 1).when(F.col("rel") == "implements", 2).otherwise(3)
    kind = tagged.schema["src"].dataType
    step = tagged.select(F.col("dst").alias("at"), F.col("src").alias("next"), "rel", order.alias("pri"))
    seen = cut(tagged.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("rel")))
    front = seen
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        new = small(front.select(F.col("node").alias("at"))).join(step, "at").groupBy(F.col("next").alias("node")).agg(F.min(F.struct("pri", "rel")).alias("by"))
        front = cut(new.join(small(seen.select("node")), "node", "left_anti").select("node", F.lit(d).alias("depth"), F.col("by.rel").alias("rel")))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0").orderBy("depth", "node").limit(cap)


def degrees(edge: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours."""
    e = edge.select("src", "dst").distinct()
    both = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def pagerank(nodes: DataFrame, edge: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float | None = 1e-4) -> DataFrame:
    """(node, rank) with ranks that start at 1 and sum to the number of nodes; nodes without calls spread theirs evenly.

    Edges and ranks stay partitioned by source and node; only sums of what flows in are shuffled in a round.
    """
    damping = min(max(damping, 0.1), 0.99)
    e = cut(edge.select("src", "dst").distinct())
    with fixed(e.sparkSession, e.count()):
        return _ranked(nodes, e, damping, rounds, tolerance)


def _ranked(nodes: DataFrame, e: DataFrame, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e = cut(e.repartition("src").join(out, "src").select("src", "dst", "out"))
    rank = cut(nodes.select(F.col("node")).distinct().repartition("node").join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out").isNull().alias("sink"), F.lit(1.0).alias("rank")))
    n, lost = rank.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).first()
    for _ in range(rounds):
        flow = e.join(rank.select(F.col("node").alias("src"), "rank").hint("shuffle_hash"), "src")
        flow = flow.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = rank.withColumnRenamed("rank", "old").join(flow.hint("shuffle_hash"), "node", "left")
        new = cut(new.select("node", "sink", (F.lit(1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + lost / max(n, 1))).alias("rank"), "old"))
        rank = new.drop("old")
        lost, moved = new.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)), F.max(F.abs(F.col("rank") - F.col("old")))).first()
        if tolerance is not None and (moved or 0) < tolerance:
            break
    return rank.select("node", "rank")


def cycles(edge: DataFrame, rounds: int = 200) -> DataFrame:
    """(comp, members): strongly connected groups of two nodes and more, members sorted, comp the smallest.

    Nodes without an edge in or out are peeled off; then, in rounds, the least label spreads forward within what is left,
    backward from its owner, and both meet in the owner's group. Nothing is collected to the driver.
    """
    e = cut(edge.select("src", "dst").where("src <> dst").distinct())
    with fixed(e.sparkSession, e.count()):
        return _cycles(e, rounds)


def _cycles(e: DataFrame, rounds: int) -> DataFrame:
    found = None
    for _ in range(rounds):
        # peel
        size = e.count()
        while size:
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            now = e.count()
            if now == size:
                break
            size = now
        if not size:
            break
        low = _least(e, "src", "dst")  # least node that reaches each node
        within = e.join(low.withColumnRenamed("node", "src").withColumnRenamed("low", "ls"), "src").join(low.withColumnRenamed("node", "dst").withColumnRenamed("low", "ld"), "dst")
        same = cut(within.where("ls = ld").select("src", "dst", F.col("ls").alias("low")))
        back = cut(low.where("node = low").select("low", "node"))
        front = back
        while front.limit(1).count():
            new = same.join(front.withColumnRenamed("node", "dst"), ["dst", "low"]).select("low", F.col("src").alias("node")).distinct()
            front = cut(new.join(back, ["low", "node"], "left_anti"))
            back = cut(back.unionByName(front))
        groups = cut(back.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").join(back, "low").select("low", "node"))
        found = groups if found is None else found.unionByName(groups)
        e = cut(same.select("src", "dst").join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti"))
    else:
        if e.limit(1).count():
            raise RuntimeError(f"cycles are not all found in {rounds} rounds")
    if found is None:
        found = e.select(F.col("src").alias("low"), F.col("src").alias("node")).limit(0)
    return found.groupBy(F.col("low").alias("comp")).agg(F.sort_array(F.collect_set("node")).alias("members"))


def _least(e: DataFrame, a: str, b: str) -> DataFrame:
    """(node, low): the least node from which each node can be reached along a -> b (itself included).

    Only nodes whose label has moved send it on; edges and labels stay partitioned, what is sent is shuffled.
    """
    e = cut(e.repartition(a))
    low = cut(e.select(F.col(a).alias("node")).union(e.select(F.col(b).alias("node"))).distinct().repartition("node").select("node", F.col("node").alias("low"), F.lit(True).alias("moved")))
    while True:
        sent = low.where("moved").select(F.col("node").alias(a), "low").hint("shuffle_hash")
        came = e.join(sent, a).groupBy(F.col(b).alias("node")).agg(F.min("low").alias("got")).hint("shuffle_hash")
        less = F.coalesce(F.col("got") < F.col("low"), F.lit(False))
        low = cut(low.join(came, "node", "left").select("node", F.when(less, F.col("got")).otherwise(F.col("low")).alias("low"), less.alias("moved")))
        if not low.where("moved").limit(1).count():
            return low.drop("moved")


def per_key_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
