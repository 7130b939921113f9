import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import graph

SYM = "repo string, id string, file string, name string, kind string, calls array<string>, inherits_from array<string>, implements array<string>, imports array<string>"


def syms(spark, *rows):
    return spark.createDataFrame([("r", f"{f}::{n}", f, n, "function", list(c), list(i), list(m), []) for f, n, c, i, m in rows], SYM)


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("m", "a", ["b"], [], []), ("m", "b", [], [], [])], {("m::a", "m::b")}),
        ([("m", "a", ["b"], [], []), ("n", "b", [], [], [])], {("m::a", "n::b")}),
        ([("m", "a", ["b"], [], []), ("n", "b", [], [], []), ("o", "b", [], [], [])], set()),
        ([("m", "a", ["b"], [], []), ("m", "b", [], [], []), ("n", "b", [], [], [])], {("m::a", "m::b")}),
        ([("m", "r", ["r"], [], [])], set()),
        ([("m", "a", ["b"], [], []), ("m", "b", ["a"], [], [])], {("m::a", "m::b"), ("m::b", "m::a")}),
    ],
)
def test_resolution(spark, rows, want):
    assert pairs(graph.edges(syms(spark, *rows)).where("rel = 'calls'")) == want


def test_unresolved_bases_keep_their_name(spark):
    e = graph.edges(syms(spark, ("m", "A", [], ["B", "Gone"], ["I"]), ("m", "B", [], [], []), ("m", "I", [], [], [])))
    assert {(r["rel"], r["dst"], r["resolved"]) for r in e.collect()} == {("inherits", "m::B", True), ("inherits", "Gone", False), ("implements", "m::I", True)}


def test_diamond(spark):
    e = spark.createDataFrame([("root", "left"), ("root", "right"), ("left", "leaf"), ("right", "leaf")], "src string, dst string")
    assert [tuple(r) for r in graph.callers(e, "leaf", 2).collect()] == [("left", 1), ("right", 1), ("root", 2)]
    assert [r["path"] for r in graph.paths(e, "root", "leaf", 5).collect()] == [["root", "left", "leaf"], ["root", "right", "leaf"]]
    assert graph.paths(e, "leaf", "root", 5).count() == 0


def test_pagerank_hub_and_sum(spark):
    e = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "a")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcd"] + [("hub",)], "node string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert max(got, key=got.get) == "hub" and sum(got.values()) == pytest.approx(5)


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "a"), ("x", "a"), ("b", "y")], "src string, dst string")
    assert {r["comp"]: list(r["members"]) for r in graph.cycles(e).collect()} == {"a": ["a", "b"], "c": ["c", "d", "e"]}
    assert graph.cycles(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_module_map(spark):
    f = spark.createDataFrame([("r", "pkg/util.py"), ("r", "a/u.py"), ("r", "b/u.py"), ("r", "x.h")], "repo string, file string")
    got = {r["key"]: r["target"] for r in graph.module_map(f).collect()}
    assert got["pkg.util"] == got["pkg/util"] == got["util"] == got["pkg/util.py"] == "pkg/util.py" and got["u"] is None and got["x.h"] == "x.h"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=30))
def test_reach_equals_search(spark, edges):
    got = {(r["node"], r["depth"]) for r in graph.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0, edges[0][0])], "root int, node long"), 4).collect()}
    dist, front = {edges[0][0]: 0}, [edges[0][0]]
    for d in range(1, 5):
        front = sorted({b for a, b in edges if a in front and b not in dist})
        dist |= {x: d for x in front}
    assert got == {(x, d) for x, d in dist.items() if d}


def test_cycles_equal_brute_force(spark):
    r = random.Random(1)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    reach = {a: {a} for a in range(30)}
    for _ in range(30):
        for a, b in edges:
            for x in reach.values():
                if a in x:
                    x.add(b)
    want = {tuple(sorted(y for y in range(30) if y in reach[x] and x in reach[y])) for x in range(30)}
    got = {tuple(c["members"]) for c in graph.cycles(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
    assert got == {c for c in want if len(c) > 1}


def test_pagerank_equals_plain_loop(spark):
    import random

    r = random.Random(4)
    edges = sorted({(r.randrange(40), r.randrange(60)) for _ in range(150)} - {(i, i) for i in range(60)})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(range(60), 1.0)
    for _ in range(50):
        lost = sum(rank[i] for i in rank if i not in out)
        new = {i: 0.15 + 0.85 * lost / 60 for i in rank}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        moved = max(abs(new[i] - rank[i]) for i in rank)
        rank = new
        if moved < 1e-4:
            break
    got = graph.pagerank(spark.range(60).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "src long, dst long"))
    assert {x["node"]: round(x["rank"], 9) for x in got.collect()} == {i: round(v, 9) for i, v in rank.items()}


def test_taint_pairs_search_no_more_sources_than_needed(spark, monkeypatch):
    """The first pairs by order come from the first sources that reach a sink; the others are not searched."""
    from tessera.operators import security

    r = random.Random(9)
    edges = sorted({(r.randrange(200), r.randrange(200)) for _ in range(320)})
    sources, sinks = [(i, (i * 7) % 200 // 2) for i in range(0, 200, 2)], [(i,) for i in range(0, 200, 9)]
    want = []
    for s, o in sources:
        dist, front = {s: 0}, [s]
        for d in range(1, 5):
            front = sorted({b for a, b in edges if a in front and b not in dist})
            dist |= {x: d for x in front}
        want += [(o, x, s, dist[x]) for (x,) in sinks if x in dist]
    args = [spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(sources, "id long, ord long"), spark.createDataFrame(sinks, "id long"), 4]
    searched, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda e, starts, *rest, **more: searched.append(starts.select("root").distinct().count()) or reach(e, starts, *rest, **more))
    got = [tuple(x) for x in security.taint_pairs(*args).collect()]
    assert got == [(s, x, d) for o, x, s, d in sorted(want)[:20]] and sum(searched) < 40
    assert sorted(tuple(x) for x in security.taint_pairs(*args, cap=10_000).collect()) == sorted((s, x, d) for _, x, s, d in want)


def _shuffles(monkeypatch, work) -> list[int]:
    """How many shuffles stand in each plan that graph cuts while work runs."""
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or cut(df))
    work()
    return plans


def test_cycles_shuffle_only_moved_labels(spark, monkeypatch):
    """After the first two tables each round of labels shuffles once; the session's settings are as before."""
    e = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    names = ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in names]
    plans = _shuffles(monkeypatch, lambda: graph._least(e, "src", "dst"))
    assert len(plans) > 5
    plans = _shuffles(monkeypatch, lambda: graph.cycles(e).collect())
    rounds = [n for n in plans if n == 1]
    assert len(rounds) >= 6 and [spark.conf.get(k) for k in names] == before


def test_pagerank_shuffles_once_a_round(spark, monkeypatch):
    e = spark.createDataFrame([(i, (i * 5 + 1) % 30) for i in range(25)], "src long, dst long")
    plans = _shuffles(monkeypatch, lambda: graph.pagerank(spark.range(30).withColumnRenamed("id", "node"), e, rounds=4, tolerance=None))
    assert plans[-4:] == [1, 1, 1, 1]
