"""From a source tree to answers, through the public surface."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.engine import TOOLS, Engine
from tessera.extract.languages import EXTENSIONS, LANGUAGES
from tessera.extract.run import parse
from tessera.operators import render
from tessera.sources import diff, manifests, scanner, store, tree

PY = '''"""Module."""
import os
import subprocess
from pkg.util import helper

LIMIT = 3
DEBUG = True


class Base:
    """A base. More text."""

    def run(self, a, b=1, *args):
        """Runs it."""
        if a:
            for x in b:
                if x and a:
                    helper(x)
        return os.system(a)


class Child(Base):
    def run(self, a):
        return super().run(a)


def danger(cmd):
    return subprocess.run(cmd, shell=True)


def entry():
    line = input()
    return danger(line)


def unused():
    pass
'''
UTIL = "def helper(x):\n    token = \"abcd1234\"\n    return x\n\n\ndef lonely():\n    return helper(1)\n"
GO = 'package main\n\nimport "fmt"\n\n// Add adds.\nfunc Add(a int, b int) int {\n\tif a > 0 && b > 0 {\n\t\tfmt.Println(a)\n\t}\n\treturn a + b\n}\n\ntype Point struct {\n\tX int\n}\n'
JAVA = "import java.util.List;\n\n/** Box of things. */\npublic class Box extends Base implements Thing {\n    public int size(int a) {\n        for (int i = 0; i < a; i++) { add(i); }\n        return a;\n    }\n}\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    p = tmp_path_factory.mktemp("project")
    for name, body in {"app.py": PY, "pkg/util.py": UTIL, "main.go": GO, "src/Box.java": JAVA, "node_modules/x.js": "function x() {}", ".env": "A=1", "notes.txt": "n", "skip/me.py": "A = 1", "data.json": '{"alpha": 1}'}.items():
        (p / name).parent.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(body)
    (p / ".gitignore").write_text("skip/\n")
    (p / "requirements.txt").write_text("# c\nflask==2.0\n-r other\nrequests>=1\n")
    (p / "package-lock.json").write_text(json.dumps({"packages": {"": {}, "node_modules/@a/b": {"version": "1.0", "license": "MIT"}}}))
    return p


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("warehouse")), embed=lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert {r["file"] for r in e.index_folder(str(project), name="demo").collect()} == {"app.py", "pkg/util.py", "main.go", "src/Box.java", "data.json"}
    return e


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_tools_are_complete():
    assert len(TOOLS) == 34


def test_symbols(engine):
    s = {r["id"]: r for r in engine.store.table("symbols", "local/demo").collect()}
    run = s["app.py::Base.run#method"]
    assert run["complexity"].asDict() == {"cyclomatic": 5, "cognitive": 7, "max_nesting": 3, "param_count": 4, "loc": 7}
    assert run["calls"] == ["helper", "system"] and run["summary"] == "Runs it." and run["parent"] == "app.py::Base#class"
    assert s["app.py::LIMIT#constant"]["kind"] == "constant" and s["app.py::Child#class"]["inherits_from"] == ["Base"]
    assert s["app.py::Base#class"]["imports"] == ["os", "subprocess", "pkg.util"] and s["app.py::Base#class"]["summary"] == "A base."
    assert s["main.go::Add#function"]["calls"] == ["Println"] and s["main.go::Add#function"]["docstring"] == "Add adds."
    box = s["src/Box.java::Box#class"]
    assert box["inherits_from"] == ["Base"] and box["implements"] == ["Thing"] and "src/Box.java::Box.size#method" in s


def test_lookups(engine):
    one = engine.get_symbol("demo", "pkg/util.py::lonely#function", verify=True, context_lines=1).first()
    assert one["source"].startswith("def lonely") and one["content_verified"]
    assert engine.get_symbol("demo", file_path="app.py", line=17).first()["name"] == "run"
    found, missing = engine.get_symbols("demo", ["pkg/util.py::lonely#function", "nope", "app.py::entry#function"])
    assert ids(found) == ["pkg/util.py::lonely#function", "app.py::entry#function"] and ids(missing) == ["nope"]
    assert {r["role"] for r in engine.get_symbol_context("demo", "app.py::danger#function", True).collect()} >= {"symbol", "sibling", "caller"}
    out = {r["id"]: r["depth"] for r in engine.get_file_outline("demo", "app.py").collect()}
    assert out["app.py::Base#class"] == 0 and out["app.py::Base.run#method"] == 1


def test_outlines(engine):
    rows = {(r["section"], r["key"]): r["n"] for r in engine.get_repo_outline("demo").collect()}
    assert rows[("directory", "(root)")] == 3 and rows[("language", "python")] == 2
    assert "pkg" in ids(engine.get_file_tree("demo"), "path") and ids(engine.get_file_tree("demo", "pkg/"), "path") == ["pkg", "pkg/util.py"]
    assert engine.list_repos().first()["symbol_count"] > 10 and engine.get_status().first()["repo_count"] == 1


def test_search(engine):
    assert ids(engine.search_symbols("demo", "danger"))[0] == "app.py::danger#function"
    assert engine.search_symbols("demo", "danger", semantic=True).count() > 0
    hit = engine.search_text("demo", "REDACTED").first()
    assert hit["file"] == "pkg/util.py" and hit["line"] == 2
    assert engine.search_references("demo", "shell=").first()["symbol_name"] == "danger"
    with pytest.raises(LookupError):
        engine.search_text("gone", "x")
    with pytest.raises(ValueError):
        engine.run("search_symbols", repos=["demo"] * 6, query="x")


def test_graph_tools(engine):
    assert ids(engine.get_callers("demo", "app.py::danger#function"), "node") == ["app.py::entry#function"]
    assert "pkg/util.py::helper#function" in ids(engine.get_callees("demo", "app.py::Base.run#method", 2), "node")
    assert engine.get_call_chain("demo", "app.py::entry#function", "app.py::danger#function").first()["hops"] == 1
    assert ids(engine.get_type_hierarchy("demo", "app.py::Child#class"), "node") == ["app.py::Base#class"]
    assert {r["module"]: list(r["candidates"]) for r in engine.get_imports("demo", "app.py").collect()}["pkg.util"] == []
    assert "app.py::entry#function" in ids(engine.get_impact("demo", "app.py::danger#function"), "node")
    assert engine.get_diagram("demo", "call_graph", "app.py::danger#function").startswith("graph TD")
    deps, cycles = engine.get_dependencies("demo")
    assert {r["module"]: r["internal"] for r in deps.collect()}["pkg.util"] and cycles.count() == 0


def test_quality_tools(engine):
    assert engine.analyze_complexity("demo").first()["name"] == "run"
    assert engine.get_key_symbols("demo", limit=3).count() == 3
    dead = ids(engine.get_dead_code("demo"))
    assert "app.py::unused#function" in dead and "app.py::danger#function" not in dead
    assert [r["subject"] for r in engine.lint_index("demo").where("type <> 'call_graph_broken_ref'").collect()] == ["app.py:run#method"]
    assert all(r["passed"] for r in engine.verify("demo").collect())
    assert {r["status"] for r in engine.compare_symbols("demo", "demo").collect()} == {"unchanged"}


def test_security_tools(engine, project):
    got = {(r["rule_id"], r["symbol"]) for r in engine.scan_security("demo").collect()}
    assert ("SEC-016", "danger") in got and ("SEC-004", "danger") not in got and ("SEC-003", "run") in got
    assert {r["rule_id"] for r in engine.scan_module_settings("demo").collect()} == {"SEC-020"}
    t = engine.trace_taint("demo").collect()
    assert [r["path"] for r in t] == [["app.py::entry#function", "app.py::danger#function"]]
    assert {(r["name"], r["version"], r["purl"]) for r in engine.generate_sbom(str(project)).collect()} == {("flask", "2.0", "pkg:pypi/flask@2.0"), ("requests", None, "pkg:pypi/requests"), ("@a/b", "1.0", "pkg:npm/%40a/b@1.0")}
    assert {r["severity"]: r["n"] for r in engine.count_findings("demo").collect()} == dict(Counter(r["severity"] for r in engine.scan_security("demo").collect()))
    said = engine.summarize_taint("demo").first()
    assert (said["sources_found"], said["paths_found"], said["paths_returned"], said["truncated"], len(said["limitations"])) == (1, 1, 1, False, 3)
    assert json.loads(engine.generate_sbom(str(project), "spdx"))["spdxVersion"] == "SPDX-2.3" and json.loads(engine.generate_sbom(str(project), "cyclonedx"))["specVersion"] == "1.5"
    assert engine.check_licenses(str(project)).first()["classification"] == "permissive"


def test_class_context_has_the_hierarchy(engine):
    got = {(r["role"], r["name"]) for r in engine.get_symbol_context("demo", "app.py::Base#class", include_graph=True).collect()}
    assert ("descendant", "Child") in got and not any(r == "ancestor" for r, _ in got)
    got = {(r["role"], r["name"]) for r in engine.get_symbol_context("demo", "app.py::Child#class", include_graph=True).collect()}
    assert ("ancestor", "Base") in got
    got = {r["role"] for r in engine.get_symbol_context("demo", "app.py::danger#function", include_graph=True).collect()}
    assert "caller" in got and not got & {"ancestor", "descendant"}


def test_changes_and_update(engine, project):
    text = "--- a/app.py\n+++ b/app.py\n@@ -28 +28 @@\n-x\n+y\n"
    assert ids(engine.get_changes("demo", diff_text=text)) == ["app.py::danger#function"]
    assert "app.py::entry#function" in ids(engine.get_changes("demo", diff_text=text, include_impact=True))
    (project / "pkg/util.py").write_text(UTIL + "\n\ndef fresh():\n    pass\n")
    (project / "main.go").unlink()
    (project / "new.py").write_text("def added():\n    pass\n")
    assert {(r["file"], r["status"]) for r in engine.index_folder(str(project), name="demo").collect()} == {("pkg/util.py", "changed"), ("main.go", "deleted"), ("new.py", "new")}
    s = set(ids(engine.store.table("symbols", "local/demo")))
    assert "pkg/util.py::fresh#function" in s and "new.py::added#function" in s and "main.go::Add#function" not in s and "app.py::danger#function" in s
    assert not engine.invalidate_cache("demo") and engine.invalidate_cache("demo", confirm=True) and engine.list_repos().count() == 0


def test_diff_parsing():
    d = "+++ b/x.py\n@@ -1 +3,2 @@\n@@ -9,2 +7,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n"
    assert diff.parse(d) == [("x.py", 3, 4, 0)]


def test_listing_filter(spark):
    rows = [("src/a.py", "blob", "10"), ("node_modules/a.py", "blob", "1"), ("a/.env", "blob", "1"), ("b.py", "tree", "1"), ("c.png", "blob", "1"), ("d.py", "blob", "999999"), ("../e.py", "blob", "1"), ("i/f.py", "blob", None), ("g.py", "blob", "x")]
    e = spark.createDataFrame(rows, "path string, type string, size string")
    assert set(ids(tree.filter_entries(e, "i/\n"), "path")) == {"src/a.py", "g.py"}
    many = spark.createDataFrame([(f"{'src' if i % 2 else 'z'}/f{i}.py", "blob", "1") for i in range(60)], "path string, type string, size string")
    got = ids(tree.filter_entries(many, cap=50), "path")
    assert len(got) == 50 and sum(p.startswith("src/") for p in got) == 30
    assert tree.parse_repo_url("https://github.com/a/b.git") == ("a", "b")


def test_languages():
    assert len(LANGUAGES) == 66 and len(EXTENSIONS) == 108
    for lang, source, names in [
        ("javascript", "export class A extends B {\n  go(x) { return f(x); }\n}\nconst k = (a) => a;\n", {"A", "go", "k"}),
        ("typescript", "interface I { a: number }\ntype T = string;\nexport function f(a: string): void {}\n", {"I", "T", "f"}),
        ("rust", "pub struct S { a: i32 }\nimpl S {\n    pub fn new(a: i32) -> S { S { a } }\n}\n", {"S", "new"}),
        ("c", "#include <x.h>\nint add(int a, int b) {\n  return a + b;\n}\nstruct P { int x; };\n", {"add", "P"}),
        ("ruby", "class A < B\n  def go\n    1\n  end\nend\n", {"A", "go"}),
        ("php", "<?php\nclass A extends B {\n  public function go() { return 1; }\n}\n", {"A", "go"}),
        ("sql", "CREATE TABLE t (a int);\nCREATE FUNCTION f() RETURNS int;\n", {"t", "f"}),
        ("yaml", "a: 1\nb:\n  c: 2\n", {"a", "b"}),
        ("bash", "go() {\n  ls\n}\n", {"go"}),
        ("lua", "function a.b(x)\n  return x\nend\n", {"a.b"}),
    ]:
        assert names <= {r["name"] for r in parse(source, "f", lang)}, lang
    dup = parse("def f(): pass\ndef f(): pass\n", "a.py", "python")
    assert [r["id"] for r in dup] == ["a.py::f#function~1", "a.py::f#function~2"]
    assert [r["id"] for r in parse("import os\n", "a.py", "python")] == ["a.py::(module)"] and parse("def broken(:\n", "a.py", "python") == []


def test_manifests():
    got = manifests.parse_dependencies({"go.mod": "require (\n  a/b v1.2.3\n)\nrequire c/d v0.1.0\n", "Cargo.lock": '[[package]]\nname = "x"\nversion = "1"\n'})[0]
    assert got == [("x", "1", "cargo", "Cargo.lock"), ("a/b", "v1.2.3", "golang", "go.mod"), ("c/d", "v0.1.0", "golang", "go.mod")]


def test_streaming(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import usage

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=i), i) for i in range(5)] + [("a", t0 + dt.timedelta(seconds=61), 9)]
    calls = spark.createDataFrame(rows, "tool_name string, ts timestamp, call_id long")
    want = {0: True, 1: True, 2: False, 3: False, 4: False, 9: True}
    assert {r["call_id"]: r["allowed"] for r in usage.limited(calls, 2).collect()} == want
    calls.write.parquet(str(tmp_path / "calls"))
    s = usage.limited_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), 2)
    q = s.writeStream.format("memory").queryName("allowed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["call_id"]: r["allowed"] for r in spark.table("allowed").collect()} == want
    u = spark.createDataFrame([("a", t0, True, 4.0), ("a", t0, False, 6.0)], "tool_name string, ts timestamp, success boolean, response_time_ms double")
    w = usage.usage_windows(u).first()
    assert (w["calls"], w["errors"], w["avg_ms"]) == (2, 1, 5.0)


def test_catalog_queries_equal_their_sql(spark):
    """Two of the registered queries over the smallest tables, as the driver compares all of them."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    try:
        for t in ("part", "lineitem", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    except duckdb.Error:
        pytest.skip("no tables here")
    for name in ("dead_symbols", "usage_stats"):
        df = catalog.QUERIES[name](spark, d).select(*[F.col(c) for c in sorted(catalog.QUERIES[name](spark, d).columns)])
        want = con.execute(f"SELECT * FROM ({catalog.ORACLES[name]})").fetchdf()
        assert sorted(map(str, df.toPandas().values.tolist())) == sorted(map(str, want[sorted(want.columns)].values.tolist()))


def test_emptied_index_keeps_nothing(spark, tmp_path):
    """The last symbol, edge, import and vector of a repository go with their file."""
    p = tmp_path / "src"
    p.mkdir()
    (p / "a.py").write_text("import os\n\ndef f():\n    return g()\n\ndef g():\n    return 1\n")
    (p / "b.txt").write_text("plain")
    e = Engine(spark, str(tmp_path / "wh"), embed=lambda texts: [[1.0, 0.0] for _ in texts])
    e.index_folder(str(p), name="p")
    e.embed_missing(["local/p"])
    count = lambda: {t: e.store.table(t, "local/p").count() for t in ("symbols", "edges", "imports", "embeddings")}
    assert all(count().values())
    (p / "a.py").write_text("def f():\n    return 2\n")
    e.index_folder(str(p), name="p")
    assert count() == {"symbols": 1, "edges": 0, "imports": 0, "embeddings": 1}
    assert e.get_callers("p", "a.py::g#function").count() == 0
    (p / "a.py").write_text("# nothing\n")
    e.index_folder(str(p), name="p")
    assert count() == {"symbols": 0, "edges": 0, "imports": 0, "embeddings": 0}


def test_limiter_counts_all_tools_and_no_future(spark):
    from tessera.streaming import usage

    allowed, taken = usage.admit([(f"t{i % 7}", 100 + i / 100) for i in range(400)], [])
    assert sum(allowed) == 300 and len(taken) == 300
    assert usage.admit([("a", 100.0)], [("a", 150.0)] * 60)[0] == [True]  # taken times further ahead are not believed
    assert usage.admit([("a", 100.0)], [("a", 104.0)] * 60)[0] == [False]
    assert usage.admit([("a", None), ("a", float("nan"))], [])[0] == [False, False]
    rows = [("a", 1000.0 * k + i / 10, 100 * k + i) for k in range(5) for i in range(70)]
    calls = spark.createDataFrame(rows, "tool_name string, t double, call_id long").select("tool_name", F.timestamp_seconds("t").alias("ts"), "call_id")
    got = {r["call_id"]: r["allowed"] for r in usage.limited(calls).collect()}
    assert got == {c: c % 100 < 60 for _, _, c in rows}


def test_arguments_are_checked(spark, tmp_path):
    from tessera.engine import checked

    assert checked(Engine.get_callers, {"repo": "r", "symbol_id": "x", "max_depth": "99"})["max_depth"] == 10
    assert checked(Engine.search_symbols, {"repo": "r", "semantic": "true"})["semantic"] is True
    for bad in ({"repo": "r"}, {"repo": "r", "symbol_id": "x", "depth": 1}, {"repo": "r", "symbol_id": 3}, {"repo": "r", "symbol_id": "a\x00"}, {"repo": "r", "symbol_id": "x", "max_depth": "many"}):
        with pytest.raises(ValueError):
            checked(Engine.get_callers, bad)
    e = Engine(spark, str(tmp_path / "wh"))
    assert "/home" not in e.safe_message(ValueError("no file /home/someone/x.py here")) and str(tmp_path) not in e.safe_message(ValueError(f"bad {tmp_path}/wh/symbols"))


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    p = tmp_path / "src"
    p.mkdir()
    (p / "a.py").write_text("def f(x):\n    return eval(x)\n")
    (p / "b.py").write_text("def g():\n    return 1\n")
    wh = str(tmp_path / "wh")
    assert main([wh, "index", str(p)], spark) == 0
    name = Engine(spark, wh).list_repos().first()["repo"]
    assert main([wh, "scan", name], spark) == 2
    assert main([wh, "run", "get_file_tree", f"repo={name}"], spark) == 0
    assert main([wh, "run", "nothing"], spark) == 1 and main([wh, "run", "get_callers", "repo"], spark) == 1 and main([wh], spark) == 1
    out = capsys.readouterr()
    assert "SEC-001" in out.out and "no such tool" in out.err


def test_manifest_edges():
    from tessera.sources import manifests as m

    rows, notes = m.parse_dependencies({"requirements.txt": "# c\n\nflask[async] == 2.0 ; x\n-r other\nhttps://h/x.whl\nrequests>=1 # note\n"})
    assert [r[:2] for r in rows] == [("flask", "2.0"), ("requests", None)] and len(notes) == 2 and "line 4" in notes[0]
    assert m.parse_dependencies({"uv.lock": "not [toml"})[0] == [] and m.parse_dependencies({"package-lock.json": "{"})[0] == []
    old = '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}, "c": {"version": "3"}}}'
    assert {r[:2] for r in m.parse_dependencies({"package-lock.json": old})[0]} == {("a", "1"), ("b", "2"), ("c", "3")}
    go = "module x\n\nrequire (\n\ta/b v1.2.3 // indirect\n\tc/d v0.0.1\n)\n\nrequire e/f v2.0.0\nreplace g/h => i/j v9.9.9\n"
    assert [r[:2] for r in m.parse_dependencies({"go.mod": go})[0]] == [("a/b", "v1.2.3"), ("c/d", "v0.0.1"), ("e/f", "v2.0.0")]


def test_external_scanner(spark, tmp_path, monkeypatch):
    one = lambda *a: [tuple(r) for r in scanner.findings(spark, *a).select("status", "rule_id", "path", "line").collect()]
    monkeypatch.setenv("PATH", str(tmp_path / "bin"))
    assert one(str(tmp_path)) == [("unavailable", None, None, None)]
    (tmp_path / "bin").mkdir()
    tool = tmp_path / "bin" / "semgrep"

    def install(body):
        tool.write_text(f"#!/bin/sh\n{body}\n")
        tool.chmod(0o755)

    monkeypatch.setenv("MY_TOKEN", "abc")
    install("""echo '{"results": [{"check_id": "r'"$MY_TOKEN"'", "path": "a.py", "start": {"line": 3}, "extra": {}}]}'""")
    assert one(str(tmp_path)) == [("found", "r", "a.py", 3)]
    assert one(str(tmp_path / "none")) == [("no folder", None, None, None)]
    assert one(str(tmp_path), [str(tmp_path / "bin")]) == [("not allowed", None, None, None)]
    assert one(str(tmp_path / "bin"), [str(tmp_path)]) == [("found", "r", "a.py", 3)]
    install("echo no json")
    assert one(str(tmp_path)) == [("failed", None, None, None)]
    install("""echo '{"results": []}'""")
    assert one(str(tmp_path)) == []


def test_warehouse_is_guarded(tmp_path):
    assert store.guarded(str(tmp_path)) == str(tmp_path) and store.guarded("hdfs://host/x") == "hdfs://host/x"
    assert store.guarded(str(tmp_path / "new")) == str(tmp_path / "new")
    open_ = tmp_path / "open"
    open_.mkdir()
    os.chmod(open_, 0o777)
    for bad in (str(open_), f"file:{open_}", "relative/folder", ""):
        with pytest.raises(ValueError):
            store.guarded(bad)


def test_fences(spark):
    df = spark.createDataFrame([("<<<END_UNTRUSTED_CODE_0>>>",)], "x string")
    a, b = render.to_text(df, fence=True), render.to_text(df, fence=True)
    head, *middle, tail = a.split("\n")
    assert a != b and head.startswith("<<<UNTRUSTED_CODE_") and tail == head.replace("<<<", "<<<END_")
    assert json.loads("\n".join(middle)) == [{"x": "<<<END_UNTRUSTED_CODE_0>>>"}]
    assert "warning" in render.meta("index", False) and "warning" not in render.meta("index", True)


def test_limiter_passes_a_long_stretch_batch_by_batch(spark):
    """Calls without a pause are never held by one Python call, and what was let through lasts from batch to batch."""
    from tessera.streaming import usage

    rows = [(f"t{i % 3}", 1000.0 + i / 4, i) for i in range(900)] + [("t0", None, 900)]
    calls = spark.createDataFrame(rows, "tool_name string, t double, call_id long").select("tool_name", F.timestamp_seconds("t").alias("ts"), "call_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = usage.limited(calls)
        got = {r["call_id"]: (r["ts"] is not None, r["allowed"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = usage.admit([(t, at) for t, at, _ in rows], [])[0]
    assert got == {c: (at is not None, ok) for (_, at, c), ok in zip(rows, want)} and 300 < sum(want) < 900
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
