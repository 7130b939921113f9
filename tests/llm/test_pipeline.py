"""Each stage works on all its predecessor kept, and its decisions take effect."""

import pytest

import corpus_pipeline as c

ITEM = "the small red engine pulled seven heavy wagons over the steep mountain pass before the cold winter storm arrived there"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    plain = lambda i: " ".join(f"w{i}x{j} some common words" for j in range(12))
    rows = [(i, plain(i), "en", f"s{i % 3}", 1) for i in range(40)]
    near = plain(0).replace("w0x0", "changed")
    rows += [(100, near, "en", "s0", 1), (101, plain(1), "en", "s1", 1), (102, "before it " + ITEM + " after it", "en", "s2", 1), (103, "12345 !!", "en", "s0", 1), (104, None, "en", None, None), (105, plain(2) + "\nshared line that stands in two documents of the set", "en", "s1", 1), (106, plain(300) + "\nshared line that stands in two documents of the set", "en", "s1", 1), (None, plain(400), None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mix":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["language"] == {*range(40), 100, 101, 102, 105, 106, None}
    assert kept["line_dedup"] == {*range(40), 102, 105, 106, None}
    assert kept["near_dup"] == kept["line_dedup"] and kept["decontaminate"] == kept["near_dup"] - {102}
    assert kept["mix"] <= kept["decontaminate"] and kept["mix"]


def test_stage_drops_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [r["doc_id"] for r in c.near_duplicates(spark, docs.union(docs.where("doc_id = 7")), sf_dir).collect()]
    assert sorted(i for i in ids if i is not None) == [*range(40), 102, 103, 104, 106] and 100 not in ids and 101 not in ids


def test_short_items_are_found_however_large_the_benchmark(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "they asked who discovered penicillin again in class"), (2, "a clean text of several words")], "doc_id long, text string")
    spark.createDataFrame([(1, "who discovered penicillin"), (2, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for most in (1_000_000, 0):
        monkeypatch.setattr(c.decontam, "FILTER_WINDOWS", most)
        assert [r["doc_id"] for r in c.benchmark(spark, docs, str(tmp_path)).collect()] == [2]


def test_run_equals_stages(spark, sf_dir):
    once = {(r["doc_id"], r["mix_taken"]) for r in c.run(spark, sf_dir).collect()}
    assert once == {(r["doc_id"], r["mix_taken"]) for r in c.run(spark, sf_dir).collect()} and once


def test_empty(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
