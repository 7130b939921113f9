"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, html_text, langid, license_scan, line_dedup, mixing, near_dup, pii, topk, toxicity

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (None, "Der schnelle braune Fuchs springt heute weit über den sehr faulen Hund", "de", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", None, None),
    (7, LONG, "en", "c"),
    (8, "!!! 123 ???", "en", "c"),
    (9, "x", "de", "c"),
]
EXTRA = ["size", "key", "n", "row", "gone", "score", "mix", "lines", "pii", "licenses", "doc", "taken", "kept", "hits", "made", "kinds", "hit", "plan", "h", "comp", "n_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


OPERATORS = {
    "lines": lambda d: line_dedup.dedup_lines(d),
    "near": lambda d: near_dup.near_duplicates(d),
    "mix": lambda d: mixing.mix_sources(d),
    "pii": lambda d: pii.pseudonymise(d, "a key"),
    "licenses": lambda d: license_scan.scan(d),
    "langid": lambda d: langid.identify(d, F.lit(True)),
    "decontam": lambda d: decontam.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text", "n")),
    "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")), F.lit(True))),
    "html": lambda d: html_text.extract(d.withColumn("html", F.col("text")), ("doc_id",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(docs, name):
    got = OPERATORS[name](docs).collect()
    if name != "decontam":
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", ["lines", "mix", "pii", "licenses"])
def test_clashing_columns_change_nothing(docs, name):
    plain = OPERATORS[name](docs.select("doc_id", "text", "lang", "source")).collect()
    full = OPERATORS[name](docs).collect()
    assert sorted((str(r["doc_id"]), str(r[-1])) for r in full) == sorted((str(r["doc_id"]), str(r[-1])) for r in plain)
    assert all(r[c] == "x" for r in full for c in EXTRA)


def test_near_dup_rows(docs):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dup.near_duplicates(docs).collect()}
    assert got[(2, 10)]["component_id"] == 1 and not got[(2, 10)]["kept"]
    assert got[(4, 0)]["component_id"] == 4 and got[(5, 0)]["kept"] and got[(None, 8)]["kept"]


def test_line_dedup_rows(docs):
    got = line_dedup.dedup_lines(docs).collect()
    by = {r["doc_id"]: r[-1] for r in got}
    assert by[1]["n_dropped"] == 0 and by[2]["n_dropped"] == 1 and by[2]["text"] == ""
    assert by[4]["text"] is None and by[4]["n_lines"] == 0 and by[5]["n_lines"] == 1


def test_top_k_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [0.5, 0.5, 0.5]), (None, [1.0, 1.0]), (8, [0.0, -1.0])], "vec_id long, embedding array<float>")
    x = topk.integers(v)
    got = [tuple(r) for r in topk.top_k(x, x, 2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(1, 1, 2, 65536), (1, 2, 2, 65536)] and (8, 1, 1, 0) in got
    assert topk.top_k(x, x.limit(0), 2).count() == 0 and topk.top_k(x.limit(0), x, 2).count() == 0


def _by_id(df, struct=False):
    """Results by (doc_id, text): the whole row, or its last column, the operator's struct."""
    return {(r["doc_id"], r["text"]): (r[-1] if struct else r) for r in df.collect()}


def test_pii_rows(docs):
    got = _by_id(pii.pseudonymise(docs, "a key"), True)
    assert all(g["text"] == t and (g["n_found"], g["n_replaced"], g["kinds"]) == (0, 0, []) for (_, t), g in got.items())
    held = docs.sparkSession.createDataFrame([(1, "call +1 (487) 555-7209 " * 2000)], "doc_id long, text string")
    g = pii.pseudonymise(held, "a key").first()["pii"]
    assert g["n_found"] == g["n_replaced"] == 2000 and g["kinds"] == ["phone"] and len(set(g["text"].split("call "))) == 2


def test_mix_rows(docs):
    got = _by_id(mixing.mix_sources(docs), True)
    sizes = {k: len(k[1].split()) if k[1] else 0 for k in got}
    assert all(g["size"] == sizes[k] and g["taken"] in (0, g["size"], 2 * g["size"]) for k, g in got.items())
    source = {(r[0], r[1]): r[3] for r in ROWS}
    total = {}
    for r in ROWS:
        total[r[3]] = total.get(r[3], 0) + (len(r[1].split()) if r[1] else 0)
    assert all(g["source_size"] == total[source[k]] for k, g in got.items())


def test_language_rows(docs):
    got = _by_id(langid.identify(docs.select("*"), F.lit(True), keep=("doc_id", "text")))
    assert {k[0] for k, g in got.items() if g["lang_pred"] == "und"} == {4, 5, 6, 8}
    assert all(0 <= g["score"] <= 1 and (g["score"] == 0) == (g["lang_pred"] == "und") for g in got.values())
    assert got[1, ROWS[0][1]][2:] == got[2, ROWS[0][1]][2:]
    nothing = langid.identify(docs, F.lit(False), keep=("doc_id", "text")).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["ambiguous"] for r in nothing)


def test_toxicity_rows(docs):
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), F.lit(True))
    got = [(r["doc_id"], r["score"]) for r in toxicity.scored(docs, model).collect()]
    score = dict(got)
    assert all(0 <= s <= 1 for _, s in got) and score[1] == score[2] and score[4] == score[5]
    none = toxicity.scored(docs, toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")).limit(0), F.lit(True))).collect()
    assert all(0 <= r["score"] <= 1 for r in none)


def test_decontamination_rows(docs):
    items = docs.where("doc_id in (1, 2, 4, 5, 9)").select(F.col("doc_id").alias("item_id"), "text", "n")
    got = {(r["doc_id"], r["item_id"], r["coverage"], r["changed"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(d, i, 1.0, 0) for d in (1, 2) for i in (1, 2)}
    assert {r["doc_id"] for r in decontam.contaminated(docs, docs.where("doc_id = 7").select(F.col("doc_id").alias("item_id"), "text")).collect()} == {7}


def test_license_rows(docs):
    got = _by_id(license_scan.scan(docs), True)
    assert all(g["ids"] == [] and not g["whole"] for g in got.values())
    text = LONG + "\n\nReleased under the MIT License.\n\n" + LONG
    twice = docs.sparkSession.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert [r["licenses"]["ids"] for r in license_scan.scan(twice).collect()] == [["MIT"]] * 3


def test_html_rows(spark):
    para = "The harbour was quiet that morning, and the boats came back one by one with what the night had given them."
    page = f"<html><body><nav><a href=/>Home</a></nav><article><p>{para}</p></article></body></html>"
    long = "<article>" + f"<p>{para}</p>" * 3000 + "</article>"
    rows = [(1, None), (2, ""), (3, page), (3, page), (None, page), (5, long), (6, "<p title=\"x>")]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("x")).withColumn("html__", F.lit("y")), ("page_id",)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, ""), (2, ""), (3, para), (3, para), (None, para), (5, " ".join([para] * 3000)), (6, "")]))


@pytest.mark.parametrize("name", ["near", "langid", "decontam", "toxicity", "html"])
def test_further_columns_are_not_looked_at(docs, name):
    plain = docs.select("doc_id", "text", "lang", "source", F.lit("x").alias("n"))
    cut = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert cut(OPERATORS[name](docs)) == cut(OPERATORS[name](plain))
