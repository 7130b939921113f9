from pyspark.sql import functions as F

from tessera.functions import text, vec


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_split_identifier(spark):
    for s, want in {"snake_case_name": {"snake", "case", "name"}, "camelCase": {"camel", "case"}, "getHTTPResponse": {"get", "http", "response"}, "": set(), "___": set()}.items():
        assert set(one(spark, text.split_identifier("s"), s=s)) == want


def test_stem(spark):
    for a, b in [("hashing", "hash"), ("validation", "validate"), ("parser", "parse")]:
        assert one(spark, text.stem("s"), s=a) == text.stem_word(a) == b
    assert one(spark, text.stem("s"), s="get") == "get"


def test_keyword_score(spark):
    df = spark.createDataFrame([("parse_file", "def parse_file(path)", "Parse a file.", "reads", []), ("parse_files", "", "", "", []), ("other", "", "", "", [])], "name string, signature string, summary string, docstring string, keywords array<string>")
    got = [r[0] for r in df.select(text.keyword_score("parse_file")).collect()]
    assert got[0] >= 20 and got[1] >= 10 and got[2] == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([0.0], [1.0]), ([], [1.0]), ([3.0, 4.0], [4.0, 3.0]), ([1.0, 5.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0, 0.96, 1.0, 0.0]


def test_redaction(spark):
    for s in ["ghp_" + "a" * 36, "AKIA" + "B" * 16, 'token = "abcdef"', "postgres://u:p@h", "-----BEGIN RSA PRIVATE KEY-----", "sk-" + "x1" * 12]:
        assert "<REDACTED>" in one(spark, text.redact("s"), s=f"x {s} y")
    assert one(spark, text.redact("s"), s="plain​ ｆｕｌｌ") == "plain full"
    assert len(one(spark, text.redact("s"), s="a" * 20_000)) == 10_000
    once = one(spark, text.redact("s"), s='password = "secret1"')
    assert one(spark, text.redact("s"), s=once) == once


def test_licenses_and_purls(spark):
    for s, want in {"MIT": "permissive", "Apache License, Version 2.0": "permissive", "GPL-3.0 OR MIT": "permissive", "GPL-3.0 AND MIT": "copyleft", "GPL-3.0": "copyleft", "X": "unknown", "": "unknown"}.items():
        assert one(spark, text.classify_license("s"), s=s) == want
    assert one(spark, text.purl(F.lit("npm"), F.lit("@a/b"), F.lit("1"))) == "pkg:npm/%40a/b@1"
    assert one(spark, text.purl(F.lit("pypi"), F.lit("x"), F.lit(None))) == "pkg:pypi/x"


def test_paths(spark):
    assert one(spark, text.is_test_file("s"), s="a/tests/b.py") and one(spark, text.is_test_file("s"), s="x_test.go") and not one(spark, text.is_test_file("s"), s="src/testing.py")
    assert one(spark, text.is_secret_file("s"), s="a/.env.local") and not one(spark, text.is_secret_file("s"), s="a/env.py")
    assert one(spark, text.glob_match("s", "*.py"), s="a/b.py") and one(spark, text.glob_match("s", "src/*.py"), s="x/src/d/b.py") and not one(spark, text.glob_match("s", "?.py"), s="ab.pyc")
    assert one(spark, text.symbol_id(F.lit("a::b"), F.lit("c#d"), F.lit("function"))) == "a%3A%3Ab::c%23d#function"
    assert [one(spark, text.rounded_ms("n"), n=n) for n in (4, 5, 14, 15)] == [0, 10, 10, 20]
