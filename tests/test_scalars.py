"""Script-language texts and operators, against known results."""

import math

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import js as J
from tarnweave.operators import rules, text, trace


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column).first()[0]


@pytest.mark.parametrize(("x", "n", "want"), [(1.005, 2, "1.00"), (2.5, 0, "3"), (-2.5, 0, "-3"), (0.5, 0, "1"), (1e21, 2, "1e+21"), (-0.0000001, 2, "0.00"), (123.456, 1, "123.5"), (1.45, 1, "1.4"), (0.0, 2, "0.00")])
def test_to_fixed(spark, x, n, want):
    assert one(spark, J.to_fixed(F.col("x"), F.lit(n)), x=x) == want


@pytest.mark.parametrize(("x", "n", "want"), [(123456.0, 2, "1.2e+5"), (0.000123, 2, "0.00012"), (1e-7, 3, "1.00e-7"), (123.456, 4, "123.5"), (1.0, 3, "1.00"), (-25.0, 1, "-3e+1"), (0.0, 3, "0.00"), (999.9, 3, "1.00e+3")])
def test_to_precision(spark, x, n, want):
    assert one(spark, J.to_precision(F.col("x"), F.lit(n)), x=x) == want


@pytest.mark.parametrize(("x", "n", "want"), [(12345.0, 2, "1.23e+4"), (0.0, 2, "0.00e+0"), (-2.5, 0, "-3e+0"), (5.0, 1, "5.0e+0")])
def test_to_exponential(spark, x, n, want):
    assert one(spark, J.to_exponential(F.col("x"), F.lit(n)), x=x) == want


@pytest.mark.parametrize(("x", "want"), [(1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (0.000001, "0.000001"), (1e-7, "1e-7"), (-1.5, "-1.5"), (0.1, "0.1"), (100.0, "100"), (1.25e30, "1.25e+30"), (-0.0, "0"), (math.inf, "Infinity"), (5e-324, "5e-324")])
def test_number_text(spark, x, want):
    assert one(spark, J.number_text(F.col("x")), x=x) == want


@pytest.mark.parametrize(("s", "want"), [("2020-01-02", 1577923200000), ("2020-01-02T03:04:05.678Z", 1577934245678), ("2020-01-02T03:04Z", 1577934240000), ("2020-13-02", None), ("today", None), ("2020-01-02T03:04:05+01:00", 1577930645000)])
def test_parse_iso(spark, s, want):
    assert one(spark, J.parse_iso(F.col("s")), s=s) == want


def test_escapes(spark):
    assert one(spark, J.escaped(F.col("s")), s="a b/ü한😀%") == "a%20b/%FC%uD55C%uD83D%uDE00%25"
    assert one(spark, J.unescaped(F.col("s")), s="a%20b/%FC%uD55C%uD83D%uDE00%25%zz") == "a b/ü한😀%%zz"
    assert one(spark, J.encode_uri(F.col("s")), s="http://x.y/ä b?q=1&r=[2]#t") == "http://x.y/%C3%A4%20b?q=1&r=%5B2%5D#t"
    assert one(spark, J.decode_uri(F.col("s")), s="%C3%A4%20%3F%2fx") == "ä %3F%2fx"


@pytest.mark.parametrize(("op", "a", "b", "want"), [("/", 1.0, 0.0, math.inf), ("/", -1.0, 0.0, -math.inf), ("%", -7.0, 3.0, -1.0), ("<<", 1.0, 31.0, -2147483648.0), (">>>", -1.0, 0.0, 4294967295.0), (">>", -8.0, 33.0, -4.0), ("&", 4294967297.0, 3.0, 1.0), ("===", 1.0, 1.0, 1.0), ("??", 1.0, 1.0, None)])
def test_folded(spark, op, a, b, want):
    assert one(spark, J.folded(F.col("op"), F.col("a"), F.col("b")), op=op, a=a, b=b) == want


def test_wide_integers(spark):
    assert int(one(spark, J.as_int_n(F.col("s").cast("decimal(38,0)"), 64), s=str(2**63))) == -(2**63)
    assert int(one(spark, J.as_uint_n(F.col("s").cast("decimal(38,0)"), 8), s="-1")) == 255


def test_charset_retry(spark):
    rows = [("한국어".encode("euc_kr"), "text/html"), ("한국어".encode(), "text/html"), ("한국어".encode("cp949"), "text/html; charset=CP949"), (b"ok \xff", "text/html"), (None, "text/html")]
    df = spark.createDataFrame(rows, "content binary, kind string")
    assert [r[0] for r in df.select(text.decoded(F.col("content"), F.col("kind"))).collect()] == ["한국어", "한국어", "한국어", "ok �", None]


def test_allow_list_that_is_empty_lets_all_through(spark):
    rows, none = spark.range(5).toDF("k"), spark.range(0).toDF("k")
    assert text.allow_listed(rows, none, "k", "k").count() == 5 and text.allow_listed(rows, spark.range(3).toDF("k"), "k", "k", 2).count() == 2


def test_ancestors_of_long_chains_and_cycles(spark):
    n = 1000
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, n + 1)], "node long, parent long")
    got = {r["node"]: r["stack"] for r in trace.ancestors(chain).collect()}
    assert got[n] == list(range(1, n + 1)) and got[1] == [1]
    with pytest.raises(ValueError, match="node 7"):
        trace.ancestors(spark.createDataFrame([(7, 8), (8, 9), (9, 7), (1, 0)], "node long, parent long"))


def test_unknown_rules_are_named(spark):
    with pytest.raises(KeyError, match="no rule 'nothing'"):
        rules.run_rules(None, None, ["nothing"])


def test_compressed_runs(spark):
    rows = [("a", k, k + 32) for k in range(10, 20)] + [("a", 30, 62), ("a", 40, 100), ("a", 42, 102), ("a", 44, 104), ("b", 1, 1)]
    got = sorted(map(tuple, trace.compress_runs(spark.createDataFrame(rows, "g string, k long, v long"), "g", "k", "v").collect()))
    assert got == [("a", 10, 19, 1, 32), ("a", 30, 30, 0, 32), ("a", 40, 44, 2, 60), ("b", 1, 1, 0, 0)]


def test_locale_compare(spark):
    """Letters come in the order of a language, not of their numbers; marks and case only tell equal words apart."""
    from pyspark.sql import functions as F

    from tarnweave.functions import js

    words = ["Zebra", "apple", "Apple", "résumé", "resume", "resumes", "äpfel", "zoo", "", "a b", "ab", "10", "9"]
    df = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "a")], "a string, b string")
    got = {(r["a"], r["b"]): (r["x"], r["de"], r["sv"]) for r in df.select("a", "b", *[js.locale_compare(F.col("a"), F.col("b"), c).alias(n) for c, n in (("UNICODE", "x"), ("de", "de"), ("sv", "sv"))]).collect()}
    assert got[None, "a"] == (None, None, None) and all(got[a, a] == (0, 0, 0) for a in words) and all(got[a, b][0] == -got[b, a][0] for a in words for b in words)
    assert got["apple", "Zebra"][0] == got["apple", "Apple"][0] == got["resume", "résumé"][0] == got["résumé", "resumes"][0] == got["", "9"][0] == got["10", "9"][0] == -1
    assert got["äpfel", "zoo"][1:] == (-1, 1)
