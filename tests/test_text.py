import pytest
from loomstone.functions.text import Value, format_bytes, normalize, normalize_text, parse_like, parse_value, show_double, split_tokens, tokens
from pyspark.sql import functions as F

CASES = ["Sugar-Free", "  A  B ", " x ", "​x", "\tTab\u0085", "İ", "ÉCLAIR", "-5", "", "--", "a b", "ΑΣ"]


def test_normalize_is_the_same_on_both_sides(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    got = df.select("s", normalize("s").alias("n"), tokens(normalize("s")).alias("t")).collect()
    for r in got:
        assert r["n"] == normalize_text(r["s"])
        assert r["t"] == split_tokens(r["n"])
    by = {r["s"]: r["n"] for r in got}
    assert by["Sugar-Free"] == "sugar free" and by["  A  B "] == "a  b" and by[" x "] == "x" and by["​x"] == "​x"


@pytest.mark.parametrize(
    "text, value",
    [("-5", Value("integer", 5)), ("007", Value("integer", 7)), ("+3", Value("integer", 3)), ("5.0", Value("string", "5.0")), ("TRUE", Value("boolean", True)),
     ("2024-01-01", Value("string", "2024 01 01")), ("9223372036854775808", Value("string", "9223372036854775808")), ("Acme", Value("string", "acme"))],
)
def test_parse_value(text, value):
    assert parse_value(text) == value


def test_show_double(spark):
    values = [1.0, 900.0, 0.1, 1e21, 1.5e22, 123456789.125, 1e7, 1e-7, 2.5e-5, -3.25, -1e10, 0.0, float("inf"), float("-inf"), float("nan")]
    want = ["1", "900", "0.1", "1" + "0" * 21, "15" + "0" * 21, "123456789.125", "10000000", "0.0000001", "0.000025", "-3.25", "-10000000000", "0", "inf", "-inf", "NaN"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, d double")
    assert [r[0] for r in df.orderBy("k").select(show_double(F.col("d"))).collect()] == want


def test_format_bytes():
    assert [format_bytes(n) for n in (0, 1023, 1024, 1536, 5 << 20)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB"]


def test_parse_like():
    assert parse_like("5", "integer") == Value("integer", 5) and parse_like("x", "integer") is None and parse_like("5", "string") == Value("string", "5")
    assert parse_like("true", "boolean") == Value("boolean", True) and parse_like("yes", "boolean") is None and parse_like("1.5", "float") == Value("float", 1.5)
