import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import url as U


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


@pytest.mark.parametrize(
    "a, b",
    [
        ("https://a.example/x", "http://www.A.Example:80/x/#top"),
        ("https://a.example/v?doc=1&lang=en", " https://a.example:443/v?lang=en&doc=1&UTM_Source=z "),
        ("https://a.example/caf%c3%a9", "https://a.example/caf%C3%A9?mc_cid=1"),
        ("https://a.example/%7Ex", "https://a.example/~x"),
        ("https://a.example", "https://a.example/"),
    ],
)
def test_page_key_same(spark, a, b):
    x, y = values(spark, [a, b], U.page_key)
    assert x == y


@pytest.mark.parametrize("a, b", [("https://a.example/x", "https://a.example/X"), ("https://a.example/x?id=1", "https://a.example/x?id=2"), ("https://a.example/x", "https://b.a.example/x")])
def test_page_key_differs(spark, a, b):
    x, y = values(spark, [a, b], U.page_key)
    assert x != y


def test_canonicalize(spark):
    rows = ["https://a.b/p?utm_source=x&k=1&ref=y#t", " HTTPS://A.b/P?x=&a=b%20c~* ", "", None]
    assert values(spark, rows, U.canonicalize_url) == ["https://a.b/p?k=1", "https://A.b/P?x=&a=b+c~%2A", "", None]


def test_hosts(spark):
    rows = ["https://Sub.A.example:8080/x", "a.example/x", "", None]
    assert values(spark, rows, U.host_of) == ["sub.a.example:8080", "", "", ""]
    assert values(spark, rows, U.base_domain)[:2] == ["a.example", "a.example"]
    assert values(spark, ["a.example", "ftp://x", " ", None], U.normalize_url) == ["https://a.example", "ftp://x", "", None]


def test_text(spark):
    assert values(spark, ["a b  c", "", None, "   "], X.count_words) == [3, 0, 0, 0]
    assert values(spark, ["  A title: it's  ok ", "", None, "___"], X.safe_slug) == ["A_title_its_ok", "doc", "doc", "doc"]
    assert values(spark, [" 2024.0", "2024", None], X.normalize_year) == ["2024", "2024", ""]
    assert values(spark, ["Yes ", "0", None, "TRUE"], X.to_bool) == [True, False, False, True]
    assert values(spark, ["3.7", "x", None], X.to_count) == [3, 0, 0]
    assert values(spark, [" ", "", None, "x"], X.is_blank) == [True, True, True, False]
