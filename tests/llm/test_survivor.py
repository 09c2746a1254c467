from lexmill.llm import survivor

CAPTURE = (
    "capture_id bigint, url_original string, url_canonical string, url_final string, domain string, source string, extraction_method string, title string, text string,"
    " word_count int, text_len int, html_len int, error string, flags map<string,boolean>, ts double, ingested_at timestamp_ntz, surplus string"
)


def capture(i, url, text, source="http", method="http", ts=1.0, title="A fine title", domain="a.example"):
    return (i, url, url, url, domain, source, method, title, text, 0, 0, 0, None, {"blocked": False}, ts, None, "x")


def captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURE)


def test_page_groups(spark):
    df = captures(
        spark,
        [
            capture(1, "https://a.example/x", None),
            capture(2, "http://www.a.example/x/", "one two", ts=5.0),
            capture(3, "https://a.example/x#y", "one  two", ts=5.0),
            capture(4, "https://a.example/y", "one two three"),
            capture(5, None, "one"),
            capture(6, " ", "one"),
            capture(7, "https://a.example/z", None, ts=None),
            capture(8, "https://a.example/z", "", ts=None),
        ],
    )
    assert sorted(map(tuple, survivor.page_groups(df).collect())) == [(1, 2), (7, 7)]
    assert survivor.page_groups(df.where("false")).collect() == []


def test_survivors(spark):
    methods = spark.createDataFrame([("http", 5), ("playwright", 2)], "extraction_method string, trust int")
    df = captures(
        spark,
        [
            capture(1, "https://a.example/x", "a long text of words", source="a2", method="playwright", title=None),
            capture(2, "https://a.example/x", "short text", title="The title", domain=None),
            capture(3, "https://a.example/x", None, ts=9.0),
            capture(4, "https://a.example/y", None),
        ],
    )
    rows = {r["first_capture_id"]: r for r in survivor.survivors(df, methods).collect()}
    assert set(rows) == {1, 4}
    a = rows[1]
    assert a["text"] == "short text" and a["word_count"] == 2 and a["text_len"] == 10 and a["source"] == "http" and a["captures"] == 3
    assert a["domain"] == "a.example" and a["extraction_method"] == "http"
    assert rows[4]["text"] is None and rows[4]["word_count"] == 0
    assert survivor.survivors(df.where("false"), methods).collect() == []
