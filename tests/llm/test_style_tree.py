from pyspark.sql import functions as F

from lexmill.llm import main_body


def own(i):
    return f"Account number {i} of {chr(97 + i % 26) * 8}{chr(97 + i // 26) * 6} tells what the office in that town did about its letters."


def found(df):
    return {tuple(r) for r in main_body.cut_lines(df).collect()}


def test_what_a_large_host_shows_once_is_its_own(spark):
    """A form that one page of hundreds shows is text; on a host of one page its wording decides."""
    rows = [(i, f"https://big.example/{i}", own(i)) for i in range(300)]
    rows[0] = (0, "https://big.example/0", own(0) + "\nBy the river in June")
    rows += [(900, "https://small.example/x", own(700) + "\nBy Ann Example in June")]
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    assert found(df) == {(900, 2, "form")}


def test_furniture_in_wordings_that_no_list_has(spark):
    rows = [(i, f"https://site.example/{i}", f"Zum Verteiler beitreten\n{own(i)}\nWeergave: {own(i)[8:40]}") for i in range(60)]
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    assert found(df) == {(i, 1, "content") for i in range(60)} | {(i, 3, "label") for i in range(60)}


def test_odd_rows(spark):
    long = "x" * 20_000 + " " + "Read more"
    rows = [(1, "https://a.example/1", long), (1, "https://a.example/1", long), (2, None, None), (3, "", "  \n\t"), (4, "https://a.example/2", own(1) + "\n\n\n"), (5, " ", "\n" + own(2))]
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("host", "page", "kind", "key", "line_no", "by")])
    assert found(clash) == {(1, 1, "form")}
    assert main_body.cut_lines(df.where("false")).collect() == []
