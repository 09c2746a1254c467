import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import survivor
from tests.llm.test_survivor import CAPTURE, capture, captures


def brute(lists):
    best = None
    for combo in itertools.product(*[sorted(c, key=lambda x: (x[1], x[2]), reverse=True) for c in lists]):
        ties = {c[0] for c in combo if c[0]}
        total = [sum(v) for v in zip(*[c[1] for c in combo])]
        if len(ties) <= 1 and (best is None or total > best[0]):
            best = total, [c[2] for c in combo]
    return best[1] if best else [max(c, key=lambda x: (x[1], x[2]))[2] for c in lists]


candidate = st.tuples(st.sampled_from(["", "x", "y", "z"]), st.lists(st.integers(0, 3).map(float), min_size=3, max_size=3), st.integers(-50, -1))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(candidate, min_size=1, max_size=5), min_size=1, max_size=4))
def test_branch_and_bound_is_the_best_of_all(lists):
    assert survivor.branch_and_bound(lists) == brute(lists)


METHODS = [("http", 5), ("playwright", 2), ("medium_amp", 3)]


def one(spark, rows):
    methods = spark.createDataFrame(METHODS, "extraction_method string, trust int")
    return {r["first_capture_id"]: r for r in survivor.survivors(captures(spark, rows), methods).collect()}


def test_more_words_count_before_recency(spark):
    """A capture with a bad clock wins by its words, and of equal words the recent one."""
    rows = [capture(1, "https://a.example/x", "w " * 110, ts=0.0), capture(2, "https://a.example/x", "w " * 100, ts=1.7e9)]
    rows += [capture(3, "https://a.example/y", "a b", ts=2.0), capture(4, "https://a.example/y", "c d", ts=3.0)]
    got = one(spark, rows)
    assert got[1]["content_from"] == 1 and got[1]["time_from"] == 2 and got[3]["content_from"] == 4


def test_dependencies_hold_in_the_record(spark):
    """The source is the one that the text's method has; a title of another source isn't taken beside it."""
    rows = [capture(i, f"https://b.example/{i}", "some text here", source="medium", method="medium_amp") for i in range(20, 25)]
    rows += [capture(i, f"https://c.example/{i}", "some text here", source="http", method="http") for i in range(30, 35)]
    rows += [capture(1, "https://a.example/x", "a b c d", source="http", method="http", title=None, ts=1.0)]
    rows += [capture(2, "https://a.example/x", "a b c", source="medium", method="medium_amp", title="Theirs", ts=9.0)]
    rows += [capture(3, "https://a.example/x", None, source="http", method="http", title="Ours", ts=2.0)]
    r = one(spark, rows)[1]
    assert (r["content_from"], r["source"], r["title"], r["extraction_method"], r["word_count"], r["time_from"]) == (1, "http", "Ours", "http", 4, 2)


def test_odd_rows_and_repeated_ids(spark):
    rows = [capture(1, "https://a.example/x", "one"), capture(1, "https://a.example/x", "two"), capture(2, None, "x"), capture(3, " ", "x"), capture(4, "https://a.example/n", None, title=None, domain=None, method=None, source=None, ts=None)]
    got = [sorted(map(tuple, one(spark, rows).values()), key=str), sorted(map(tuple, one(spark, rows[::-1]).values()), key=str)]
    assert got[0] == got[1] and len(got[0]) == 2
    df = captures(spark, rows)
    assert [tuple(r) for r in survivor.page_groups(df).collect()] == [(1, 1)]
    clash = df.withColumns({c: F.lit("x") for c in ("k", "id", "p", "n", "best", "implied", "trust")})
    methods = spark.createDataFrame(METHODS, "extraction_method string, trust int")
    assert survivor.survivors(clash, methods).count() == 2 and survivor.page_groups(clash).count() == 1
    assert survivor.choices(spark.createDataFrame([], CAPTURE), methods).collect() == []


def test_a_page_captured_very_often(spark):
    df = spark.range(5000).select(F.col("id").alias("capture_id"), F.lit("https://a.example/x").alias("url_canonical"), F.repeat(F.lit("w "), (F.col("id") % 1000).cast("int")).alias("text"), F.lit(1.0).alias("ts"))
    assert [tuple(r) for r in survivor.page_groups(df).collect()] == [(0, 999)]
