from lexmill.llm import truncation


def frames(spark, texts, answers):
    base = spark.createDataFrame([(f"D{i}", u, t) for i, (u, t) in enumerate(texts)], "doc_id string, url_canonical string, text string")
    return base, spark.createDataFrame([(i, m, r) for i, (m, r) in enumerate(answers)], "prediction_id bigint, model_alias string, raw_response string")


def test_limits_and_broken_transfers_are_told_apart(spark):
    whole = '{"a": "' + "x" * 300 + '"}'
    answers = [("m", whole[: 40 + 7 * i]) for i in range(30)]  # stopped anywhere
    answers += [("m", ('{"b%d": "' % i + "y" * 200)[:120]) for i in range(12)]  # stopped at 120
    answers += [("m", ('{"c%d": "' % i + "z" * 200)[:119] + "…") for i in range(9)]  # the mark takes the last place: 120 characters, 122 bytes
    answers += [("m", "no data")] * 60 + [("n", '{"a": 1}'), ("n", None), ("n", "")]
    base, predictions = frames(spark, [], answers)
    got = {(r["row_key"], r["by"]) for r in truncation.cut_rows(base, predictions).collect()}
    assert got == {(str(i), "transfer") for i in range(30)} | {(str(i), "limit") for i in range(30, 51)}
    lengths = {(r["source"], r["unit"], r["length"]) for r in truncation.limits(base, predictions).collect()}
    assert lengths == {(s, u, n) for s in ("", "m") for u, n in (("chars", 120), ("bytes", 120), ("bytes", 122))}
    rates = {r["source"]: tuple(r)[2:] for r in truncation.truncation_rates(base, predictions).collect()}
    assert rates == {"m": (111, 51, round(51 / 111, 6), 21, 30), "n": (3, 0, 0.0, 0, 0)}


def test_complete_values_make_no_limit(spark):
    """Values of one length that all end with a full stop, ties and repeated rows."""
    texts = [("https://a.example/x", f"Sentence {i:03d} of the same length ends here.") for i in range(50)] + [("https://a.example/x", "Cut in the mid")] * 2
    base, predictions = frames(spark, texts + [(None, None), (None, " "), (None, "")], [])
    assert sorted(tuple(r) for r in truncation.cut_rows(base, predictions).collect()) == [("dataset_base", "D50", "transfer"), ("dataset_base", "D51", "transfer")]
    assert truncation.limits(base, predictions).collect() == []
    clash = base.selectExpr("*", "1 AS source", "'x' AS value", "2 AS __row")
    assert truncation.cut_rows(clash, predictions).count() == 2
