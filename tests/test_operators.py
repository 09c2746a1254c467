import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import corpus, evaluate, inference, sampling

CAPTURE = (
    "capture_id bigint, url_original string, url_canonical string, url_final string, domain string, source string, extraction_method string, title string, text string,"
    " word_count int, text_len int, html_len int, error string, flags map<string,boolean>, ts double, ingested_at timestamp_ntz, surplus string"
)


def capture(i, url, text, source="http", method="http", ts=1.0, title="A fine title", domain="a.example"):
    return (i, url, url, url, domain, source, method, title, text, 0, 0, 0, None, {"blocked": False}, ts, None, "x")


def captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURE)


def test_corpus(spark):
    good = "word " * 400
    df = captures(spark, [capture(1, "https://a.example/x", good), capture(2, "https://a.example/x?utm_source=q", "cookie " * 400), capture(3, "https://a.example/y", "short"), capture(4, "https://a.example/z", "  ")])
    best = {r["url_canonical"]: r for r in corpus.best_per_url(df).collect()}
    assert best["https://a.example/x"]["capture_id"] == 1 and best["https://a.example/x"]["good"]
    assert not best["https://a.example/y"]["good"]
    assert {(r["capture_id"], r["reason"]) for r in corpus.rejects(df).collect()} == {(2, "duplicate_url_canonical"), (4, "text_is_empty")}
    base = corpus.dataset_base(corpus.best_per_url(df)).collect()
    assert [r["doc_id"] for r in base] == ["DOC000001"]


def synthetic(spark):
    rows = [(f"DOC{i:06d}", f"Industry {i % 5}", str(2020 + i % 5), 3000 + i % 100) for i in range(220)]
    return spark.createDataFrame(rows, "doc_id string, industry string, year string, text_len int")


def test_golden_sample(spark):
    sample = sampling.stratified_sample(synthetic(spark), 180)
    split = sampling.assign_splits(sample, 120, 30)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 120, "dev": 30, "test": 30}
    assert split.select("doc_id").distinct().count() == 180
    assert sampling.qa_sample(split).count() == 36
    again = sampling.stratified_sample(synthetic(spark).repartition(7), 180)
    assert {r[0] for r in again.select("doc_id").collect()} == {r[0] for r in sample.select("doc_id").collect()}


def brute_allocation(sizes, target):
    total = sum(sizes.values())
    exact = {k: v / total * target for k, v in sizes.items()}
    n = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - n[k]), k)):
        if sum(n.values()) < target and n[k] < sizes[k]:
            n[k] += 1
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        take = min(sizes[k] - n[k], target - sum(n.values()))
        n[k] += max(0, take)
    return n


@pytest.mark.parametrize("target", [0, 1, 7, 30, 61])
def test_allocation(spark, target):
    sizes = {"a": 1, "b": 13, "c": 20, "d": 20, "e": 7}
    df = spark.createDataFrame(list(sizes.items()), "__stratum string, size bigint")
    assert {r[0]: r[2] for r in sampling.allocate(df, target).collect()} == brute_allocation(sizes, target)


def payload(level=1, items=(), status="present", spans=()):
    return json.dumps({"ai_use_cases": {"status": status, "items": list(items)}, "deployment_scope": {"status": "absent", "value": ""}, "maturity_level": level, "maturity_rationale": "r", "confidence": 0.5, "evidence_spans": list(spans)})


def test_leaderboard(spark):
    golden = spark.createDataFrame([("D1", " Test", payload(1, ["chatbot", "forecasting"])), ("D2", "test", payload(2)), ("D3", "train", payload(0)), ("D4", None, None)], "doc_id string, split string, gold_fields_payload string")
    predictions = spark.createDataFrame(
        [(1, "D1", "m", payload(0), True, []), (2, "D1", "m", payload(1, ["Chatbot "]), True, []), (3, "D2", "m", payload(2), False, ["parse_error"]), (4, "D1", "n", payload(1), True, None)],
        "prediction_id bigint, doc_id string, model_alias string, fields_payload string, structured_valid boolean, error_tags array<string>",
    )
    board = evaluate.leaderboard(golden, predictions).collect()
    assert [r["model_alias"] for r in board] == ["m", "n"]
    assert board[0]["docs"] == 2 and board[0]["maturity_accuracy"] == 1.0 and board[0]["structured_valid_rate"] == 0.5
    assert board[0]["multilabel_micro_f1"] == pytest.approx(0.6667) and board[0]["multilabel_macro_f1"] == pytest.approx(0.0833)
    scored = evaluate.per_document(golden, predictions)
    tags = {(r["doc_id"], r["model_alias"]): r["error_tags"] for r in scored.collect()}
    assert "missing_prediction" in tags["D2", "n"] and "maturity_mismatch" in tags["D2", "n"]
    assert evaluate.best_model(evaluate.leaderboard(golden, predictions)) == "m"
    assert "| m |" in evaluate.markdown_board(evaluate.leaderboard(golden, predictions))
    with pytest.raises(ValueError):
        evaluate.leaderboard(golden, predictions, strict_weight=0.5, semantic_weight=0.2)


def test_inference(spark):
    docs = spark.createDataFrame([("D1", "Generative models run in production across functions"), ("D2", "nothing here"), ("D3", None)], "doc_id string, text string")
    run = {r["doc_id"]: r for r in inference.run_rules(docs, "run").collect()}
    assert run["D1"]["maturity_level"] == 3 and run["D1"]["deployment_scope_value"] == "multi-function" and run["D1"]["structured_valid"]
    assert run["D2"]["maturity_level"] == 0 and run["D2"]["confidence"] == 0.55 and run["D3"]["maturity_level"] == 0

    def generate(system, user, settings):
        if "D2" in user:
            raise RuntimeError("down")
        return 'Here: {"maturity_level": 2, "maturity_rationale": "x"}'

    todo = inference.remaining(docs, ["m"], spark.createDataFrame([("D3", "m")], "doc_id string, model_alias string"))
    rows = {r["doc_id"]: r for r in inference.predictions_of(inference.ask(todo.withColumn("prompt", F.col("doc_id")), generate, {}), "run").collect()}
    assert set(rows) == {"D1", "D2"}
    assert rows["D1"]["maturity_level"] == 2 and rows["D2"]["error_tags"][:2] == ["provider_error", "parse_error"] and rows["D2"]["error_message"] == "down"
    with pytest.raises(ValueError):
        inference.select_aliases(["a"], ["b"])
