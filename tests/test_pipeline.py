import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import html
from lexmill.operators import corpus, evaluate, inference, providers, sampling
from lexmill.runtime import scratch, shared_folder
from lexmill.sources import readers, writers, xlsx

MODEL = inference.Model("m", "openai", "some-model", "http://host/v1/", 5, {"body": {"extra": 1}, "headers": {"X": "y"}, "api_key_env": "LEXMILL_TEST_KEY"})


def sent(model, answer, settings=None):
    calls = []

    def send(request, timeout):
        calls.append(request)
        return answer

    return providers.build_provider(model, send)("sys", "user", settings or {}), calls[0]


def test_services(monkeypatch):
    monkeypatch.setenv("LEXMILL_TEST_KEY", "k1")
    got, asked = sent(MODEL, {"choices": [{"message": {"content": "hello"}}]}, {"temperature": 0.5, "json_mode": False})
    assert got == "hello" and asked.url == "http://host/v1/chat/completions" and asked.headers == {"Authorization": "Bearer k1", "X": "y"}
    assert asked.body["temperature"] == 0.5 and asked.body["extra"] == 1 and asked.body["seed"] == 42 and "response_format" not in asked.body
    local = inference.Model("o", "ollama_native", "Qwen3:8b", "http://host:11434/v1")
    got, asked = sent(local, {"message": {"content": "x"}, "eval_count": 3})
    assert got == "x" and asked.url == "http://host:11434/api/chat" and asked.body["think"] is False and asked.body["format"] == "json"
    assert "think" not in sent(inference.Model("o", "ollama", "gemma", "http://h"), {})[1].body
    far = inference.Model("g", "Gemini", "gem", extra={"api_key_env": "LEXMILL_TEST_KEY"})
    got, asked = sent(far, {"candidates": [{"content": {"parts": [{"text": "t"}]}}]})
    assert got == "t" and asked.url.endswith("/gem:generateContent?key=k1") and asked.body["generationConfig"]["responseMimeType"] == "application/json"
    assert providers.read_answer(providers.DIALECTS["ollama"], {"prompt_eval_count": 2, "eval_count": 3}) == ("", {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5})
    assert providers.read_answer(providers.DIALECTS["openai"], {"choices": []}) == ("", {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0})
    for bad in (inference.Model("x", "other", "m"), ):
        with pytest.raises(ValueError):
            providers.build_provider(bad)
    with pytest.raises(ValueError):
        sent(inference.Model("x", "openai", "m"), {})
    with pytest.raises(ValueError):
        sent(inference.Model("x", "gemini", "m"), {})


def test_faults_of_the_connection_are_tried_again(monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    calls = []

    def send(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("down")
        return {"choices": [{"message": {"content": "late"}}]}

    assert providers.build_provider(MODEL, send)("s", "u", {}) == "late" and len(calls) == 3


def test_the_rule_service_agrees_with_the_rule_column(spark):
    texts = ["Machine learning at scale", "an LLM in production", "nothing", "generative pilot across functions"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", inference.rule_answer(F.col("t")).alias("a")).collect()
    for r in rows:
        a, b = json.loads(r["a"]), json.loads(providers.build_provider(inference.Model("m", "mock"))("", r["t"], {}))
        assert (a["maturity_level"], a["deployment_scope"], a["confidence"]) == (b["maturity_level"], b["deployment_scope"], b["confidence"])


def test_registry_keeps_extras(tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"models": [{"model_alias": "a", "provider": "openai", "model_id": "x", "extra_headers": {"h": "1"}, "api_key_env": "K", "timeout_sec": None}]}), encoding="utf-8")
    m = inference.load_registry(str(path))["a"]
    assert m.extra["headers"] == {"h": "1"} and m.extra["api_key_env"] == "K" and m.timeout_sec == 120


def gold(level=1, quote="the quote"):
    return json.dumps({"deployment_scope": {"status": "absent", "value": ""}, "maturity_level": level, "maturity_rationale": "r", "confidence": 0.5, "evidence_spans": [{"field": "", "quote": quote}]})


def test_judge(spark):
    golden = spark.createDataFrame([("D1", "test", gold(), "a text with the quote in it"), ("D2", "test", gold(), None)], "doc_id string, split string, gold_fields_payload string, text string")
    predictions = spark.createDataFrame([(1, "D1", "m", gold(), True, []), (2, "D2", "m", gold(2), True, None)], "prediction_id bigint, doc_id string, model_alias string, fields_payload string, structured_valid boolean, error_tags array<string>")
    scored, texts = evaluate.per_document(golden, predictions), evaluate.source_texts(golden)

    def generate(system, user, settings):
        if "with the quote" in user:
            return 'So: {"groundedness": 0.9, "completeness": 2, "hallucination_risk": 0.2}'
        raise RuntimeError("no text")

    judged = evaluate.judge_scores(evaluate.judge_answers(scored, texts, generate)).cache()
    assert {(r["doc_id"], round(r["semantic_score"], 4), r["judge_error"]) for r in judged.collect()} == {("D1", 0.9, None), ("D2", 0.0, "judge_error:no text")}
    board = evaluate.leaderboard(golden, predictions, judged=judged).first()
    assert board["semantic_score"] == 0.45 and board["final_score"] == pytest.approx(0.7 * board["strict_score"] + 0.135, abs=1e-4)
    tags = {r["doc_id"]: r["error_tags"] for r in evaluate.with_judge(scored, judged).collect()}
    assert tags["D2"][-1] == "judge_error:no text" and "judge_error" not in " ".join(tags["D1"])
    broken = judged.select("doc_id", "model_alias", F.lit("nothing here").alias("raw_response"), F.lit(None).cast("string").alias("error_message"))
    assert {r["judge_error"] for r in evaluate.judge_scores(broken).collect()} == {"judge_parse_error"}


def test_documents_of_a_list(spark):
    docs = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), (None, 4)], "doc_id string, x int")
    ids = spark.createDataFrame([("C", 0), ("Z", 1), ("A", 2), ("C", 5), (None, 6)], "doc_id string, position bigint")
    assert [r["doc_id"] for r in inference.select_documents(docs, ids).orderBy("position").collect()] == ["C", "A"]
    assert [r["doc_id"] for r in inference.select_documents(docs, ids, 1).collect()] == ["C"]
    assert inference.select_documents(docs).count() == 4 and inference.select_documents(docs.where("false"), ids).collect() == []


def test_least_drawn_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("__stratum"))
    plan = df.groupBy("__stratum").count().select("__stratum", F.expr("least(count, 1 + count div 3)").alias("n"))
    want = {}
    for r in df.withColumn("d", sampling.draw(F.col("doc_id"), 42)).collect():
        want.setdefault(r["__stratum"], []).append((r["d"], r["doc_id"]))
    sizes = {r["__stratum"]: r["n"] for r in plan.collect()}
    expected = {i for s, rows in want.items() for _, i in sorted(rows)[: sizes[s]]}
    rows = sampling.take_least(df, "doc_id", 42, plan, "in").collect()
    assert len(rows) == 3000 and {r["doc_id"] for r in rows if r["in"]} == expected
    for n in (0, 1, 2999, 3000, 5000):
        assert sum(r["in"] for r in sampling.take_least(df, "doc_id", 42, None, "in", n).collect()) == min(n, 3000)
    assert sampling.take_least(df.where("false"), "doc_id", 42, None, "in", 5).collect() == []


def test_top_up_and_order(spark):
    pool = spark.range(40).select(F.format_string("D%02d", "id").alias("doc_id"))
    assert sampling.top_up(pool.limit(3), pool, 10).distinct().count() == 10
    assert sampling.top_up(pool.limit(3), pool, 2).count() == 3 and sampling.top_up(pool.limit(3), pool, 99).count() == 40
    golden = spark.createDataFrame([("B", "test"), ("A", " Dev"), ("C", "train"), ("B", "test"), ("D", None)], "doc_id string, split string")
    assert [(r["doc_id"], r["position"]) for r in sampling.golden_order(golden).orderBy("position").collect()] == [("C", 1), ("A", 2), ("B", 3), ("D", 4)]
    assert sampling.golden_order(golden.where("false")).collect() == []


def test_stage_pieces(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "b", {"x": True}, "boom"), (2, "a", "b", None, "")], "capture_id int, url_original string, url_canonical string, flags map<string,boolean>, error string")
    assert [r[0] for r in df.select(corpus.first_of(df, "no", "url_original", "url_canonical")).collect()] == ["b", "a"]
    assert [r[0] for r in df.select(corpus.flags_json(df)).collect()] == ['{"x":true}', "{}"]
    text = df.withColumn("flags", F.lit(" "))
    assert {r[0] for r in text.select(corpus.flags_json(text)).collect()} == {"{}"}
    assert [tuple(r) for r in corpus.error_rows(df).collect()] == [(1, "b", "boom")]
    writers.write_errors(corpus.error_rows(df), str(tmp_path / "e"))
    writers.write_errors(corpus.error_rows(df), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2
    writers.write_report(corpus.stage_report("s", df, F.col("url_original")), str(tmp_path / "r"))
    assert {(r["bucket"], r["n"]) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("", 1), ("a", 1)}
    good = corpus.http_good(F.col("s"), F.lit(400), F.lit(2000)).alias("g")
    assert [r["g"] for r in spark.createDataFrame([(200,), (404,), (None,)], "s int").select(good).collect()] == [True, False, False]
    best = spark.createDataFrame([("u1", True), ("u2", True), ("u3", False)], "url_canonical string, good boolean")
    exported = spark.createDataFrame([("u1", "p2"), ("u1", "p1"), ("u3", "p3")], "url_canonical string, text_path string")
    assert {(r[0], r[2], r[3]) for r in corpus.with_paths(best, exported).collect()} == {("u1", "p1", False), ("u2", "", True), ("u3", "p3", True)}


def test_text_files_and_folders(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "Größe"), ("b.txt", ""), ("c.txt", None)], "name string, text string")
    writers.write_texts(df, str(tmp_path / "t"))
    writers.write_texts(df, str(tmp_path / "t"))
    assert {(r["name"], r["text"]) for r in readers.read_texts(spark, str(tmp_path / "t")).collect()} == {("a.txt", "Größe")}
    writers.write_csv(spark.createDataFrame([(" a \n", 1)], "t string, n int"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "c")).first()["t"] == " a \n"
    assert scratch(spark, "x") != scratch(spark, "x") and scratch(spark, "x").startswith(shared_folder(spark).rstrip("/"))
    assert not readers.exists(spark, str(tmp_path / "none")) and readers.exists(spark, str(tmp_path / "c"))


def test_lines_of_a_page_are_trimmed_of_spaces_only(spark):
    page = "<article>" + "".join(f"<p> {k}{k} line number {k} </p>" for k in range(60)) + "</article>"
    got = spark.createDataFrame([(page,)], "h string").select(html.article_text(F.col("h")).alias("t"), html.fallback_text(F.lit("<body><nav>Menu</nav>" + page + "</body>")).alias("f")).first()
    assert got["t"] == got["f"] == "\n".join(f"{k}{k} line number {k}" for k in range(60))


def test_best_page_when_ids_repeat(spark):
    df = spark.createDataFrame([(1, "https://a.example/x", "w " * 400), (1, "https://a.example/x", "w " * 400), (2, "https://a.example/x?utm_source=1", "v")], "capture_id bigint, url_canonical string, text string")
    df = df.withColumns({"url_original": F.col("url_canonical"), "source": F.lit("http"), "extraction_method": F.lit("http"), "title": F.lit(None).cast("string"), "word_count": F.lit(None).cast("int"), "text_len": F.lit(None).cast("int")})
    rows = corpus.best_per_url(df).collect()
    assert [(r["capture_id"], r["word_count"]) for r in rows] == [(1, 400)]


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a & <b> \n", 1, 2.5, True), (None, None, None, None), ("x\x01y", -3, 1e-9, False)], "t string, n int, d double, b boolean")
    path = str(tmp_path / "b.xlsx")
    xlsx.write_xlsx(path, first=df, second=df.where("false"))
    got = [tuple(r) for r in xlsx.read_xlsx(spark, path).collect()]
    assert got == [("a & <b> \n", "1", "2.5", "true"), (None,) * 4, ("xy", "-3", "1e-09", "false")]
    xlsx.write_xlsx(path, only=df.where("false"))
    assert xlsx.read_xlsx(spark, path).columns == ["t", "n", "d", "b"] and xlsx.read_xlsx(spark, path).count() == 0
    assert [xlsx._letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and xlsx._column("AAA") == 702


def test_bucket(spark):
    rows = [("https://a.example/x", "12", 100, "one"), (" https://a.example/x", "x", 900, "two"), ("https://a.example/x", "12", 100, "three"), ("b.example", None, None, None)]
    got = {r["url_norm"]: (r["word_count"], r["text"], r["status_code"]) for r in corpus.bucket(spark.createDataFrame(rows, "url string, word_count string, text_len int, text string")).collect()}
    assert got == {"https://a.example/x": (12, "three", 0), "https://b.example": (0, "", 0)}
    assert corpus.bucket(spark.createDataFrame([], "url string")).collect() == []
