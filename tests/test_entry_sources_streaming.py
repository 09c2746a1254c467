import json
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from lexmill.functions import html
from lexmill.sources import readers, writers
from lexmill.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and all(callable(q) for q in queries.values())
    assert {"q_good_by_source", "q_leaderboard"} <= set(queries)


def test_core_does_not_import_the_text_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "lexmill")):
        if os.path.basename(folder) == "llm" or "__pycache__" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(?:from|import) lexmill\.llm", f.read(), re.M), n


SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": "1", "b": {"c": 2}}\n\nnot json\n[{"a": 1}]\n{"a": 3}\n{"broken": \n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(path), SCHEMA).orderBy("__line").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", '{"c":2}'), ("3", None)]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), SCHEMA).collect() == []


def test_lists_and_paths(spark, tmp_path):
    csv = tmp_path / "u.csv"
    csv.write_text('﻿url,n\n" https://a.example ",1\n,2\n', encoding="utf-8")
    assert [r[0] for r in readers.read_url_list(spark, str(csv)).collect()] == ["https://a.example"]
    ids = tmp_path / "ids.txt"
    ids.write_text("D2\n\n D1 \n", encoding="utf-8")
    assert [r["doc_id"] for r in readers.read_ids(spark, str(ids)).orderBy("position").collect()] == ["D2", "D1"]
    (tmp_path / "empty.txt").write_text("\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_ids(spark, str(tmp_path / "empty.txt"))
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("Größe", encoding="utf-8")
    files = readers.read_texts(spark, str(folder))
    rows = spark.createDataFrame([(1, str(folder / "a.txt")), (2, "other\\a.txt"), (3, "b.txt"), (4, None)], "i int, merged_text_path string")
    got = {r["i"]: r["text"] for r in readers.resolve_text_paths(rows, files).collect()}
    assert got == {1: "Größe", 2: "Größe", 3: None, 4: None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("D1", "r", "m", ["x", "y"], None)], "doc_id string, run_id string, model_alias string, tags array<string>, error string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    part = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json" and p.stat().st_size)
    assert json.loads(part.read_text(encoding="utf-8"))["error"] is None
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["tags"] == "x;y"
    writers.write_predictions(df, str(tmp_path / "p"))
    writers.write_predictions(df.withColumn("model_alias", F.lit("n")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


PAGE = "<html><head><title> A &amp; B </title><script>var x = '<p>';</script></head><body><nav>Menu</nav><article><h1>Head</h1><p>" + "word " * 120 + "</p><!-- no --></article></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<body>" + "x " * 300 + "</body>"), (3, "<p>short</p>"), (4, None)], "i int, h string")
    rows = {r["i"]: r for r in df.select("i", html.article_text(F.col("h")).alias("a"), html.page_title(F.col("h")).alias("t"), html.dom_text(F.col("h")).alias("d")).collect()}
    assert rows[1]["a"].startswith("Head\nword") and "Menu" not in rows[1]["a"] and rows[1]["t"] == "A & B"
    assert rows[1]["d"]["method"] == "playwright_article" and rows[2]["d"]["method"] == "playwright_body"
    assert rows[3]["a"] is None and rows[3]["d"] is None and rows[4]["a"] is None
    body = ")]}',\n" + json.dumps({"x": ["<p>" + "y" * 3000, {"z": "<p>" + "q" * 4000}, "<p>small"]})
    assert html.longest_html(body).endswith("q") and html.longest_html("{") is None and html.longest_html(None) is None
    flags = df.select(html.block_flags(F.lit("Become a member"), F.lit("captcha")).alias("f"), html.login_flags(F.lit("Please Log in")).alias("g")).first()
    assert flags["f"]["paywalled"] and flags["f"]["blocked"] and flags["g"]["login_required"] and not flags["g"]["blocked"]


def test_stream_adds_nothing_twice(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("run_id", "model_alias", "doc_id", "raw_response")])
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    line = lambda d: json.dumps({"run_id": "r", "model_alias": "m", "doc_id": d, "raw_response": "x"})
    (source / "1.jsonl").write_text("\n".join([line("D1"), line("D2"), line("D1"), "broken"]), encoding="utf-8")
    ingest.append_new(ingest.prediction_stream(spark, str(source), schema), table, state).awaitTermination()
    (source / "2.jsonl").write_text("\n".join([line("D2"), line("D3")]), encoding="utf-8")
    ingest.append_new(ingest.prediction_stream(spark, str(source), schema), table, state).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(table).collect()) == ["D1", "D2", "D3"]


def test_windowed_counts(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 3.0), ("2026-01-01 05:00:00", "b", 1.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"], r["avg_value"]) for r in spark.sql("select * from counts").collect()) == [("a", 2, 2.0), ("b", 1, 1.0)]
