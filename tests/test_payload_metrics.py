import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import metrics as M
from lexmill.functions import payload as P


def normalized(spark, *objects):
    rows = [(i, o if isinstance(o, (str, type(None))) else json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", P.normalize(F.col("j")).alias("p"))
    df = df.withColumn("problems", P.problems(F.col("p")))
    return [(r["p"].asDict(True), r["problems"]) for r in df.orderBy("i").collect()]


def test_dirty_payload(spark):
    raw = {
        "risk_signals": {"status": "Probably", "items": ["Drift", " ", "DRIFT", "bias", 7]},
        "deployment_scope": {"status": " PRESENT ", "value": "two plants "},
        "maturity_level": 77,
        "confidence": 1.4,
        "evidence_spans": [{"field": "risk_signals", "excerpt": "drift was seen twice", "begin": "4"}],
    }
    ((p, problems),) = normalized(spark, raw)
    assert p["risk_signals"] == {"status": "uncertain", "items": ["Drift", "bias", "7"]}
    assert p["deployment_scope"] == {"status": "present", "value": "two plants"}
    assert (p["maturity_level"], p["confidence"]) == (4, 1.0)
    assert p["evidence_spans"] == [{"field": "risk_signals", "quote": "drift was seen twice", "start_char": 4, "end_char": None}]
    assert p["kpi_signals"] == {"status": "uncertain", "items": []} and problems == []


def test_bare_fields(spark):
    a, b, c, d = normalized(
        spark,
        {"ai_stack": ["X"], "deployment_scope": "prod", "kpi_signals": {"status": "absent", "items": ["a"]}},
        {"ai_stack": "a,,b"},
        None,
        "",
    )
    assert a[0]["ai_stack"] == {"status": "present", "items": ["X"]}
    assert a[0]["deployment_scope"] == {"status": "present", "value": "prod"}
    assert a[0]["kpi_signals"] == {"status": "absent", "items": []}
    assert b[0]["ai_stack"] == {"status": "present", "items": ["a", "", "b"]}
    assert c[0] == d[0] and c[0]["maturity_level"] == 0 and c[0]["risk_signals"]["status"] == "uncertain"


@pytest.mark.parametrize("given, want", [(2.7, 2), ("3", 3), ("2.7", 0), (True, 1), (None, 0), (-3, 0), ([], 0)])
def test_maturity(spark, given, want):
    assert normalized(spark, {"maturity_level": given})[0][0]["maturity_level"] == want


@pytest.mark.parametrize("given, want", [(-1, 0.0), (2, 1.0), ("0.5", 0.5), ("x", 0.0), (None, 0.0), (0.12345, 0.1235)])
def test_confidence(spark, given, want):
    assert normalized(spark, {"confidence": given})[0][0]["confidence"] == want


def test_spans(spark):
    spans = [{"text": "q", "start": 9, "end": 3, "field": "foo"}, "x", {"quote": "a" * 600, "start_char": -1}]
    p = normalized(spark, {"evidence_spans": spans + [{"quote": str(i)} for i in range(40)]})[0][0]
    assert p["evidence_spans"][0] == {"field": "", "quote": "q", "start_char": 3, "end_char": 9}
    assert len(p["evidence_spans"][1]["quote"]) == 500 and p["evidence_spans"][1]["start_char"] is None
    assert len(p["evidence_spans"]) == 29  # thirty are read, one of them isn't an object


def test_scanner():
    assert P.first_object('```json\n{"a": 1}\n``` and {"b": 2}') == '{"a": 1}'
    assert P.first_object('{"a": {"status": "present"}, "b"') == '{"status": "present"}'
    assert P.first_object("no") is None and P.first_object(None) is None and P.first_object("[1]") is None
    assert P.first_object('{"a": NaN}') == '{"a": null}'
    assert P.first_object("{" * 200_000) is None


def test_warnings(spark):
    raw = '<think>x</think>{"stack": 1, "start": 2}'
    df = spark.createDataFrame([(raw, '{"ai_stack": ["x"], "maturity_level": 2}')], "r string, j string").select("r", P.normalize(F.col("j")).alias("p"))
    got = df.select(P.warnings(F.col("r"), F.col("p"))).first()[0]
    assert got == ["qwen3_thinking_present", "evidence_spans_alias_used", "evidence_spans_empty_despite_signals", "maturity_rationale_empty", "wrong_field_names_detected"]


def kappa(spark, pairs):
    return spark.createDataFrame(pairs, "g int, p int").agg(M.kappa(F.col("g"), F.col("p"))).first()[0]


def brute_kappa(pairs):
    n = len(pairs)
    seen = sum((g - p) ** 2 / 16 for g, p in pairs) / n
    expected = sum((g - q) ** 2 / 16 for g, _ in pairs for _, q in pairs) / n / n
    return 1.0 if expected == 0 else 1 - seen / expected


def test_kappa(spark):
    assert kappa(spark, [(i, i) for i in range(5)]) == 1.0
    assert kappa(spark, [(2, 2), (2, 2)]) == 1.0
    assert kappa(spark, [(0, 4), (4, 0)]) == pytest.approx(-1.0)
    assert kappa(spark, []) == 0.0
    pairs = [(i % 5, (i * 7 + i // 3) % 5) for i in range(57)]
    assert kappa(spark, pairs) == pytest.approx(brute_kappa(pairs))


def overlap(spark, gold, pred):
    kind = "array<struct<field:string,quote:string,start_char:int,end_char:int>>"
    return spark.createDataFrame([(gold, pred)], f"g {kind}, p {kind}").select(M.span_overlap(F.col("g"), F.col("p"))).first()[0]


def test_span_overlap(spark):
    g = [("kpi_signals", "costs fell by a fifth", 100, 150)]
    assert overlap(spark, g, [("kpi_signals", "fell", 120, 170)]) == pytest.approx(30 / 70)
    assert overlap(spark, [("kpi_signals", "costs fell", None, None)], [("kpi_signals", "COSTS", None, None)]) == 0.75
    assert overlap(spark, [], []) == 1.0
    assert overlap(spark, [], g) == 0.0 and overlap(spark, g, []) == 0.0
    assert overlap(spark, g, [("ai_stack", "costs fell by a fifth", 100, 150)]) == 0.0
    assert overlap(spark, g, [("", "x", 100, 150)]) == 1.0


def test_f1_and_judge(spark):
    row = spark.range(1).select(M.f1(F.lit(2), F.lit(1), F.lit(1)).alias("f"), M.f1(F.lit(0), F.lit(0), F.lit(0)).alias("z"), M.judge_score(F.lit(1), F.lit(1), F.lit(0)).alias("j"), M.judge_score(F.lit(1), F.lit(1), F.lit(0), False).alias("k")).first()
    assert row["f"] == pytest.approx(2 / 3) and row["z"] == 0.0
    assert row["j"] == pytest.approx(2 / 3) and row["k"] == pytest.approx(1.0)
