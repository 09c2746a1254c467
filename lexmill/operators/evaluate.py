"""Predictions against gold annotations: per document, per model, and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import metrics
from lexmill.functions.payload import LIST_FIELDS, empty, scan_object, stored
from lexmill.functions.text import strip
from lexmill.operators.inference import Generate, ask, judge_prompt


MOST_MODELS = 1000


def latest(predictions: DataFrame) -> DataFrame:
    """The last prediction (greatest prediction_id) of each doc_id and model_alias."""
    w = Window.partitionBy("doc_id", "model_alias").orderBy(F.col("prediction_id").desc())
    return predictions.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def gold_of(golden: DataFrame, split: str) -> DataFrame:
    """(doc_id, gold) of one split, spelling undone; a document annotated twice keeps the fuller
    payload in JSON order, so that the choice doesn't depend on the order of rows."""
    named = golden.where(F.lower(strip(F.col("split"))) == split.strip().lower())
    return named.groupBy("doc_id").agg(F.max("gold_fields_payload").alias("__json")).select("doc_id", stored(F.col("__json")).alias("gold"))


def per_document(golden: DataFrame, predictions: DataFrame, split: str = "test") -> DataFrame:
    """One row per gold document of the split and model: scores, levels and error tags. A model
    without an answer for a document is judged by the empty payload."""
    gold = gold_of(golden, split)
    last = latest(predictions.select("prediction_id", "doc_id", "model_alias", "fields_payload", "structured_valid", "error_tags"))
    # every gold document is judged for every model; the aliases are few, and refused if they aren't
    models = [r[0] for r in predictions.select("model_alias").distinct().limit(MOST_MODELS + 1).collect()]
    if len(models) > MOST_MODELS:
        raise ValueError("too many model aliases")
    pairs = gold.withColumn("model_alias", F.explode(F.array(*[F.lit(m) for m in models]).cast("array<string>")))
    found = last.select("doc_id", "model_alias", "fields_payload", "structured_valid", "error_tags", F.lit(True).alias("__found"))
    joined = pairs.join(found, ["doc_id", "model_alias"], "left")
    scored = joined.withColumn("pred", F.when(F.col("__found"), stored(F.col("fields_payload"))).otherwise(empty()))
    g, p = F.col("gold"), F.col("pred")
    scored = scored.select(
        "doc_id",
        "model_alias",
        "gold",
        "pred",
        metrics.status_accuracy(g, p).alias("status_accuracy"),
        metrics.deployment_exact(g, p).alias("deployment_exact"),
        metrics.span_overlap(g["evidence_spans"], p["evidence_spans"]).alias("span_overlap"),
        g["maturity_level"].alias("maturity_gold"),
        p["maturity_level"].alias("maturity_pred"),
        F.coalesce("structured_valid", F.lit(False)).alias("pred_structured_valid"),
        F.when(F.col("__found"), F.coalesce("error_tags", F.array().cast("array<string>"))).otherwise(F.array(F.lit("missing_prediction"))).alias("__tags"),
    )
    more = F.array_compact(
        F.array(
            F.when(F.col("status_accuracy") < 1, F.lit("status_mismatch")),
            F.when(F.col("deployment_exact") < 1, F.lit("deployment_scope_mismatch")),
            F.when(F.col("maturity_gold") != F.col("maturity_pred"), F.lit("maturity_mismatch")),
            F.when(F.col("span_overlap") < 0.5, F.lit("weak_evidence")),
        )
    )
    return scored.withColumn("error_tags", F.concat("__tags", more)).drop("__tags")


def source_texts(golden: DataFrame, split: str = "test", longest: int = 6000) -> DataFrame:
    """(doc_id, text): the start of each gold document's text, which a judge reads; null where there is
    none. Of a document annotated twice the greater text is taken."""
    named = golden.where(F.lower(strip(F.col("split"))) == split.strip().lower())
    return named.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", F.substring("text", 1, longest).alias("text"))


def rule_judge(text: Column, pred: Column, status_accuracy: Column) -> Column:
    """A judge by rules, as JSON text: grounded is the share of the payload's quotes that stand in the
    text (1 without any), complete the share of statuses that agree, and what isn't grounded is risk."""
    quotes = F.filter(F.transform(pred["evidence_spans"], lambda s: F.coalesce(s["quote"], F.lit(""))), lambda q: q != "")
    found = F.size(F.filter(quotes, lambda q: F.contains(F.coalesce(text, F.lit("")), q)))
    grounded = F.when(F.size(quotes) == 0, 1.0).otherwise(found / F.size(quotes))
    return F.to_json(F.struct(grounded.alias("groundedness"), status_accuracy.alias("completeness"), (1 - grounded).alias("hallucination_risk")))


def judge_answers(scored: DataFrame, texts: DataFrame, generate: Generate, settings: dict | None = None) -> DataFrame:
    """(doc_id, model_alias, raw_response, error_message): each prediction put before a judge."""
    j = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    todo = scored.join(texts, "doc_id", "left").select("doc_id", "model_alias", judge_prompt(F.col("text"), j("gold"), j("pred")).alias("prompt"))
    return ask(todo, generate, settings or {})


def judge_scores(answers: DataFrame) -> DataFrame:
    """(doc_id, model_alias, semantic_score, judge_error) of a judge's answers: an answer without an
    object scores 0 and is a judge_parse_error, a failed call scores 0 with its message."""
    v = F.try_parse_json(F.col("__object"))
    part = lambda n: F.try_variant_get(v, f"$.{n}", "double")
    failed = F.col("error_message").isNotNull()
    error = F.when(failed, F.concat(F.lit("judge_error:"), F.col("error_message"))).when(F.col("__object").isNull(), F.lit("judge_parse_error"))
    score = metrics.judge_score(part("groundedness"), part("completeness"), part("hallucination_risk"))
    rows = answers.select("doc_id", "model_alias", "error_message", scan_object(F.col("raw_response")).alias("__object"))
    return rows.select("doc_id", "model_alias", F.when(error.isNull(), score).otherwise(0.0).alias("semantic_score"), error.alias("judge_error"))


def with_judge(scored: DataFrame, judged: DataFrame) -> DataFrame:
    """``scored`` with semantic_score (0 where the judge has none) and the judge's error among the tags."""
    joined = scored.join(judged, ["doc_id", "model_alias"], "left")
    tags = F.concat("error_tags", F.array_compact(F.array("judge_error")))
    return joined.withColumns({"semantic_score": F.coalesce("semantic_score", F.lit(0.0)), "error_tags": tags}).drop("judge_error")


def f1_by_model(scored: DataFrame) -> DataFrame:
    """(model_alias, micro_f1, macro_f1): counts summed over documents, macro the mean of the eight
    fields' unrounded F1; both rounded to 4 digits."""
    counts = metrics.item_counts(F.col("gold"), F.col("pred"))
    sums = scored.groupBy("model_alias").agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    fields: list[Column] = [metrics.f1(F.col(f"tp_{f}"), F.col(f"fp_{f}"), F.col(f"fn_{f}")) for f in LIST_FIELDS]
    total = {k: sum([F.col(f"{k}_{f}") for f in LIST_FIELDS[1:]], F.col(f"{k}_{LIST_FIELDS[0]}")) for k in ("tp", "fp", "fn")}
    return sums.select(
        "model_alias",
        F.round(metrics.f1(total["tp"], total["fp"], total["fn"]), 4).alias("micro_f1"),
        F.round(sum(fields[1:], fields[0]) / F.lit(float(len(fields))), 4).alias("macro_f1"),
    )


def leaderboard(
    golden: DataFrame, predictions: DataFrame, split: str = "test", strict_weight: float = 0.7, semantic_weight: float = 0.3, judged: DataFrame | None = None
) -> DataFrame:
    """One row per model, best first by final, then strict score, then name. ``judged`` has a judge's
    scores (doc_id, model_alias, semantic_score, judge_error); without it the semantic score is 0."""
    if abs(strict_weight + semantic_weight - 1) > 1e-6:
        raise ValueError("the weights of the strict and the semantic score must add up to 1")
    scored = per_document(golden, predictions, split)
    scored = scored.withColumn("semantic_score", F.lit(0.0)) if judged is None else with_judge(scored, judged)
    parts = scored.groupBy("model_alias").agg(
        F.count(F.lit(1)).alias("docs"),
        F.round(F.avg(F.col("pred_structured_valid").cast("double")), 4).alias("structured_valid_rate"),
        F.avg("status_accuracy").alias("status"),
        F.avg("deployment_exact").alias("deployment"),
        F.avg((F.col("maturity_gold") == F.col("maturity_pred")).cast("double")).alias("maturity"),
        metrics.kappa(F.col("maturity_gold"), F.col("maturity_pred")).alias("kappa"),
        F.avg("span_overlap").alias("spans"),
        F.avg("semantic_score").alias("semantic"),
    )
    joined = parts.join(f1_by_model(scored), "model_alias")
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("kappa") + 1) / 2))
    strict = metrics.strict_score(F.col("status"), F.col("deployment"), F.col("macro_f1"), F.col("maturity"), norm, F.col("spans"))
    out = joined.select(
        "model_alias",
        F.lit(split).alias("split"),
        "docs",
        "structured_valid_rate",
        F.round("status", 4).alias("status_accuracy"),
        F.round("deployment", 4).alias("deployment_exact"),
        F.col("micro_f1").alias("multilabel_micro_f1"),
        F.col("macro_f1").alias("multilabel_macro_f1"),
        F.round("maturity", 4).alias("maturity_accuracy"),
        F.round("kappa", 4).alias("maturity_kappa"),
        F.round("spans", 4).alias("evidence_span_overlap"),
        F.round(strict, 4).alias("strict_score"),
        F.round("semantic", 4).alias("semantic_score"),
        F.round(strict_weight * strict + semantic_weight * F.col("semantic"), 4).alias("final_score"),
    )
    return out.orderBy(F.desc("final_score"), F.desc("strict_score"), "model_alias")


def top_error_tags(scored: DataFrame, k: int = 10) -> DataFrame:
    """(model_alias, tag, n, rank): each model's k most frequent tags, ties by name."""
    counts = scored.select("model_alias", F.explode("error_tags").alias("tag")).groupBy("model_alias", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model_alias").orderBy(F.desc("n"), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def final_dataset(dataset_base: DataFrame, predictions: DataFrame, model_alias: str) -> DataFrame:
    """The documents with the chosen model's last answer as flat columns; documents without one are
    left out, invalid answers are kept and flagged."""
    from lexmill.functions.payload import flatten

    one = latest(predictions.where(F.col("model_alias") == model_alias))
    p = stored(F.col("fields_payload"))
    flat = one.select("doc_id", "model_alias", "run_id", "structured_valid", "raw_response", p.alias("__p")).select(
        "doc_id", "model_alias", "run_id", "structured_valid", "raw_response", *flatten(F.col("__p"))
    )
    return dataset_base.join(flat, "doc_id")


def best_model(board: DataFrame, explicit: str | None = None) -> str:
    """The explicit alias, or the first of the leaderboard."""
    if explicit:
        return explicit
    row = board.orderBy(F.desc("final_score"), F.desc("strict_score"), "model_alias").select("model_alias").first()
    if row is None:
        raise ValueError("the leaderboard is empty")
    return row[0]


def board_lines(board: DataFrame) -> DataFrame:
    """(model_alias, line): each model's row of a Markdown table, scores with four digits."""
    number = lambda c: F.format_string("%.4f", F.col(c))
    cells = [F.col("model_alias"), *[number(c) for c in ("final_score", "strict_score", "semantic_score", "structured_valid_rate")]]
    return board.select("model_alias", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_board(board: DataFrame) -> str:
    """The leaderboard as a Markdown table; one row per model, refused if the models aren't few."""
    rows = board_lines(board).limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError("too many models")
    head = ["| model_alias | final_score | strict_score | semantic_score | structured_valid_rate |", "|---|---:|---:|---:|---:|"]
    return "\n".join([*head, *[r["line"] for r in rows]]) + "\n"
