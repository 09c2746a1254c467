"""Models over documents: prompts as columns, providers as Arrow maps, resumable runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.payload import normalize, problems, scan_object, snapshot, warnings

# Words by which the rule model recognises its subject and a document's level.
AI_WORDS = (" ai ", "artificial intelligence", "machine learning", "llm", "generative")
LEVEL_WORDS = ((2, ("production",), "production"), (3, ("multiple functions", "across functions"), "multi-function"), (4, ("enterprise-wide", "at scale"), "enterprise"))


@dataclass(frozen=True)
class Model:
    """A model of the registry."""

    model_alias: str
    provider: str
    model_id: str = ""
    base_url: str = ""
    timeout_sec: int = 60
    extra: dict = field(default_factory=dict)


def load_registry(path: str) -> dict[str, Model]:
    """Models by alias; a missing key, an empty list and a repeated alias are errors."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f).get("models") or []
    out: dict[str, Model] = {}
    for e in entries:
        missing = [k for k in ("model_alias", "provider", "model_id") if not e.get(k)]
        if missing:
            raise ValueError(f"model without {', '.join(missing)}")
        extra = {"body": e.get("extra_body") or {}, "headers": e.get("extra_headers") or {}, "api_key_env": e.get("api_key_env") or ""}
        if e["model_alias"] in out:
            raise ValueError(f"alias {e['model_alias']} twice")
        out[e["model_alias"]] = Model(e["model_alias"], e["provider"], e["model_id"], e.get("base_url") or "", int(e.get("timeout_sec") or 120), extra)
    if not out:
        raise ValueError("no models in the registry")
    return out


def select_aliases(registry: Iterable[str], wanted: list[str] | None = None) -> list[str]:
    """The known ones of ``wanted`` in that order, or all sorted; none left is an error."""
    known = set(registry)
    chosen = [w for w in wanted if w in known] if wanted else sorted(known)
    if not chosen:
        raise ValueError("no known model was selected")
    return chosen


def load_settings(path: str | None) -> dict:
    """Inference settings from a JSON file over the defaults; unreadable files give the defaults."""
    defaults = {"temperature": 0.0, "top_p": 0.95, "max_output_tokens": 2048, "json_mode": True, "seed": 42, "max_text_chars": 16000}
    try:
        with open(path or "", encoding="utf-8") as f:
            return {**defaults, **json.load(f)}
    except (OSError, ValueError):
        return defaults


def prompt(version: str = "v1", longest: int = 16000) -> Column:
    """The user prompt of each document: instructions, metadata, and its text up to ``longest``
    characters, cut before it leaves the engine."""
    intro = {
        "v1": "Extract the listed fields from the article as one JSON object. Use present, absent or uncertain for each status and quote the evidence.",
        "v2": "Extract the listed fields from the article as one JSON object. Check every field against the text before you answer; of two levels choose the lower; quote the evidence verbatim.",
    }
    if version not in intro:
        raise ValueError(f"unknown prompt version {version}")
    meta = F.concat(*[x for c in ("company", "industry", "year", "title") for x in (F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))])
    return F.concat(F.lit(intro[version] + "\n\n"), meta, F.lit("\n"), F.substring(F.coalesce(F.col("text"), F.lit("")), 1, longest))


def judge_prompt(text: Column, gold: Column, pred: Column, longest: int = 6000) -> Column:
    """The prompt by which a judge compares two payloads (JSON) over their source."""
    return F.concat(F.lit("Rate groundedness, completeness and hallucination_risk from 0 to 1 as one JSON object.\n\nSource:\n"), F.substring(F.coalesce(text, F.lit("")), 1, longest), F.lit("\n\nReference:\n"), gold, F.lit("\n\nCandidate:\n"), pred)


def rule_answer(text: Column) -> Column:
    """The rule model's answer (JSON) as a plain expression over the article's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: sum([F.contains(low, F.lit(w)).cast("int") for w in words[1:]], F.contains(low, F.lit(words[0])).cast("int")) > 0
    level, scope = F.lit(1), F.lit("pilot")
    for n, words, name in LEVEL_WORDS:
        level, scope = F.when(any_of(words), n).otherwise(level), F.when(any_of(words), F.lit(name)).otherwise(scope)
    listed = lambda *items: F.struct(F.lit("present").alias("status"), F.array(*[F.lit(i) for i in items]).alias("items"))
    open_ = F.struct(F.lit("uncertain").alias("status"), F.array().cast("array<string>").alias("items"))
    none = F.struct(F.lit("absent").alias("status"), F.array().cast("array<string>").alias("items"))
    span = F.struct(F.lit("deployment_scope").alias("field"), F.lit("in production").alias("quote"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    found = F.struct(
        listed("automation", "decision support").alias("ai_use_cases"), listed("pilot", "copilot").alias("adoption_patterns"), listed("llm", "cloud").alias("ai_stack"),
        listed("productivity").alias("kpi_signals"), open_.alias("budget_signals"), open_.alias("org_change_signals"), listed("data privacy").alias("risk_signals"),
        listed("scale next quarter").alias("roadmap_signals"), F.struct(F.lit("present").alias("status"), scope.alias("value")).alias("deployment_scope"), level.alias("maturity_level"),
        F.lit("The text names where and how far the system runs.").alias("maturity_rationale"), F.lit(0.78).alias("confidence"), F.array(span).alias("evidence_spans"),
    )
    missing = F.struct(
        *[none.alias(f) for f in ("ai_use_cases", "adoption_patterns", "ai_stack", "kpi_signals", "budget_signals", "org_change_signals", "risk_signals", "roadmap_signals")],
        F.struct(F.lit("absent").alias("status"), F.lit("").alias("value")).alias("deployment_scope"), F.lit(0).alias("maturity_level"),
        F.lit("The text names no such system.").alias("maturity_rationale"), F.lit(0.55).alias("confidence"), F.slice(F.array(span), 1, 0).alias("evidence_spans"),
    )
    return F.when(any_of(AI_WORDS), F.to_json(found)).otherwise(F.to_json(missing))


Generate = Callable[[str, str, dict], str]


def with_retries(generate: Generate, attempts: int = 3, first_wait: float = 2.0, longest_wait: float = 8.0) -> Generate:
    """``generate`` tried again after connection errors and timeouts, waiting twice as long each time."""

    def call(system: str, user: str, settings: dict) -> str:
        wait = first_wait
        for left in range(attempts - 1, -1, -1):
            try:
                return generate(system, user, settings)
            except (ConnectionError, TimeoutError):
                if not left:
                    raise
                time.sleep(wait)
                wait = min(longest_wait, wait * 2)
        raise AssertionError

    return call


def ask(todo: DataFrame, generate: Generate, settings: dict, system: str = "") -> DataFrame:
    """(doc_id, model_alias, raw_response, latency_ms, error_message): ``todo`` (doc_id, model_alias,
    prompt) through a provider, Arrow batch by batch. A failing call gives an empty answer and its
    message; calls must bear being repeated, as tasks may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ms, error = [], [], []
            for user in batch.column(2).to_pylist():
                began = time.monotonic()
                try:
                    raw.append(generate(system, user or "", settings))
                    error.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a provider raises is its row's error
                    raw.append("")
                    error.append(str(e))
                ms.append(int((time.monotonic() - began) * 1000))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, type=pa.string()), pa.array(ms, type=pa.int64()), pa.array(error, type=pa.string())],
                names=["doc_id", "model_alias", "raw_response", "latency_ms", "error_message"],
            )

    return todo.select("doc_id", "model_alias", "prompt").mapInArrow(run, "doc_id string, model_alias string, raw_response string, latency_ms bigint, error_message string")


def select_documents(dataset: DataFrame, ids: DataFrame | None = None, max_docs: int | None = None) -> DataFrame:
    """``dataset`` with its position in a run: the documents of a list (doc_id, position) in its order,
    else all by doc_id; a list's unknown ids are left out and an id that is there twice keeps its first
    place. ``max_docs`` keeps the first so many."""
    if ids is None:
        placed = dataset.withColumn("position", F.col("doc_id"))
    else:
        placed = dataset.join(ids.groupBy("doc_id").agg(F.min("position").alias("position")), "doc_id")
    return placed if max_docs is None else placed.orderBy("position").limit(max_docs)


def run_id(prefix: str, at: Column) -> Column:
    """``prefix`` and a UTC time, as runs are named."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def inference_log(predictions: DataFrame) -> DataFrame:
    """One event a prediction, as JSON text: what a run's log says of it."""
    event = F.struct("doc_id", "model_alias", "latency_ms", "structured_valid", F.coalesce("error_tags", F.array().cast("array<string>")).alias("error_tags"), F.coalesce("maturity_level", F.lit(0)).alias("maturity_level"))
    return predictions.select("prediction_id", F.to_json(event, {"ignoreNullFields": "false"}).alias("event"))


def annotation_summary(predictions: DataFrame) -> DataFrame:
    """Per run and model, as annotators check a batch: rows, valid ones and their share, levels and mean
    confidence of the valid ones."""
    valid = F.coalesce("structured_valid", F.lit(False))
    levels = [F.count_if(valid & (F.col("maturity_level") == k)).alias(f"level_{k}") for k in range(5)]
    return predictions.groupBy("run_id", "model_alias").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("valid"), F.round(F.avg(valid.cast("double")), 4).alias("valid_rate"), F.count_if(~valid).alias("parse_errors"), *levels,
        F.coalesce(F.round(F.avg(F.when(valid, F.col("confidence"))), 4), F.lit(0.0)).alias("avg_confidence"),
    )


def remaining(dataset: DataFrame, aliases: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Documents and models that have no prediction yet."""
    pairs = dataset.withColumn("model_alias", F.explode(F.array(*[F.lit(a) for a in aliases])))
    return pairs if existing is None else pairs.join(existing.select("doc_id", "model_alias"), ["doc_id", "model_alias"], "left_anti")


def predictions_of(answers: DataFrame, run_id: str) -> DataFrame:
    """Prediction rows of answers: parsed, normalised, flagged."""
    a = answers.withColumn("__object", scan_object(F.col("raw_response"))).withColumn("__p", normalize(F.col("__object")))
    failed = F.col("error_message").isNotNull()
    kinds = F.array_compact(F.array(F.when(failed, F.lit("provider_error")), F.when(F.col("__object").isNull(), F.lit("parse_error")), F.when(F.size(problems(F.col("__p"))) > 0, F.lit("schema_error"))))
    return a.select(
        "doc_id", "model_alias", F.lit(run_id).alias("run_id"), F.to_json("__p", {"ignoreNullFields": "false"}).alias("fields_payload"), F.col("__p.confidence").alias("confidence"),
        F.col("__p.evidence_spans").alias("evidence_spans"), "raw_response", "latency_ms", snapshot(F.col("__p")).alias("status_snapshot"), (F.size(kinds) == 0).alias("structured_valid"),
        F.concat(kinds, warnings(F.col("raw_response"), F.col("__p"))).alias("error_tags"), "error_message", problems(F.col("__p")).alias("schema_errors"),
        F.col("__p.maturity_level").alias("maturity_level"), F.col("__p.deployment_scope.status").alias("deployment_scope_status"), F.col("__p.deployment_scope.value").alias("deployment_scope_value"),
    )


def run_rules(dataset: DataFrame, run_id: str, alias: str = "rules") -> DataFrame:
    """The rule model over a dataset, without leaving the engine: the deterministic test run."""
    answers = dataset.select("doc_id", F.lit(alias).alias("model_alias"), rule_answer(F.col("text")).alias("raw_response"), F.lit(5).cast("bigint").alias("latency_ms"), F.lit(None).cast("string").alias("error_message"))
    return predictions_of(answers, run_id)


ANSWER = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("model_alias", T.StringType()), T.StructField("raw_response", T.StringType()), T.StructField("latency_ms", T.LongType()), T.StructField("error_message", T.StringType())])


def rejected_appends(rows: DataFrame) -> DataFrame:
    """(doc_id, reason) of annotator rows (doc_id, payload as JSON text) that a strict append refuses:
    no id, unreadable payload, a missing field, a bad status, level or confidence."""
    from lexmill.functions.payload import FIELDS, STATUSES

    v = F.try_parse_json("payload")
    has = lambda p, t: F.try_variant_get(v, p, t)
    missing = [F.when(has(f"$.{f}", "variant").isNull(), F.lit(f"missing:{f}")) for f in (*FIELDS, "maturity_level", "maturity_rationale", "confidence", "evidence_spans")]
    status = [F.when(~F.coalesce(has(f"$.{f}.status", "string"), F.lit("")).isin(*STATUSES), F.lit(f"bad_status:{f}")) for f in FIELDS]
    level, sure = has("$.maturity_level", "int"), has("$.confidence", "double")
    reason = F.coalesce(
        F.when(F.coalesce(F.trim("doc_id"), F.lit("")) == "", F.lit("no_doc_id")), F.when(v.isNull(), F.lit("bad_json")), *missing, *status,
        F.when(level.isNull() | (level < 0) | (level > 4), F.lit("bad_level")), F.when(sure.isNull() | (sure < 0) | (sure > 1), F.lit("bad_confidence")),
    )
    return rows.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())
