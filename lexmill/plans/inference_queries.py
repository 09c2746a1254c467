"""Queries of prompts, model runs, text stores and event windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import inference as I  # noqa: E741
from lexmill.runtime import read
from lexmill.sources.writers import text_store


def q_rules_run(spark: SparkSession, root: str) -> DataFrame:
    """The rule model over the document base: levels, scopes and validity per document."""
    run = I.run_rules(read(spark, root, "dataset_base").select("doc_id", "text"), "rules_run")
    return run.select("doc_id", "maturity_level", "deployment_scope_status", "deployment_scope_value", "confidence", "structured_valid")


def q_provider_map(spark: SparkSession, root: str) -> DataFrame:
    """The same documents through the provider seam, as any model would be called; no SQL."""
    docs = read(spark, root, "dataset_base").select("doc_id", "company", "industry", "year", "title", "text")
    todo = I.remaining(docs, ["echo"]).select("doc_id", "model_alias", I.prompt("v1").alias("prompt"))

    def echo(system: str, user: str, settings: dict) -> str:
        return '{"maturity_level": %d, "maturity_rationale": "length of the prompt", "confidence": 0.5}' % (len(user) % 5)

    answers = I.ask(todo, echo, I.load_settings(None)).withColumn("latency_ms", F.lit(0).cast("bigint"))
    run = I.predictions_of(answers, "provider_run")
    return run.select("doc_id", "model_alias", "maturity_level", "structured_valid", F.array_join("error_tags", ",").alias("error_tags"))


def q_prompt(spark: SparkSession, root: str) -> DataFrame:
    p = I.prompt("v1", 500)
    return read(spark, root, "dataset_base").select("doc_id", F.sha1(F.encode(p, "UTF-8")).alias("prompt_sha1"), F.length(p).alias("n"))


def q_prompt_full(spark: SparkSession, root: str) -> DataFrame:
    """The prompts as they are sent, with the operator's own text length; q_prompt takes 500 characters."""
    p = I.prompt("v1")
    return read(spark, root, "dataset_base").select("doc_id", F.sha1(F.encode(p, "UTF-8")).alias("prompt_sha1"), F.length(p).alias("n"))


def q_remaining(spark: SparkSession, root: str) -> DataFrame:
    """Documents and models still without a prediction, counted per model."""
    rest = I.remaining(read(spark, root, "dataset_base").select("doc_id"), ["fenn_14b", "fenn_32b"], read(spark, root, "predictions"))
    return rest.groupBy("model_alias").agg(F.count(F.lit(1)).alias("n"))


def q_text_store(spark: SparkSession, root: str) -> DataFrame:
    s = text_store(read(spark, root, "captures").withColumn("error", F.lit(None).cast("string")))
    return s.select("capture_id", "domain", "word_count", "text_len", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"))


def q_event_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events per type and hour, the batch form of the streaming aggregate."""
    e = read(spark, root, "events")
    return e.groupBy(F.date_format(F.col("ts"), "yyyy-MM-dd HH:00:00").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


QUERIES = {f.__name__: f for f in (q_rules_run, q_provider_map, q_prompt, q_prompt_full, q_remaining, q_text_store, q_event_windows)}

_any = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + ")"
_level = "1"
_scope = "'pilot'"
for _n, _words, _name in I.LEVEL_WORDS:
    _level = f"CASE WHEN {_any(_words)} THEN {_n} ELSE {_level} END"
    _scope = f"CASE WHEN {_any(_words)} THEN '{_name}' ELSE {_scope} END"
_intro = "Extract the listed fields from the article as one JSON object. Use present, absent or uncertain for each status and quote the evidence."
_prompt = (
    f"'{_intro}' || chr(10) || chr(10) || "
    + " || ".join(f"'{c}: ' || coalesce({c}, '') || chr(10)" for c in ("company", "industry", "year", "title"))
    + " || chr(10) || substr(coalesce(text, ''), 1, 500)"
)
_prompt_full = _prompt.replace(", 1, 500)", ", 1, 16000)")
ORACLE = {
    "q_rules_run": f"""SELECT doc_id, CASE WHEN {_any(I.AI_WORDS)} THEN {_level} ELSE 0 END AS maturity_level, CASE WHEN {_any(I.AI_WORDS)} THEN 'present' ELSE 'absent' END AS deployment_scope_status,
  CASE WHEN {_any(I.AI_WORDS)} THEN {_scope} ELSE '' END AS deployment_scope_value, CASE WHEN {_any(I.AI_WORDS)} THEN 0.78 ELSE 0.55 END::DOUBLE AS confidence, true AS structured_valid FROM dataset_base""",
    "q_prompt": f"SELECT doc_id, sha1({_prompt}) AS prompt_sha1, CAST(length({_prompt}) AS INTEGER) AS n FROM dataset_base",
    "q_prompt_full": f"SELECT doc_id, sha1({_prompt_full}) AS prompt_sha1, CAST(length({_prompt_full}) AS INTEGER) AS n FROM dataset_base",
    "q_remaining": """SELECT m AS model_alias, count(*) AS n FROM dataset_base d, (VALUES ('fenn_14b'), ('fenn_32b')) v(m)
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.doc_id = d.doc_id AND p.model_alias = m) GROUP BY 1""",
    "q_text_store": "SELECT capture_id, domain, word_count, text_len, sha1(text) AS text_sha1 FROM captures WHERE word_count >= 300 AND text_len >= 1000 AND text IS NOT NULL",
    "q_event_windows": "SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour, event_type, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2",
}
