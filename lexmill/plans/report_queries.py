"""Queries of the reporting layer and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.payload import FIELDS
from lexmill.functions.text import RE2_SPACE
from lexmill.operators import reports as R
from lexmill.operators.evaluate import latest
from lexmill.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def _p(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "predictions")


def _last(spark: SparkSession, root: str) -> DataFrame:
    return latest(_p(spark, root))


def _base(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "dataset_base")


def _joined(spark: SparkSession, root: str) -> DataFrame:
    return R.with_documents(_last(spark, root), _base(spark, root))


def _long(spark: SparkSession, root: str) -> DataFrame:
    return R.signals(_last(spark, root))


MODELS = ["fenn_14b", "fenn_32b", "corda_8b"]

QUERIES: dict[str, Query] = {
    "q_run_summary": lambda s, d: R.run_summary(_p(s, d)),
    "q_tag_histogram": lambda s, d: R.tag_histogram(_p(s, d)),
    "q_maturity_distribution": lambda s, d: R.maturity_distribution(_last(s, d)),
    "q_agreement_pairs": lambda s, d: R.agreement(_last(s, d)),
    "q_agreement_avg": lambda s, d: R.average_agreement(_last(s, d)),
    "q_big_disagree": lambda s, d: R.large_disagreements(_last(s, d)),
    "q_unanimous": lambda s, d: R.unanimity(_last(s, d)),
    "q_majority": lambda s, d: R.majority(_last(s, d)),
    "q_issue_table": lambda s, d: R.issue_table(_p(s, d)),
    "q_conf_hist": lambda s, d: R.confidence_histogram(_last(s, d)),
    "q_conf_stats": lambda s, d: R.confidence_stats(_last(s, d)),
    "q_fill_rate": lambda s, d: R.fill_rate(_long(s, d)),
    "q_mean_fill": lambda s, d: R.mean_fill(_long(s, d)),
    "q_span_depth": lambda s, d: R.span_depth(_last(s, d)),
    "q_items_avg": lambda s, d: R.items_per_present(_long(s, d)),
    "q_throughput": lambda s, d: R.throughput(_p(s, d)),
    "q_scaling_delta": lambda s, d: R.scaling(_p(s, d)),
    "q_drift": lambda s, d: R.drift(_last(s, d), read(s, d, "golden")),
    "q_composition": lambda s, d: R.composition(_base(s, d)),
    "q_year_composition": lambda s, d: R.year_composition(_base(s, d)),
    "q_company_top": lambda s, d: R.top_companies(_base(s, d)),
    "q_industry_maturity": lambda s, d: R.industry_maturity(_joined(s, d)),
    "q_company_maturity": lambda s, d: R.company_maturity(_joined(s, d)),
    "q_year_trend": lambda s, d: R.year_trend(_joined(s, d)),
    "q_coverage": lambda s, d: R.coverage_by_industry(_long(s, d), _base(s, d)),
    "q_topk_terms": lambda s, d: R.top_terms(_long(s, d), _base(s, d)),
    "q_term_reach": lambda s, d: R.term_reach(R.top_terms(_long(s, d), _base(s, d))),
    "q_robustness_pivot": lambda s, d: R.robustness(_joined(s, d), MODELS),
    "q_by_run": lambda s, d: R.by_run(_p(s, d)),
    "q_prompt_flips": lambda s, d: R.flips(_p(s, d)),
    "q_fill_by_run": lambda s, d: R.fill_by_run(_p(s, d)),
    "q_metric_ranks": lambda s, d: R.metric_ranks(_p(s, d)),
    "q_tokens_fill": lambda s, d: R.tokens_against_fill(_last(s, d)),
    "q_running": lambda s, d: R.running_distribution(_last(s, d)),
    "q_batch_delta": lambda s, d: R.batch_delta(_p(s, d)),
    "q_grounding": lambda s, d: R.grounding(_last(s, d), _base(s, d)),
    "q_qa_trigger": lambda s, d: R.qa_trigger(read(s, d, "golden"), _last(s, d)),
}

LAST = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_alias ORDER BY prediction_id DESC) AS rn FROM predictions) WHERE rn = 1)"
_STRIP = lambda c: rf"regexp_replace(coalesce({c}, ''), '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"
YEAR = f"regexp_replace({_STRIP('year')}, '\\.0$', '')"
BUCKET = "CASE WHEN y = '' THEN 'unknown' WHEN y IN ('2017', '2018', '2019') THEN '2017-2019' ELSE y END"
DOCS = f"d AS (SELECT doc_id, {_STRIP('company')} AS company, {_STRIP('industry')} AS industry, {YEAR} AS y FROM dataset_base)"
_FIELDS = ", ".join(f"('{f}')" for f in FIELDS)
LONG = f"""l AS (
  SELECT doc_id, model_alias, run_id, f.field, json_extract_string(fields_payload, '$.' || f.field || '.status') AS status,
         CASE WHEN f.field = 'deployment_scope' THEN [x for x in [json_extract_string(fields_payload, '$.deployment_scope.value')] if x <> '']
              ELSE CAST(json_extract(fields_payload, '$.' || f.field || '.items') AS VARCHAR[]) END AS items
  FROM {{src}}, (VALUES {_FIELDS}) f(field))"""
_TOK = lambda k: f"CAST(sum(coalesce(token_usage['{k}'], 0)) AS BIGINT)"
_LV = lambda c="maturity_level": ", ".join(f"count(*) FILTER ({c} = {k}) AS level_{k}" for k in R.LEVELS)
_MAT = f"""count(*) AS n, round(avg(maturity_level), 4) AS avg_level, round(count(*) FILTER (maturity_level >= 2) / count(*), 4) AS share_2_up,
       round(count(*) FILTER (maturity_level = 3) / count(*), 4) AS share_3, {_LV()}"""
PAIRS = "x AS (SELECT u.doc_id, u.model_alias AS a, v.model_alias AS b, u.maturity_level AS la, v.maturity_level AS lb FROM p u JOIN p v ON u.doc_id = v.doc_id AND u.model_alias < v.model_alias)"
_CB = "CASE " + " ".join(f"WHEN coalesce(confidence, 0) <= {t} THEN '{n}'" for t, n in R.CONFIDENCE) + " END"
_TERMS = f"""WITH {LAST}, {LONG.format(src='p')}, {DOCS},
t AS (SELECT industry, lower({_STRIP('it')}) AS term FROM (SELECT industry, unnest(items) AS it FROM l JOIN d USING (doc_id) WHERE field = 'ai_use_cases' AND status = 'present')),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY industry ORDER BY n DESC, term) AS INTEGER) AS rank FROM (SELECT industry, term, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2)),
top AS (SELECT * FROM k WHERE rank <= 10)"""

ORACLE = {
    "q_run_summary": f"""
SELECT model_alias, count(*) AS rows, count(*) FILTER (structured_valid) AS valid_rows, round(count(*) FILTER (structured_valid) / count(*), 4) AS valid_rate,
       count(*) FILTER (list_contains(error_tags, 'provider_error')) AS provider_errors, count(*) FILTER (list_contains(error_tags, 'parse_error')) AS parse_errors,
       count(*) FILTER (list_contains(error_tags, 'schema_error')) AS schema_errors, round(sum(coalesce(latency_ms, 0)) / count(*), 2) AS avg_latency_ms,
       round(sum(coalesce(latency_ms, 0)) / 3.6e6, 4) AS hours, {_TOK('prompt_tokens')} AS prompt_tokens, {_TOK('completion_tokens')} AS completion_tokens,
       {_TOK('total_tokens')} AS total_tokens, round({_TOK('completion_tokens')} / count(*), 2) AS avg_completion_tokens,
       round({_TOK('completion_tokens')} / greatest(sum(coalesce(latency_ms, 0)) / 1000.0, 0.001), 2) AS tokens_per_second
FROM predictions GROUP BY 1""",
    "q_tag_histogram": "SELECT model_alias, tag, count(*) AS n FROM (SELECT model_alias, unnest(error_tags) AS tag FROM predictions) GROUP BY 1, 2",
    "q_maturity_distribution": f"WITH {LAST} SELECT model_alias, count(*) AS n, {_LV()}, round(avg(maturity_level), 4) AS avg_level, round(count(*) FILTER (maturity_level >= 2) / count(*), 4) AS share_2_up FROM p GROUP BY 1",
    "q_agreement_pairs": f"""WITH {LAST}, {PAIRS}
SELECT a, b, count(*) AS common, count(*) FILTER (la = lb) AS equal, round(count(*) FILTER (la = lb) / count(*), 4) AS rate,
       round(count(*) FILTER (abs(la - lb) <= 1) / count(*), 4) AS within_1, round(avg(lb - la), 4) AS mean_difference FROM x GROUP BY 1, 2""",
    "q_agreement_avg": f"""WITH {LAST}, {PAIRS}, r AS (SELECT a, b, avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS r FROM x GROUP BY 1, 2)
SELECT model_alias, round(avg(r), 4) AS avg_rate, count(*) AS others FROM (SELECT a AS model_alias, r FROM r UNION ALL SELECT b, r FROM r) GROUP BY 1""",
    "q_big_disagree": f"WITH {LAST}, {PAIRS} SELECT doc_id, a, b, la AS level_a, lb AS level_b FROM x WHERE abs(la - lb) >= 2",
    "q_unanimous": f"""WITH {LAST}, m AS (SELECT doc_id, min(maturity_level) AS lo, max(maturity_level) AS hi FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT CASE WHEN lo = hi THEN 'unanimous' ELSE 'disputed' END AS kind, CASE WHEN lo = hi THEN lo ELSE -1 END AS level, count(*) AS n FROM m GROUP BY 1, 2""",
    "q_majority": f"""WITH {LAST}, c AS (SELECT doc_id, maturity_level AS level, count(*) AS votes FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, level) AS rn, CAST(sum(votes) OVER (PARTITION BY doc_id) AS BIGINT) AS models FROM c)
SELECT doc_id, level, votes, models FROM r WHERE rn = 1""",
    "q_issue_table": """WITH c AS (SELECT model_alias, count(*) AS n, count(*) FILTER (list_contains(error_tags, 'parse_error')) AS parse_error,
  count(*) FILTER (list_contains(error_tags, 'wrong_field_names_detected')) AS wrong_fields, count(*) FILTER (list_contains(error_tags, 'evidence_spans_alias_used')) AS alias_used FROM predictions GROUP BY 1)
SELECT model_alias, parse_error, wrong_fields, alias_used, parse_error + wrong_fields + alias_used AS total, round((parse_error + wrong_fields + alias_used) / n, 4) AS share FROM c""",
    "q_conf_hist": f"""WITH {LAST}, c AS (SELECT model_alias, {_CB} AS bucket, count(*) AS n FROM p GROUP BY 1, 2)
SELECT model_alias, bucket, n, round(n / sum(n) OVER (PARTITION BY model_alias), 4) AS share FROM c""",
    "q_conf_stats": f"WITH {LAST} SELECT model_alias, round(avg(coalesce(confidence, 0)), 4) AS avg_confidence, max(coalesce(confidence, 0)) AS max_confidence, min(coalesce(confidence, 0)) AS min_confidence FROM p GROUP BY 1",
    "q_fill_rate": f"WITH {LAST}, {LONG.format(src='p')} SELECT model_alias, field, count(*) FILTER (status = 'present') AS present, count(*) AS n, round(count(*) FILTER (status = 'present') / count(*), 4) AS rate FROM l GROUP BY 1, 2",
    "q_mean_fill": f"""WITH {LAST}, {LONG.format(src='p')}, r AS (SELECT model_alias, field, avg(CASE WHEN status = 'present' THEN 1.0 ELSE 0.0 END) AS r FROM l GROUP BY 1, 2)
SELECT model_alias, round(avg(r), 4) AS mean_fill FROM r GROUP BY 1""",
    "q_span_depth": f"""WITH {LAST}, k AS (SELECT *, coalesce(len(evidence_spans), 0) AS k FROM p)
SELECT model_alias, count(*) FILTER (k > 0) AS docs_with_spans, round(count(*) FILTER (k > 0) / count(*), 4) AS coverage, round(coalesce(avg(k) FILTER (k > 0), 0), 4) AS avg_spans,
       coalesce(quantile_cont(k, 0.5) FILTER (k > 0), 0.0) AS median_spans, CAST(coalesce(max(k) FILTER (k > 0), 0) AS INTEGER) AS max_spans, CAST(sum(k) AS BIGINT) AS total_spans,
       count(*) FILTER (k = 0 AND list_contains(map_values(status_snapshot), 'present')) AS empty_despite_signals FROM k GROUP BY 1""",
    "q_items_avg": f"WITH {LAST}, {LONG.format(src='p')} SELECT model_alias, field, round(avg(len(items)), 4) AS avg_items, count(*) AS n FROM l WHERE status = 'present' AND field <> 'deployment_scope' GROUP BY 1, 2",
    "q_throughput": """WITH c AS (SELECT model_alias, avg(latency_ms) AS ms, sum(latency_ms) AS s FROM predictions GROUP BY 1)
SELECT model_alias, round(ms, 2) AS avg_latency_ms, round(s / 3.6e6, 4) AS hours, CAST(rank() OVER (ORDER BY ms) AS INTEGER) AS rank, round(ms / min(ms) OVER (), 4) AS slowdown FROM c""",
    "q_scaling_delta": """WITH c AS (SELECT regexp_extract(model_alias, '^(.*)_(\\d+)b$', 1) AS family, CAST(regexp_extract(model_alias, '^(.*)_(\\d+)b$', 2) AS INTEGER) AS size, avg(latency_ms) AS ms,
  avg(CASE WHEN structured_valid THEN 1.0 ELSE 0.0 END) AS v FROM predictions GROUP BY 1, 2),
r AS (SELECT family, size, round(ms / lag(ms) OVER w - 1, 4) AS latency_change, round(v - lag(v) OVER w, 4) AS valid_change FROM c WINDOW w AS (PARTITION BY family ORDER BY size))
SELECT * FROM r WHERE latency_change IS NOT NULL""",
    "q_drift": f"""WITH {LAST}, g AS (SELECT DISTINCT doc_id, 1 AS s FROM golden), j AS (SELECT model_alias, s, CASE WHEN maturity_level >= 2 THEN 1.0 ELSE 0.0 END AS up FROM p LEFT JOIN g USING (doc_id))
SELECT model_alias, round(avg(up), 4) AS all_share, round(avg(up) FILTER (s = 1), 4) AS subset_share, round(100 * (avg(up) FILTER (s = 1) - avg(up)), 4) AS delta_pp FROM j GROUP BY 1""",
    "q_composition": f"WITH {DOCS}, c AS (SELECT industry, count(*) AS n FROM d GROUP BY 1) SELECT industry, n, round(n / sum(n) OVER (), 4) AS share FROM c",
    "q_year_composition": f"WITH {DOCS} SELECT {BUCKET} AS bucket, count(*) AS n FROM d GROUP BY 1",
    "q_company_top": f"WITH {DOCS} SELECT company, count(*) AS n FROM d WHERE company <> '' GROUP BY 1 ORDER BY n DESC, company LIMIT 20",
    "q_industry_maturity": f"WITH {LAST}, {DOCS} SELECT industry, {_MAT} FROM p JOIN d USING (doc_id) WHERE structured_valid GROUP BY 1",
    "q_company_maturity": f"""WITH {LAST}, {DOCS}, c AS (SELECT company, {_MAT} FROM p JOIN d USING (doc_id) WHERE structured_valid AND company <> '' GROUP BY 1 HAVING count(*) >= 5)
SELECT company, n, avg_level, share_2_up, level_3, CAST(row_number() OVER (ORDER BY avg_level DESC, n DESC, company) AS INTEGER) AS rank FROM c""",
    "q_year_trend": f"WITH {LAST}, {DOCS} SELECT {BUCKET} AS bucket, {_MAT} FROM p JOIN d USING (doc_id) WHERE structured_valid GROUP BY 1",
    "q_coverage": f"WITH {LAST}, {LONG.format(src='p')}, {DOCS} SELECT industry, " + ", ".join(f"round(avg(CASE WHEN status = 'present' THEN 1.0 ELSE 0.0 END) FILTER (field = '{f}'), 4) AS {f}" for f in FIELDS) + " FROM l JOIN d USING (doc_id) GROUP BY 1",
    "q_topk_terms": _TERMS + " SELECT industry, term, n, rank FROM top",
    "q_term_reach": _TERMS + " SELECT term, count(DISTINCT industry) AS industries, CAST(sum(n) AS BIGINT) AS n FROM top GROUP BY 1",
    "q_robustness_pivot": f"WITH {LAST}, {DOCS}, c AS (SELECT industry, " + ", ".join(f"avg(maturity_level) FILTER (model_alias = '{m}') AS {m}" for m in MODELS)
    + " FROM p JOIN d USING (doc_id) WHERE structured_valid AND model_alias IN (" + ", ".join(f"'{m}'" for m in MODELS) + ") GROUP BY 1) SELECT industry, "
    + ", ".join(f"round({m}, 4) AS avg_{m}, CAST(row_number() OVER (ORDER BY {m} DESC NULLS LAST, industry) AS INTEGER) AS rank_{m}" for m in MODELS)
    + ", " + ", ".join(f"round({m} - {MODELS[0]}, 4) AS delta_{m}, CASE WHEN {MODELS[0]} <> 0 THEN round({m} / {MODELS[0]}, 4) END AS ratio_{m}" for m in MODELS[1:]) + " FROM c",
    "q_by_run": f"""SELECT run_id, model_alias, count(*) AS n, round(avg(maturity_level), 4) AS avg_level, {_LV()}, count(*) FILTER (list_contains(error_tags, 'parse_error')) AS parse_errors,
  count(*) FILTER (list_contains(error_tags, 'wrong_field_names_detected')) AS wrong_fields, count(*) FILTER (list_contains(error_tags, 'evidence_spans_empty_despite_signals')) AS empty_spans,
  round(count(*) FILTER (structured_valid) / count(*), 4) AS valid_rate FROM predictions GROUP BY 1, 2""",
    "q_prompt_flips": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_alias, run_id ORDER BY prediction_id DESC) AS rn FROM predictions) WHERE rn = 1)
SELECT u.run_id AS run_a, v.run_id AS run_b, u.model_alias, count(*) AS common, count(*) FILTER (u.maturity_level <> v.maturity_level) AS changed, count(*) FILTER (v.maturity_level > u.maturity_level) AS up,
  count(*) FILTER (v.maturity_level < u.maturity_level) AS down, count(*) FILTER (v.maturity_level = u.maturity_level) AS unchanged
FROM o u JOIN o v ON u.doc_id = v.doc_id AND u.model_alias = v.model_alias AND u.run_id < v.run_id GROUP BY 1, 2, 3""",
    "q_fill_by_run": f"WITH {LONG.format(src='predictions')} SELECT run_id, field, round(avg(CASE WHEN status = 'present' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM l GROUP BY 1, 2",
    "q_metric_ranks": """WITH c AS (SELECT model_alias, avg(CASE WHEN structured_valid THEN 1.0 ELSE 0.0 END) AS valid_rate, -avg(latency_ms) AS speed, avg(confidence) AS confidence,
  avg(CASE WHEN coalesce(len(evidence_spans), 0) > 0 THEN 1.0 ELSE 0.0 END) AS evidence FROM predictions GROUP BY 1),
m AS (SELECT model_alias, 'valid_rate' AS metric, round(valid_rate, 4) AS value FROM c UNION ALL SELECT model_alias, 'speed', round(speed, 4) FROM c
  UNION ALL SELECT model_alias, 'confidence', round(confidence, 4) FROM c UNION ALL SELECT model_alias, 'evidence', round(evidence, 4) FROM c)
SELECT model_alias, metric, value, CAST(rank() OVER (PARTITION BY metric ORDER BY value DESC) AS INTEGER) AS rank FROM m""",
    "q_tokens_fill": f"""WITH {LAST} SELECT model_alias, round(corr(CAST(coalesce(token_usage['completion_tokens'], 0) AS DOUBLE), CAST(len(list_filter(map_values(status_snapshot), lambda s: s = 'present')) AS DOUBLE)), 4) AS r FROM p GROUP BY 1""",
    "q_running": f"""WITH {LAST}, w AS (SELECT model_alias, CAST(row_number() OVER o AS INTEGER) AS docs, """ + ", ".join(f"count(*) FILTER (maturity_level = {k}) OVER (PARTITION BY model_alias ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS level_{k}" for k in R.LEVELS)
    + " FROM p WINDOW o AS (PARTITION BY model_alias ORDER BY doc_id)) SELECT * FROM w WHERE docs % 10 = 0",
    "q_batch_delta": "WITH c AS (SELECT run_id, " + _LV() + ", avg(confidence) AS c FROM predictions GROUP BY 1), r AS (SELECT run_id, " + ", ".join(f"level_{k} - lag(level_{k}) OVER (ORDER BY run_id) AS level_{k}" for k in R.LEVELS)
    + ", round(c - lag(c) OVER (ORDER BY run_id), 4) AS confidence_delta FROM c) SELECT * FROM r WHERE confidence_delta IS NOT NULL",
    "q_grounding": f"""WITH {LAST}, s AS (SELECT doc_id, model_alias, unnest(evidence_spans) AS s FROM p)
SELECT model_alias, count(*) AS spans, count(*) FILTER (s.quote <> '' AND contains(text, s.quote)) AS verbatim, round(count(*) FILTER (s.quote <> '' AND contains(text, s.quote)) / count(*), 4) AS rate,
  count(*) FILTER (length(s.quote) > 100) AS long_quotes FROM s JOIN dataset_base USING (doc_id) GROUP BY 1""",
    "q_qa_trigger": f"""WITH {LAST}, c AS (SELECT doc_id, maturity_level AS level, count(*) AS votes FROM p GROUP BY 1, 2),
m AS (SELECT doc_id, level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, level) AS rn FROM c) WHERE rn = 1),
g AS (SELECT doc_id, guideline_version, coalesce(CAST(json_extract(gold_fields_payload, '$.maturity_level') AS INTEGER), 0) AS gl FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY guideline_version DESC NULLS LAST, gold_fields_payload DESC NULLS LAST) AS rn FROM golden WHERE qa_status = 'done') WHERE rn = 1)
SELECT guideline_version, count(*) AS n, count(*) FILTER (gl <> level) AS disagree, round(count(*) FILTER (gl <> level) / count(*), 4) AS rate, count(*) FILTER (gl <> level) / count(*) > 0.1 AS revise
FROM g JOIN m USING (doc_id) GROUP BY 1""",
}
