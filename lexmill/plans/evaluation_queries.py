"""Queries of payload handling, sampling, evaluation and the final dataset, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import metrics
from lexmill.functions.payload import LIST_FIELDS, normalize, problems, scan_object, stored, warnings
from lexmill.functions.text import RE2_SPACE
from lexmill.operators import evaluate as E
from lexmill.operators import sampling as S
from lexmill.plans.report_queries import LAST, LONG
from lexmill.runtime import read, spread

SPLIT, MODEL, SAMPLE, TRAIN, DEV = "test", "fenn_14b", 180, 120, 30


def q_payload_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Raw answers scanned, normalised and checked; no SQL, as the scanner is a decoder."""
    p = spread(read(spark, root, "predictions").select("prediction_id", "raw_response"))
    n = p.select("prediction_id", "raw_response", scan_object(F.col("raw_response")).alias("object")).withColumn("p", normalize(F.col("object")))
    return n.select(
        "prediction_id",
        F.col("object").isNotNull().alias("parsed"),
        F.col("p.maturity_level").alias("maturity_level"),
        F.col("p.confidence").alias("confidence"),
        F.size("p.evidence_spans").alias("spans"),
        F.col("p.deployment_scope.status").alias("deployment"),
        F.array_join(F.flatten(F.array(*[F.col(f"p.{f}.items") for f in LIST_FIELDS])), "; ").alias("items"),
        F.array_join(problems(F.col("p")), ",").alias("problems"),
        F.array_join(warnings(F.col("raw_response"), F.col("p")), ",").alias("warnings"),
    )


def q_warnings(spark: SparkSession, root: str) -> DataFrame:
    p = read(spark, root, "predictions").select("prediction_id", "raw_response", stored(F.col("fields_payload")).alias("p"))
    return p.select("prediction_id", F.array_join(warnings(F.col("raw_response"), F.col("p")), ",").alias("warnings"))


def q_signals(spark: SparkSession, root: str) -> DataFrame:
    from lexmill.operators.reports import signals

    long = signals(E.latest(read(spark, root, "predictions")))
    return long.select("doc_id", "model_alias", "field", "status", F.array_join("items", "; ").alias("items"))


def q_per_doc(spark: SparkSession, root: str) -> DataFrame:
    s = E.per_document(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT)
    numbers = [F.round(c, 4).alias(c) for c in ("status_accuracy", "deployment_exact", "span_overlap")]
    return s.select("doc_id", "model_alias", *numbers, "maturity_gold", "maturity_pred", "pred_structured_valid", F.array_join("error_tags", ",").alias("error_tags"))


def q_multilabel_f1(spark: SparkSession, root: str) -> DataFrame:
    return E.f1_by_model(E.per_document(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT))


def q_kappa(spark: SparkSession, root: str) -> DataFrame:
    s = E.per_document(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT)
    return s.groupBy("model_alias").agg(
        F.round(metrics.kappa(F.col("maturity_gold"), F.col("maturity_pred")), 4).alias("kappa"),
        F.round(F.avg((F.col("maturity_gold") == F.col("maturity_pred")).cast("double")), 4).alias("accuracy"),
    )


def q_leaderboard(spark: SparkSession, root: str) -> DataFrame:
    return E.leaderboard(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT)


def q_error_tags_topk(spark: SparkSession, root: str) -> DataFrame:
    return E.top_error_tags(E.per_document(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT))


def q_final_flat(spark: SparkSession, root: str) -> DataFrame:
    f = E.final_dataset(read(spark, root, "dataset_base"), read(spark, root, "predictions"), MODEL)
    return f.drop("text", "raw_response", "evidence_spans", "fields_payload", "text_path")


def q_resume(spark: SparkSession, root: str) -> DataFrame:
    done = read(spark, root, "predictions").where(F.col("model_alias") == MODEL).select("doc_id")
    return read(spark, root, "dataset_base").select("doc_id", "url_canonical").join(done, "doc_id", "left_anti")


def q_length_quartiles(spark: SparkSession, root: str) -> DataFrame:
    return S.length_bins(read(spark, root, "dataset_base").select("doc_id", "text_len")).select("doc_id", F.col("__bin").cast("int").alias("bin"))


def q_strata_alloc(spark: SparkSession, root: str) -> DataFrame:
    sizes = S.strata(read(spark, root, "dataset_base").select("doc_id", "industry", "year", "text_len")).groupBy("__stratum").agg(F.count(F.lit(1)).alias("size"))
    return S.allocate(sizes, SAMPLE).select(F.col("__stratum").alias("stratum"), "size", "n")


def _sample(spark: SparkSession, root: str) -> DataFrame:
    return S.stratified_sample(read(spark, root, "dataset_base").select("doc_id", "industry", "year", "text_len"), SAMPLE)


def q_strat_sample(spark: SparkSession, root: str) -> DataFrame:
    return _sample(spark, root).select("doc_id", F.col("__stratum").alias("stratum"))


def q_split(spark: SparkSession, root: str) -> DataFrame:
    return S.assign_splits(_sample(spark, root), TRAIN, DEV).select("doc_id", "split")


def q_golden_scaffold(spark: SparkSession, root: str) -> DataFrame:
    g = S.golden_scaffold(S.assign_splits(_sample(spark, root), TRAIN, DEV))
    return g.groupBy("split", "annotator_id", "qa_status", "guideline_version").agg(F.count(F.lit(1)).alias("n"))


def q_qa_sample(spark: SparkSession, root: str) -> DataFrame:
    return S.qa_sample(_sample(spark, root)).select("doc_id")


QUERIES = {f.__name__: f for f in (
    q_payload_normalize, q_warnings, q_signals, q_per_doc, q_multilabel_f1, q_kappa, q_leaderboard, q_error_tags_topk, q_final_flat, q_resume,
    q_length_quartiles, q_strata_alloc, q_strat_sample, q_split, q_golden_scaffold, q_qa_sample,
)}

_STRIP = lambda c: rf"regexp_replace({c}, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"
_st = lambda j, f: f"coalesce(json_extract_string({j}, '$.{f}.status'), 'uncertain')"
_val = lambda j: f"coalesce(json_extract_string({j}, '$.deployment_scope.value'), '')"
_set = lambda j, f: f"list_distinct([y for y in [lower({_STRIP('x')}) for x in coalesce(CAST(json_extract({j}, '$.{f}.items') AS VARCHAR[]), [])] if y <> ''])"
_FIELDS = [*LIST_FIELDS, "deployment_scope"]
_SPANS = lambda j: f"coalesce(CAST(json_extract({j}, '$.evidence_spans') AS STRUCT(field VARCHAR, quote VARCHAR, start_char INTEGER, end_char INTEGER)[]), [])"
SCORED = f"""{LAST},
g AS (SELECT doc_id, max(gold_fields_payload) AS gj FROM golden WHERE lower(trim(split)) = '{SPLIT}' GROUP BY 1),
m AS (SELECT DISTINCT model_alias FROM predictions),
j AS (SELECT g.doc_id, m.model_alias, gj, fields_payload AS pj, coalesce(structured_valid, false) AS pred_structured_valid, CASE WHEN p.doc_id IS NULL THEN ['missing_prediction'] ELSE error_tags END AS tags,
             coalesce(CAST(json_extract(gj, '$.maturity_level') AS INTEGER), 0) AS maturity_gold, coalesce(CAST(json_extract(fields_payload, '$.maturity_level') AS INTEGER), 0) AS maturity_pred
      FROM g CROSS JOIN m LEFT JOIN p ON p.doc_id = g.doc_id AND p.model_alias = m.model_alias),
sp AS (SELECT doc_id, model_alias, {_SPANS('gj')} AS gs, {_SPANS('pj')} AS ps FROM j),
gx AS (SELECT doc_id, model_alias, i, gs[i] AS g, ps FROM (SELECT doc_id, model_alias, gs, ps, unnest(range(1, len(gs) + 1)) AS i FROM sp)),
px AS (SELECT doc_id, model_alias, i, g, unnest(ps) AS q FROM gx),
ov AS (SELECT doc_id, model_alias, i, CASE
         WHEN g.start_char IS NOT NULL AND g.end_char IS NOT NULL AND q.start_char IS NOT NULL AND q.end_char IS NOT NULL THEN
           CASE WHEN least(g.end_char, q.end_char) - greatest(g.start_char, q.start_char) <= 0 THEN 0.0
                ELSE (least(g.end_char, q.end_char) - greatest(g.start_char, q.start_char)) / CAST(greatest(g.end_char, q.end_char) - least(g.start_char, q.start_char) AS DOUBLE) END
         WHEN lower({_STRIP("coalesce(g.quote, '')")}) = lower({_STRIP("coalesce(q.quote, '')")}) THEN 1.0
         WHEN {_STRIP("coalesce(g.quote, '')")} = '' OR {_STRIP("coalesce(q.quote, '')")} = '' THEN 0.0
         WHEN contains(lower({_STRIP("coalesce(g.quote, '')")}), lower({_STRIP("coalesce(q.quote, '')")})) OR contains(lower({_STRIP("coalesce(q.quote, '')")}), lower({_STRIP("coalesce(g.quote, '')")})) THEN 0.75
         ELSE len(list_intersect(list_distinct(string_split_regex(lower({_STRIP('g.quote')}), '[{RE2_SPACE}]+')), list_distinct(string_split_regex(lower({_STRIP('q.quote')}), '[{RE2_SPACE}]+'))))
              / CAST(len(list_distinct(list_concat(string_split_regex(lower({_STRIP('g.quote')}), '[{RE2_SPACE}]+'), string_split_regex(lower({_STRIP('q.quote')}), '[{RE2_SPACE}]+')))) AS DOUBLE) END AS score
       FROM px WHERE {_STRIP("coalesce(g.field, '')")} = {_STRIP("coalesce(q.field, '')")} OR {_STRIP("coalesce(g.field, '')")} = '' OR {_STRIP("coalesce(q.field, '')")} = ''),
bs AS (SELECT doc_id, model_alias, sum(b) AS total FROM (SELECT doc_id, model_alias, i, max(score) AS b FROM ov GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT j.*, ({' + '.join(f"CASE WHEN {_st('gj', f)} = {_st('pj', f)} THEN 1 ELSE 0 END" for f in _FIELDS)}) / 9.0 AS status_accuracy,
        CASE WHEN {_st('gj', 'deployment_scope')} <> {_st('pj', 'deployment_scope')} THEN 0.0 WHEN {_st('gj', 'deployment_scope')} <> 'present' THEN 1.0
             WHEN lower({_STRIP(_val('gj'))}) = lower({_STRIP(_val('pj'))}) THEN 1.0 ELSE 0.0 END AS deployment_exact,
        CASE WHEN len(gs) = 0 AND len(ps) = 0 THEN 1.0 WHEN len(gs) = 0 OR len(ps) = 0 THEN 0.0 ELSE coalesce(bs.total, 0.0) / len(gs) END AS span_overlap
      FROM j JOIN sp USING (doc_id, model_alias) LEFT JOIN bs USING (doc_id, model_alias)),
t AS (SELECT *, list_concat(tags, [x for x in [CASE WHEN status_accuracy < 1 THEN 'status_mismatch' END, CASE WHEN deployment_exact < 1 THEN 'deployment_scope_mismatch' END,
        CASE WHEN maturity_gold <> maturity_pred THEN 'maturity_mismatch' END, CASE WHEN span_overlap < 0.5 THEN 'weak_evidence' END] if x IS NOT NULL]) AS error_tags FROM s),
c AS (SELECT model_alias, {', '.join(f"sum(len(list_intersect({_set('gj', f)}, {_set('pj', f)}))) AS tp_{f}, sum(len({_set('pj', f)})) AS np_{f}, sum(len({_set('gj', f)})) AS ng_{f}" for f in LIST_FIELDS)} FROM j GROUP BY 1),
f AS (SELECT model_alias,
        round(CASE WHEN ({' + '.join(f'np_{f} + ng_{f}' for f in LIST_FIELDS)}) = 0 THEN 0.0 ELSE 2.0 * ({' + '.join(f'tp_{f}' for f in LIST_FIELDS)}) / ({' + '.join(f'np_{f} + ng_{f}' for f in LIST_FIELDS)}) END, 4) AS micro_f1,
        round(({' + '.join(f'CASE WHEN np_{f} + ng_{f} = 0 THEN 0.0 ELSE 2.0 * tp_{f} / (np_{f} + ng_{f}) END' for f in LIST_FIELDS)}) / 8.0, 4) AS macro_f1 FROM c),
k AS (SELECT model_alias, avg((maturity_gold - maturity_pred) ** 2) AS o, avg(maturity_gold ** 2) + avg(maturity_pred ** 2) - 2 * avg(maturity_gold) * avg(maturity_pred) AS e FROM s GROUP BY 1),
kk AS (SELECT model_alias, CASE WHEN abs(e) < 1e-12 THEN 1.0 ELSE 1 - o / e END AS kappa FROM k)"""
_STRATA = r"""
e AS (SELECT list_distinct(quantile_cont(text_len, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM dataset_base),
b AS (SELECT doc_id, industry, year, least(coalesce(len([x for x in list_sort(e)[2:] if x < text_len]), 0), greatest(len(e) - 2, 0)) AS bin FROM dataset_base, e),
st AS (SELECT doc_id, coalesce(industry, '') || '__' || coalesce(year, '') || '__len' || CAST(bin AS VARCHAR) AS stratum FROM b)"""


def _alloc(source: str, target: int, name: str) -> str:
    """CTEs that divide ``target`` over the strata of ``source``; the result is ``name``."""
    return f"""
{name}_z AS (SELECT stratum, count(*) AS size FROM {source} GROUP BY 1),
{name}_q AS (SELECT stratum, size, size / sum(size) OVER () * {target}.0 AS exact FROM {name}_z),
{name}_f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base, size > floor(exact) AS room FROM {name}_q),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY room DESC, exact - base DESC, stratum) AS rk, {target} - sum(base) OVER () AS rest FROM {name}_f),
{name} AS (SELECT stratum, size, base + CASE WHEN room AND rk <= rest THEN 1 ELSE 0 END AS n FROM {name}_r)"""


_SAMPLE = f"""{_STRATA}, {_alloc('st', SAMPLE, 'al')},
sm AS (SELECT doc_id, stratum FROM (SELECT st.*, al.n, row_number() OVER (PARTITION BY stratum ORDER BY sha1(doc_id || ':42'), doc_id) AS rn FROM st JOIN al USING (stratum)) WHERE rn <= n)"""
_SPLIT = f"""{_SAMPLE}, {_alloc('sm', TRAIN, 'ta')},
tr AS (SELECT doc_id, stratum, rn <= n AS train FROM (SELECT sm.*, ta.n, row_number() OVER (PARTITION BY stratum ORDER BY sha1(doc_id || ':42'), doc_id) AS rn FROM sm JOIN ta USING (stratum))),
re AS (SELECT doc_id, stratum FROM tr WHERE NOT train), {_alloc('re', DEV, 'da')},
dv AS (SELECT doc_id, rn <= n AS dev FROM (SELECT re.*, da.n, row_number() OVER (PARTITION BY stratum ORDER BY sha1(doc_id || ':42'), doc_id) AS rn FROM re JOIN da USING (stratum))),
sl AS (SELECT doc_id, 'train' AS split FROM tr WHERE train UNION ALL SELECT doc_id, CASE WHEN dev THEN 'dev' ELSE 'test' END FROM dv)"""
_alias = " OR ".join(f"contains(r, '\"{k}\":')" for k in ("text", "start", "end", "excerpt"))
_canon = " OR ".join(f"contains(r, '\"{k}\":')" for k in ("quote", "start_char", "end_char"))
_wrong = " OR ".join(f"contains(lower(r), '\"{k}\"')" for k in ("use_cases", "stack", "usecases", "kpis", "risks"))
_sig = " OR ".join(f"({_st('fields_payload', f)} = 'present' AND len(coalesce(CAST(json_extract(fields_payload, '$.{f}.items') AS VARCHAR[]), [])) > 0)" for f in LIST_FIELDS)
ORACLE = {
    "q_warnings": f"""WITH w AS (SELECT *, coalesce(raw_response, '') AS r FROM predictions)
SELECT prediction_id, array_to_string([x for x in [CASE WHEN contains(r, '<think>') OR contains(r, '</think>') THEN 'qwen3_thinking_present' END,
  CASE WHEN ({_alias}) AND NOT ({_canon}) THEN 'evidence_spans_alias_used' END,
  CASE WHEN ({_sig}) AND len({_SPANS('fields_payload')}) = 0 THEN 'evidence_spans_empty_despite_signals' END,
  CASE WHEN CAST(json_extract(fields_payload, '$.maturity_level') AS INTEGER) > 0 AND json_extract_string(fields_payload, '$.maturity_rationale') = '' THEN 'maturity_rationale_empty' END,
  CASE WHEN {_wrong} THEN 'wrong_field_names_detected' END] if x IS NOT NULL], ',') AS warnings FROM w""",
    "q_signals": f"WITH {LAST}, {LONG.format(src='p')} SELECT doc_id, model_alias, field, status, array_to_string(items, '; ') AS items FROM l",
    "q_per_doc": f"""WITH {SCORED} SELECT doc_id, model_alias, round(status_accuracy, 4) AS status_accuracy, round(deployment_exact, 4) AS deployment_exact, round(span_overlap, 4) AS span_overlap,
  maturity_gold, maturity_pred, pred_structured_valid, array_to_string(error_tags, ',') AS error_tags FROM t""",
    "q_multilabel_f1": f"WITH {SCORED} SELECT * FROM f",
    "q_kappa": f"WITH {SCORED} SELECT model_alias, round(kappa, 4) AS kappa, round(avg(CASE WHEN maturity_gold = maturity_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM s JOIN kk USING (model_alias) GROUP BY model_alias, kappa",
    "q_leaderboard": f"""WITH {SCORED}, a AS (SELECT model_alias, count(*) AS docs, avg(CASE WHEN pred_structured_valid THEN 1.0 ELSE 0.0 END) AS v, avg(status_accuracy) AS sa, avg(deployment_exact) AS de,
  avg(CASE WHEN maturity_gold = maturity_pred THEN 1.0 ELSE 0.0 END) AS ma, avg(span_overlap) AS so FROM s GROUP BY 1),
b AS (SELECT *, 0.15 * sa + 0.10 * de + 0.30 * macro_f1 + 0.20 * ma + 0.15 * greatest(0.0, least(1.0, (kappa + 1) / 2)) + 0.10 * so AS strict FROM a JOIN f USING (model_alias) JOIN kk USING (model_alias))
SELECT model_alias, '{SPLIT}' AS split, docs, round(v, 4) AS structured_valid_rate, round(sa, 4) AS status_accuracy, round(de, 4) AS deployment_exact, micro_f1 AS multilabel_micro_f1, macro_f1 AS multilabel_macro_f1,
  round(ma, 4) AS maturity_accuracy, round(kappa, 4) AS maturity_kappa, round(so, 4) AS evidence_span_overlap, round(strict, 4) AS strict_score, 0.0::DOUBLE AS semantic_score, round(0.7 * strict, 4) AS final_score FROM b""",
    "q_error_tags_topk": f"""WITH {SCORED}, x AS (SELECT model_alias, unnest(error_tags) AS tag FROM t), y AS (SELECT model_alias, tag, count(*) AS n FROM x GROUP BY 1, 2),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY model_alias ORDER BY n DESC, tag) AS INTEGER) AS rank FROM y) SELECT * FROM z WHERE rank <= 10""",
    "q_final_flat": f"""WITH {LAST} SELECT d.doc_id, d.url_canonical, d.company, d.industry, d.year, d.title, d.word_count, d.text_len, p.model_alias, p.run_id, p.structured_valid,
  {_st('fields_payload', 'deployment_scope')} AS deployment_scope_status, {_val('fields_payload')} AS deployment_scope_value,
  {', '.join(f"{_st('fields_payload', f)} AS {f}_status, array_to_string(CAST(json_extract(fields_payload, '$.{f}.items') AS VARCHAR[]), '; ') AS {f}_items" for f in LIST_FIELDS)},
  CAST(json_extract(fields_payload, '$.maturity_level') AS INTEGER) AS maturity_level, json_extract_string(fields_payload, '$.maturity_rationale') AS maturity_rationale,
  CAST(json_extract(fields_payload, '$.confidence') AS DOUBLE) AS confidence FROM dataset_base d JOIN p USING (doc_id) WHERE p.model_alias = '{MODEL}'""",
    "q_resume": f"SELECT doc_id, url_canonical FROM dataset_base WHERE doc_id NOT IN (SELECT doc_id FROM predictions WHERE model_alias = '{MODEL}')",
    "q_length_quartiles": f"WITH {_STRATA.strip()} SELECT doc_id, CAST(bin AS INTEGER) AS bin FROM b",
    "q_strata_alloc": f"WITH {_STRATA.strip()}, {_alloc('st', SAMPLE, 'al')} SELECT stratum, size, n FROM al",
    "q_strat_sample": f"WITH {_SAMPLE.strip()} SELECT doc_id, stratum FROM sm",
    "q_split": f"WITH {_SPLIT.strip()} SELECT doc_id, split FROM sl",
    "q_golden_scaffold": f"WITH {_SPLIT.strip()} SELECT split, '' AS annotator_id, 'pending' AS qa_status, 'maturity_v1.0' AS guideline_version, count(*) AS n FROM sl GROUP BY 1",
    "q_qa_sample": f"WITH {_SAMPLE.strip()} SELECT doc_id FROM sm ORDER BY sha1(doc_id || ':42'), doc_id LIMIT 36",
}
