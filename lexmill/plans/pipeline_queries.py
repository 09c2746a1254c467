"""Queries of pages, judges, run controls, stage reports, files and streams, and their SQL.

Queries of readers and sinks write a table to the shared folder and give what the reader makes of it,
so their SQL is the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import html
from lexmill.functions.payload import FIELDS, LIST_FIELDS, normalize, parse_error_payload, problems, scan_object, snapshot, stored
from lexmill.functions.text import RE2_SPACE, to_bool, to_count
from lexmill.operators import corpus
from lexmill.operators import evaluate as E
from lexmill.operators import inference as I  # noqa: E741
from lexmill.operators import sampling as S
from lexmill.plans import corpus_queries
from lexmill.plans.evaluation_queries import _SPLIT, _STRATA, DEV, SAMPLE, SCORED, SPLIT, TRAIN, _alloc
from lexmill.plans.report_queries import LAST
from lexmill.runtime import read, scratch, spread
from lexmill.sources import readers, writers
from lexmill.sources.xlsx import read_xlsx, write_xlsx
from lexmill.streaming import ingest

# pages


def _page(d: DataFrame) -> Column:
    """A page around a document: its title, a menu, the text as paragraphs, a footer."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(safe("text"), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    return F.concat(F.lit("<html><head><title>"), safe("title"), F.lit("</title><script>var a = '<p>';</script></head><body><nav>Menu</nav>\n<article>"), body, F.lit("</article><footer>End</footer></body></html>"))


def q_article_text(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "documents")
    return d.select("doc_id", F.sha1(F.encode(html.article_text(_page(d)), "UTF-8")).alias("text_sha1"), html.page_title(_page(d)).alias("title"))


def q_dom_text(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "documents")
    found = html.dom_text(_page(d))
    return d.select("doc_id", found["method"].alias("method"), F.length(found["text"]).alias("n"))


def q_fallback_text(spark: SparkSession, root: str) -> DataFrame:
    """Pages without an article element, as text of their body but what surrounds it."""
    d = read(spark, root, "documents")
    bare = F.regexp_replace(_page(d), "</?article>", "")
    return d.select("doc_id", F.sha1(F.encode(html.fallback_text(bare), "UTF-8")).alias("text_sha1"))


def q_json_html(spark: SparkSession, root: str) -> DataFrame:
    """The longest markup in a guarded JSON body, here of the page and its title."""
    d = spread(read(spark, root, "documents").select("doc_id", "title", "text"))
    page = _page(d)
    body = F.concat(F.lit(")]}',\n"), F.to_json(F.struct(F.col("title"), F.struct(F.array(page).alias("pages")).alias("payload"))))
    return d.select("doc_id", F.sha1(F.encode(html.json_html(body), "UTF-8")).alias("html_sha1"), F.startswith(html.strip_guard(body), F.lit("{")).alias("guard_gone"))


# payloads


def q_payload_wellformed(spark: SparkSession, root: str) -> DataFrame:
    """Answers that are one JSON object, scanned, normalised and checked."""
    p = spread(read(spark, root, "predictions").select("prediction_id", "raw_response"))
    plain = p.where(F.startswith("raw_response", F.lit("{")) & F.endswith("raw_response", F.lit("}")) & F.try_parse_json("raw_response").isNotNull())
    n = plain.select("prediction_id", normalize(scan_object(F.col("raw_response"))).alias("p"))
    return n.select(
        "prediction_id", F.col("p.maturity_level").alias("maturity_level"), F.col("p.maturity_rationale").alias("rationale"), F.col("p.confidence").alias("confidence"),
        F.size("p.evidence_spans").alias("spans"), F.array_join(F.transform("p.evidence_spans", lambda s: s["quote"]), "|").alias("quotes"),
        F.aggregate("p.evidence_spans", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s["start_char"], F.lit(-1)) + F.coalesce(s["end_char"], F.lit(-1))).alias("offsets"),
        F.concat_ws(",", *[F.col(f"p.{f}.status") for f in FIELDS]).alias("statuses"), F.col("p.deployment_scope.value").alias("scope"),
        F.concat_ws("|", *[F.array_join(F.col(f"p.{f}.items"), ";") for f in LIST_FIELDS]).alias("items"), F.size(problems(F.col("p"))).alias("problems"),
    )


def q_status_snapshot(spark: SparkSession, root: str) -> DataFrame:
    p = read(spark, root, "predictions").select("prediction_id", snapshot(stored(F.col("fields_payload"))).alias("s"))
    return p.select("prediction_id", F.explode("s").alias("field", "status"))


def q_rejected_appends(spark: SparkSession, root: str) -> DataFrame:
    """What a strict append refuses of the gold payloads, and of the same with one field broken."""
    g = read(spark, root, "golden").select("doc_id", F.col("gold_fields_payload").alias("payload"))
    broken = g.select("doc_id", F.replace("payload", F.lit('"status":'), F.lit('"state":')).alias("payload"))
    worse = g.select(F.lit(" ").alias("doc_id"), "payload")
    cut = g.select("doc_id", F.substring("payload", 1, 40).alias("payload"))
    rows = g.unionByName(broken).unionByName(worse).unionByName(cut)
    return I.rejected_appends(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_parse_error_rows(spark: SparkSession, root: str) -> DataFrame:
    p = read(spark, root, "predictions").where(F.array_contains("error_tags", "parse_error"))
    return p.select("prediction_id", F.to_json(parse_error_payload()).alias("payload"))


def q_loose_types(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "dataset_base").select("doc_id", to_count(F.col("year")).alias("year"), to_bool(F.col("text_len") % 2).alias("odd"), to_bool(F.col("company")).alias("company"))
    return d


# judges, boards, final


def _judged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    golden, predictions = read(spark, root, "golden"), read(spark, root, "predictions")
    scored = E.per_document(golden, predictions, SPLIT)
    texts = E.source_texts(golden, SPLIT)
    answers = scored.join(texts, "doc_id", "left").select("doc_id", "model_alias", E.rule_judge(F.col("text"), F.col("pred"), F.col("status_accuracy")).alias("raw_response"), F.lit(None).cast("string").alias("error_message"))
    return scored, E.judge_scores(answers)


def q_judge_scores(spark: SparkSession, root: str) -> DataFrame:
    _, judged = _judged(spark, root)
    return judged.select("doc_id", "model_alias", F.round("semantic_score", 4).alias("semantic_score"), "judge_error")


def q_leaderboard_judged(spark: SparkSession, root: str) -> DataFrame:
    _, judged = _judged(spark, root)
    return E.leaderboard(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT, judged=judged)


def q_board_lines(spark: SparkSession, root: str) -> DataFrame:
    return E.board_lines(E.leaderboard(read(spark, root, "golden"), read(spark, root, "predictions"), SPLIT))


def q_final_best(spark: SparkSession, root: str) -> DataFrame:
    """The final dataset of the model that leads the board."""
    golden, predictions = read(spark, root, "golden"), read(spark, root, "predictions")
    best = E.best_model(E.leaderboard(golden, predictions, SPLIT))
    return E.final_dataset(read(spark, root, "dataset_base"), predictions, best).select("doc_id", "model_alias", "run_id", "structured_valid", "maturity_level", "deployment_scope_status")


# runs


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """A list of ids as a run is given: the test split, backwards."""
    ids = read(spark, root, "golden").where(F.lower(F.trim("split")) == "test").select("doc_id").distinct()
    return ids.withColumn("position", -F.regexp_extract("doc_id", r"(\d+)", 1).cast("bigint"))


def q_ordered_docs(spark: SparkSession, root: str) -> DataFrame:
    docs = I.select_documents(read(spark, root, "dataset_base").select("doc_id", "title"), _listed(spark, root))
    return docs.select("doc_id", "title", "position")


def q_max_docs(spark: SparkSession, root: str) -> DataFrame:
    """The same with the optional bound on a run's documents, which is the feature."""
    return I.select_documents(read(spark, root, "dataset_base").select("doc_id", "title"), _listed(spark, root), 25).select("doc_id", "position")


def q_run_ids(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "captures")
    return c.select("capture_id", I.run_id("run", F.col("ingested_at")).alias("run_id"))


def q_inference_log(spark: SparkSession, root: str) -> DataFrame:
    return I.inference_log(read(spark, root, "predictions").drop("fields_payload", "raw_response"))


def q_annotation_summary(spark: SparkSession, root: str) -> DataFrame:
    return I.annotation_summary(read(spark, root, "predictions"))


def q_prompt_v2(spark: SparkSession, root: str) -> DataFrame:
    p = I.prompt("v2")
    return read(spark, root, "dataset_base").select("doc_id", F.sha1(F.encode(p, "UTF-8")).alias("prompt_sha1"), F.length(p).alias("n"))


def q_judge_prompt(spark: SparkSession, root: str) -> DataFrame:
    g = read(spark, root, "golden").where(F.col("gold_fields_payload").isNotNull())
    p = I.judge_prompt(F.col("text"), F.col("gold_fields_payload"), F.col("gold_fields_payload"))
    return g.select("doc_id", "annotator_id", F.sha1(F.encode(p, "UTF-8")).alias("prompt_sha1"), F.length(p).alias("n"))


# samples


def q_top_up(spark: SparkSession, root: str) -> DataFrame:
    """A sample of 150 filled up to 180 from the documents it lacks."""
    base = read(spark, root, "dataset_base").select("doc_id", "industry", "year", "text_len")
    return S.top_up(S.stratified_sample(base, 150).drop("__stratum"), base, 180).select("doc_id")


def q_golden_order(spark: SparkSession, root: str) -> DataFrame:
    return S.golden_order(read(spark, root, "golden"))


def q_scaffold_rows(spark: SparkSession, root: str) -> DataFrame:
    """The scaffold of q_golden_scaffold row by row."""
    base = read(spark, root, "dataset_base").select("doc_id", "industry", "year", "text_len")
    golden = S.golden_scaffold(S.assign_splits(S.stratified_sample(base, SAMPLE), TRAIN, DEV))
    return golden.select("doc_id", "split", "annotator_id", "qa_status", "guideline_version", "gold_fields_payload")


def q_union_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of q_union_sources, with nulls for the columns a source lacks."""
    c = read(spark, root, "captures").select(F.col("url_canonical").alias("url"), "domain", "title", "word_count", F.lit("capture").alias("origin"))
    b = read(spark, root, "dataset_base").select(F.col("url_canonical").alias("url"), "company", "title", "word_count", F.lit("base").alias("origin"))
    return corpus.union_sources(c, b)


# reports and joins of the last stages


def q_http_good(spark: SparkSession, root: str) -> DataFrame:
    c = corpus.recount(read(spark, root, "captures")).where(F.col("source") == "http")
    status = F.when(F.col("error").isNull(), 200).when(F.col("error") == "blocked", 403)
    return c.select("capture_id", corpus.http_good(status, F.col("word_count"), F.col("text_len")).alias("http_good"))


def q_exported_paths(spark: SparkSession, root: str) -> DataFrame:
    best = corpus.best_keys(read(spark, root, "captures")).select("url_canonical", "capture_id", "good")
    return corpus.with_paths(best, read(spark, root, "dataset_base").select("url_canonical", "text_path"))


def q_fallback_columns(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "captures")
    return c.select("capture_id", corpus.first_of(c, "merged_url", "url_final", "url_canonical").alias("url"), corpus.flags_json(c).alias("flags_json"), corpus.flags_json(c, "no_such").alias("none"))


def q_error_rows(spark: SparkSession, root: str) -> DataFrame:
    return corpus.error_rows(read(spark, root, "captures"))


def q_stage_reports(spark: SparkSession, root: str) -> DataFrame:
    captures, golden, predictions, base = (read(spark, root, t) for t in ("captures", "golden", "predictions", "dataset_base"))
    good = corpus.recount(captures).select(F.when(corpus.is_good(F.col("word_count"), F.col("text_len")), "good").otherwise("bad").alias("b"))
    parts = [
        corpus.stage_report("captures", good, F.col("b")), corpus.stage_report("golden", golden, F.lower(F.trim("split"))), corpus.stage_report("predictions", predictions, F.col("model_alias")),
        corpus.stage_report("dataset_base", base, F.lit("rows")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# files


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def q_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """Predictions written as JSON lines in two appends, with a broken line beside, and read back."""
    folder = scratch(spark, "jsonl")
    p = read(spark, root, "predictions").select("prediction_id", "doc_id", "raw_response", "error_tags")
    writers.write_jsonl(p.where("prediction_id % 2 = 0"), folder)
    writers.write_jsonl(p.where("prediction_id % 2 = 1"), folder, append=True)
    spark.range(1).select(F.lit('{"prediction_id": ').alias("value")).write.mode("append").text(folder)
    back = readers.read_jsonl(spark, folder, _schema("prediction_id bigint, doc_id string, raw_response string, error_tags array<string>"))
    return back.select("prediction_id", "doc_id", F.sha1(F.encode("raw_response", "UTF-8")).alias("raw_sha1"), F.array_join("error_tags", ",").alias("tags"))


def q_csv(spark: SparkSession, root: str) -> DataFrame:
    """Documents with quotes and line ends in their fields written as CSV and read back."""
    folder = scratch(spark, "csv")
    b = read(spark, root, "dataset_base").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "text_len")
    writers.write_csv(b, folder)
    back = readers.read_csv(spark, folder, _schema("doc_id string, title string, text string, text_len int"))
    return back.select("doc_id", F.sha1(F.encode(F.coalesce("title", F.lit("")), "UTF-8")).alias("title_sha1"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "text_len")


def q_url_list(spark: SparkSession, root: str) -> DataFrame:
    folder = scratch(spark, "urls")
    writers.write_csv(read(spark, root, "captures").select(F.col("url_original").alias("url"), "capture_id"), folder)
    return readers.read_url_list(spark, folder)


def q_id_list(spark: SparkSession, root: str) -> DataFrame:
    folder = scratch(spark, "ids")
    writers.write_ids(read(spark, root, "golden").select("doc_id").distinct(), folder)
    return readers.read_ids(spark, folder).select("doc_id")


def q_run_files(spark: SparkSession, root: str) -> DataFrame:
    """Answers written per model, as runs leave them, found and read together."""
    folder = scratch(spark, "run")
    p = read(spark, root, "predictions").select("prediction_id", "model_alias", "confidence")
    aliases = [r[0] for r in p.select("model_alias").distinct().limit(E.MOST_MODELS).collect()]
    for a in aliases:
        writers.write_jsonl(p.where(F.col("model_alias") == a).drop("model_alias"), f"{folder}/{a}/predictions.jsonl")
    return readers.read_predictions(spark, folder, _schema("prediction_id bigint, confidence double"))


def q_text_files(spark: SparkSession, root: str) -> DataFrame:
    """Every text as a file named by its path, and found again by the path's name."""
    folder = scratch(spark, "texts")
    b = read(spark, root, "dataset_base").where("text <> ''").select("doc_id", "text_path", "text")
    writers.write_texts(b.select(F.element_at(F.split("text_path", "/"), -1).alias("name"), "text"), folder)
    found = readers.resolve_text_paths(b.select("doc_id", F.col("text_path").alias("merged_text_path")), readers.read_texts(spark, folder))
    return found.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"))


def q_bucket(spark: SparkSession, root: str) -> DataFrame:
    """Captures written as a bucket of JSON lines, counts as text, and loaded as one row an address."""
    folder = scratch(spark, "bucket")
    c = read(spark, root, "captures").select(F.col("url_original").alias("url"), F.col("word_count").cast("string").alias("word_count"), "text_len", "text")
    writers.write_jsonl(c, folder)
    b = corpus.bucket(readers.read_jsonl(spark, folder, _schema("url string, word_count string, text_len int, text string")))
    return b.select("url_norm", "status_code", "word_count", "text_len", F.length("text").alias("n"), "base_domain", "is_medium_candidate")


def q_text_export(spark: SparkSession, root: str) -> DataFrame:
    """The good captures as a text store, and its files beside its index."""
    folder = scratch(spark, "store")
    writers.export_text_store(read(spark, root, "captures"), folder)
    index = readers.read_csv(spark, f"{folder}/index", _schema("text_file string, capture_id bigint, source string, url_original string, url_canonical string, url_final string, domain string, title string, word_count int, text_len int, error string, flags_json string"))
    files = readers.read_texts(spark, f"{folder}/texts").select(F.col("name").alias("text_file"), F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"))
    return index.join(files, "text_file").select("capture_id", "text_file", F.coalesce("error", F.lit("")).alias("error"), "flags_json", "text_sha1")


def q_xlsx(spark: SparkSession, root: str) -> DataFrame:
    """Fixed tables as two sheets of a workbook, and the first read back."""
    path = f"{scratch(spark, 'book')}.xlsx"
    targets = read(spark, root, "mix_targets")
    write_xlsx(path, targets=targets, trust=read(spark, root, "method_trust"))
    back = read_xlsx(spark, path)
    return back.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))


# streams


def q_stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """The events as a stream, counted per hour and type, late rows and all."""
    path, table = f"{root}/[e]vents.parquet", scratch(spark, "windows")
    events = spark.readStream.schema(read(spark, root, "events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(events, lateness="36500 days").select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")
    ingest.keep_table(counts, table, f"{table}-state").awaitTermination()
    kept = spark.read.parquet(table)
    return kept.select(F.date_format("start", "yyyy-MM-dd HH:00:00").alias("hour"), "event_type", "n", F.round("avg_value", 4).alias("avg_value"))


def q_stream_answers(spark: SparkSession, root: str) -> DataFrame:
    """Predictions as a stream of files, appended to a table without the keys it has."""
    source, table = scratch(spark, "arriving"), scratch(spark, "answers")
    schema = _schema("run_id string, model_alias string, doc_id string")
    writers.write_jsonl(read(spark, root, "predictions").select("run_id", "model_alias", "doc_id"), source)
    for _ in range(2):  # a stream that is resumed adds nothing
        ingest.append_new(ingest.prediction_stream(spark, source, schema), table, f"{table}-state").awaitTermination()
    return spark.read.parquet(table).select("run_id", "model_alias", "doc_id")


QUERIES = {f.__name__: f for f in (
    q_article_text, q_dom_text, q_fallback_text, q_json_html, q_payload_wellformed, q_status_snapshot, q_rejected_appends, q_parse_error_rows, q_loose_types, q_judge_scores, q_leaderboard_judged, q_board_lines,
    q_final_best, q_ordered_docs, q_max_docs, q_run_ids, q_inference_log, q_annotation_summary, q_prompt_v2, q_judge_prompt, q_top_up, q_golden_order, q_scaffold_rows, q_union_rows, q_http_good, q_exported_paths, q_fallback_columns, q_error_rows,
    q_stage_reports, q_jsonl, q_csv, q_url_list, q_id_list, q_run_files, q_text_files, q_bucket, q_text_export, q_xlsx, q_stream_windows, q_stream_answers,
)}

_STRIP = lambda c: rf"regexp_replace({c}, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"
_LINES = "array_to_string([x for x in [trim(y) for y in string_split(coalesce(text, ''), chr(10))] if x <> ''], chr(10))"
_SAFE = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PAGE = (
    f"'<html><head><title>' || {_SAFE('title')} || '</title><script>var a = ''<p>'';</script></head><body><nav>Menu</nav>' || chr(10) || '<article>' || '<p>' || "
    f"replace({_SAFE('text')}, chr(10), '</p>' || chr(10) || '<p>') || '</p>' || '</article><footer>End</footer></body></html>'"
)
_WELL = "w AS (SELECT prediction_id, CASE WHEN json_valid(raw_response) THEN raw_response END AS r FROM predictions WHERE starts_with(raw_response, '{') AND ends_with(raw_response, '}') AND NOT regexp_matches(raw_response, ',\\s*[}\\]]'))"  # DuckDB takes trailing commas for valid
_SPAN = "CAST(json_extract(r, '$.evidence_spans') AS STRUCT(field VARCHAR, quote VARCHAR, start_char INTEGER, end_char INTEGER)[])"
_GOOD = "coalesce(word_count >= 300 AND text_len >= 1000, false)"
_RECOUNT = f"WITH {corpus_queries.SCORED_SQL} SELECT capture_id, source, error, wc AS word_count, tl AS text_len FROM s"
_JUDGE = f"""{SCORED},
tx AS (SELECT doc_id, substr(max(text), 1, 6000) AS text FROM golden WHERE lower(trim(split)) = '{SPLIT}' GROUP BY 1),
qs AS (SELECT s.doc_id, s.model_alias, s.status_accuracy, text, [x.quote for x in ps if coalesce(x.quote, '') <> ''] AS q FROM s JOIN sp USING (doc_id, model_alias) LEFT JOIN tx USING (doc_id)),
gr AS (SELECT *, CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len([x for x in q if contains(coalesce(text, ''), x)]) / CAST(len(q) AS DOUBLE) END AS g FROM qs),
js AS (SELECT doc_id, model_alias, (g + status_accuracy + 1 - CASE WHEN 1 - g = 0 THEN 1 ELSE 1 - g END) / 3 AS semantic FROM gr)"""
_BOARD = f"""a AS (SELECT model_alias, count(*) AS docs, avg(CASE WHEN pred_structured_valid THEN 1.0 ELSE 0.0 END) AS v, avg(status_accuracy) AS sa, avg(deployment_exact) AS de,
  avg(CASE WHEN maturity_gold = maturity_pred THEN 1.0 ELSE 0.0 END) AS ma, avg(span_overlap) AS so FROM s GROUP BY 1),
b AS (SELECT *, 0.15 * sa + 0.10 * de + 0.30 * macro_f1 + 0.20 * ma + 0.15 * greatest(0.0, least(1.0, (kappa + 1) / 2)) + 0.10 * so AS strict FROM a JOIN f USING (model_alias) JOIN kk USING (model_alias))"""
_PROMPT2 = (
    "'Extract the listed fields from the article as one JSON object. Check every field against the text before you answer; of two levels choose the lower; quote the evidence verbatim.' || chr(10) || chr(10) || "
    + " || ".join(f"'{c}: ' || coalesce({c}, '') || chr(10)" for c in ("company", "industry", "year", "title"))
    + " || chr(10) || substr(coalesce(text, ''), 1, 16000)"
)
_JPROMPT = (
    "'Rate groundedness, completeness and hallucination_risk from 0 to 1 as one JSON object.' || chr(10) || chr(10) || 'Source:' || chr(10) || substr(coalesce(text, ''), 1, 6000) || chr(10) || chr(10) || 'Reference:'"
    " || chr(10) || gold_fields_payload || chr(10) || chr(10) || 'Candidate:' || chr(10) || gold_fields_payload"
)
_ABSENT = "{" + ",".join([*[f'"{f}":{{"status":"absent","items":[]}}' for f in LIST_FIELDS], '"deployment_scope":{"status":"absent","value":""}', '"maturity_level":0,"maturity_rationale":"","confidence":0.0,"evidence_spans":[]']) + "}"
_field = lambda f: f"json_extract(p, '$.{f}')"
_REJECT = "CASE WHEN coalesce(trim(doc_id), '') = '' THEN 'no_doc_id' WHEN p IS NULL THEN 'bad_json' " + " ".join(
    [f"WHEN {_field(f)} IS NULL THEN 'missing:{f}'" for f in (*FIELDS, "maturity_level", "maturity_rationale", "confidence", "evidence_spans")]
    + [f"WHEN coalesce(json_extract_string(p, '$.{f}.status'), '') NOT IN ('present', 'absent', 'uncertain') THEN 'bad_status:{f}'" for f in FIELDS]
) + " WHEN CAST(json_extract(p, '$.maturity_level') AS INTEGER) NOT BETWEEN 0 AND 4 THEN 'bad_level' WHEN CAST(json_extract(p, '$.confidence') AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'bad_confidence' END"

_SLUG80 = f"trim(substr(replace({corpus_queries._SLUG}, ' ', '_'), 1, 80), '_')"
_URL = corpus_queries._NORMAL("url_original")
_HOST = corpus_queries.HOST_SQL("url_norm")
ORACLE = {
    "q_bucket": f"""WITH n AS (SELECT {_URL} AS url_norm, coalesce(word_count, 0) AS word_count, coalesce(text_len, 0) AS text_len, coalesce(text, '') AS text FROM captures),
b AS (SELECT *, row_number() OVER (PARTITION BY url_norm ORDER BY word_count DESC, text_len DESC, text DESC) AS rn FROM n)
SELECT url_norm, 0 AS status_code, word_count, text_len, CAST(length(text) AS INTEGER) AS n, {corpus_queries._BASE(_HOST)} AS base_domain, regexp_replace({_HOST}, '^www\\.', '') = 'medium.com'
  OR regexp_matches(regexp_replace(regexp_extract(url_norm, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '(?i)-[0-9a-f]{{10,14}}$') AS is_medium_candidate FROM b WHERE rn = 1""",
    "q_text_export": f"""SELECT capture_id, printf('%04d', capture_id) || '_' || coalesce(domain, '') || '_' || CASE WHEN {_SLUG80} = '' THEN 'doc' ELSE {_SLUG80} END || '.txt' AS text_file, coalesce(error, '') AS error,
  coalesce(CAST(to_json(flags) AS VARCHAR), '{{}}') AS flags_json, sha1(text) AS text_sha1 FROM captures WHERE {_GOOD} AND coalesce(text, '') <> ''""",
    "q_xlsx": "SELECT source, target_share, max_repeats FROM mix_targets",
    "q_article_text": f"SELECT doc_id, CASE WHEN length({_LINES}) >= 200 THEN sha1({_LINES}) END AS text_sha1, nullif(trim(coalesce(title, '')), '') AS title FROM documents",
    "q_dom_text": f"""WITH t AS (SELECT doc_id, {_LINES} AS a FROM documents), u AS (SELECT doc_id, a, 'Menu' || chr(10) || a || CASE WHEN a = '' THEN '' ELSE chr(10) END || 'End' AS b FROM t)
SELECT doc_id, CASE WHEN length(a) >= 400 THEN 'playwright_article' WHEN length(b) >= 400 THEN 'playwright_body' END AS method,
  CAST(CASE WHEN length(a) >= 400 THEN length(a) WHEN length(b) >= 400 THEN length(b) END AS INTEGER) AS n FROM u""",
    "q_fallback_text": f"SELECT doc_id, CASE WHEN length({_LINES}) >= 400 THEN sha1({_LINES}) END AS text_sha1 FROM documents",
    "q_json_html": f"SELECT doc_id, CASE WHEN length({_PAGE}) > 2000 THEN sha1({_PAGE}) END AS html_sha1, true AS guard_gone FROM documents",
    "q_payload_wellformed": f"""WITH {_WELL}, x AS (SELECT * FROM w WHERE r IS NOT NULL)
SELECT prediction_id, CAST(json_extract(r, '$.maturity_level') AS INTEGER) AS maturity_level, {_STRIP("json_extract_string(r, '$.maturity_rationale')")} AS rationale,
  round(CAST(json_extract(r, '$.confidence') AS DOUBLE), 4) AS confidence, CAST(len({_SPAN}) AS INTEGER) AS spans, array_to_string([{_STRIP('s.quote')} for s in {_SPAN}], '|') AS quotes,
  CAST(coalesce(list_sum([coalesce(s.start_char, -1) + coalesce(s.end_char, -1) for s in {_SPAN}]), 0) AS BIGINT) AS offsets,
  concat_ws(',', {', '.join(f"json_extract_string(r, '$.{f}.status')" for f in FIELDS)}) AS statuses, json_extract_string(r, '$.deployment_scope.value') AS scope,
  concat_ws('|', {', '.join(f"array_to_string(CASE WHEN json_extract_string(r, '$.{f}.status') = 'absent' THEN [] ELSE CAST(json_extract(r, '$.{f}.items') AS VARCHAR[]) END, ';')" for f in LIST_FIELDS)}) AS items,
  0 AS problems FROM x""",
    "q_status_snapshot": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT prediction_id, '{f}' AS field, coalesce(json_extract_string(fields_payload, '$.{f}.status'), 'uncertain') AS status FROM predictions" for f in FIELDS) + ")",
    "q_rejected_appends": f"""WITH g AS (SELECT doc_id, gold_fields_payload AS p FROM golden),
r AS (SELECT * FROM g UNION ALL SELECT doc_id, replace(p, '"status":', '"state":') FROM g UNION ALL SELECT ' ', p FROM g UNION ALL SELECT doc_id, substr(p, 1, 40) FROM g),
v AS (SELECT doc_id, CASE WHEN json_valid(p) THEN p END AS p FROM r),
z AS (SELECT {_REJECT} AS reason FROM v) SELECT reason, count(*) AS n FROM z WHERE reason IS NOT NULL GROUP BY 1""",
    "q_parse_error_rows": f"SELECT prediction_id, '{_ABSENT}' AS payload FROM predictions WHERE list_contains(error_tags, 'parse_error')",
    "q_loose_types": f"""SELECT doc_id, CAST(trunc(coalesce(TRY_CAST(year AS DOUBLE), 0)) AS INTEGER) AS year, text_len % 2 IN (1, -1) AND text_len % 2 = 1 AS odd,
  coalesce(lower({_STRIP('company')}) IN ('1', 'true', 'yes', 'y'), false) AS company FROM dataset_base""",
    "q_judge_scores": f"WITH {_JUDGE} SELECT doc_id, model_alias, round(semantic, 4) AS semantic_score, NULL::VARCHAR AS judge_error FROM js",
    "q_leaderboard_judged": f"""WITH {_JUDGE}, {_BOARD}, sm AS (SELECT model_alias, avg(semantic) AS semantic FROM js GROUP BY 1)
SELECT model_alias, '{SPLIT}' AS split, docs, round(v, 4) AS structured_valid_rate, round(sa, 4) AS status_accuracy, round(de, 4) AS deployment_exact, micro_f1 AS multilabel_micro_f1, macro_f1 AS multilabel_macro_f1,
  round(ma, 4) AS maturity_accuracy, round(kappa, 4) AS maturity_kappa, round(so, 4) AS evidence_span_overlap, round(strict, 4) AS strict_score, round(semantic, 4) AS semantic_score,
  round(0.7 * strict + 0.3 * semantic, 4) AS final_score FROM b JOIN sm USING (model_alias)""",
    "q_board_lines": f"""WITH {SCORED}, {_BOARD} SELECT model_alias, '| ' || model_alias || ' | ' || printf('%.4f', round(0.7 * strict, 4)) || ' | ' || printf('%.4f', round(strict, 4)) || ' | 0.0000 | ' || printf('%.4f', round(v, 4)) || ' |' AS line FROM b""",
    "q_final_best": f"""WITH {SCORED}, {_BOARD}, best AS (SELECT model_alias FROM b ORDER BY round(0.7 * strict, 4) DESC, round(strict, 4) DESC, model_alias LIMIT 1),
last AS (SELECT *, row_number() OVER (PARTITION BY doc_id, model_alias ORDER BY prediction_id DESC) AS rn FROM predictions WHERE model_alias IN (SELECT model_alias FROM best))
SELECT doc_id, last.model_alias, run_id, structured_valid, coalesce(CAST(json_extract(fields_payload, '$.maturity_level') AS INTEGER), 0) AS maturity_level,
  coalesce(json_extract_string(fields_payload, '$.deployment_scope.status'), 'uncertain') AS deployment_scope_status FROM last JOIN dataset_base USING (doc_id) WHERE rn = 1""",
    "q_ordered_docs": r"SELECT doc_id, title, -CAST(regexp_extract(doc_id, '(\d+)', 1) AS BIGINT) AS position FROM dataset_base WHERE doc_id IN (SELECT doc_id FROM golden WHERE lower(trim(split)) = 'test')",
    "q_max_docs": r"""SELECT doc_id, -CAST(regexp_extract(doc_id, '(\d+)', 1) AS BIGINT) AS position FROM dataset_base WHERE doc_id IN (SELECT doc_id FROM golden WHERE lower(trim(split)) = 'test') ORDER BY 2 LIMIT 25""",
    "q_run_ids": "SELECT capture_id, 'run_' || strftime(ingested_at, '%Y%m%dT%H%M%SZ') AS run_id FROM captures",
    "q_inference_log": """SELECT prediction_id, '{"doc_id":' || to_json(doc_id) || ',"model_alias":' || to_json(model_alias) || ',"latency_ms":' || coalesce(CAST(latency_ms AS VARCHAR), 'null') || ',"structured_valid":'
  || coalesce(CAST(structured_valid AS VARCHAR), 'null') || ',"error_tags":' || to_json(coalesce(error_tags, [])) || ',"maturity_level":' || coalesce(maturity_level, 0) || '}' AS event FROM predictions""",
    "q_annotation_summary": f"""SELECT run_id, model_alias, count(*) AS rows, count(*) FILTER (structured_valid) AS valid, round(avg(CASE WHEN structured_valid THEN 1.0 ELSE 0.0 END), 4) AS valid_rate,
  count(*) FILTER (NOT coalesce(structured_valid, false)) AS parse_errors, {', '.join(f'count(*) FILTER (structured_valid AND maturity_level = {k}) AS level_{k}' for k in range(5))},
  coalesce(round(avg(confidence) FILTER (structured_valid), 4), 0.0) AS avg_confidence FROM predictions GROUP BY 1, 2""",
    "q_prompt_v2": f"SELECT doc_id, sha1({_PROMPT2}) AS prompt_sha1, CAST(length({_PROMPT2}) AS INTEGER) AS n FROM dataset_base",
    "q_judge_prompt": f"SELECT doc_id, annotator_id, sha1({_JPROMPT}) AS prompt_sha1, CAST(length({_JPROMPT}) AS INTEGER) AS n FROM golden WHERE gold_fields_payload IS NOT NULL",
    "q_top_up": f"""WITH {_STRATA.strip()}, {_alloc('st', 150, 'al')},
sm AS (SELECT doc_id FROM (SELECT st.*, al.n, row_number() OVER (PARTITION BY stratum ORDER BY sha1(doc_id || ':42'), doc_id) AS rn FROM st JOIN al USING (stratum)) WHERE rn <= n),
ex AS (SELECT doc_id FROM dataset_base WHERE doc_id NOT IN (SELECT doc_id FROM sm) ORDER BY sha1(doc_id || ':42'), doc_id LIMIT 30)
SELECT doc_id FROM sm UNION ALL SELECT doc_id FROM ex""",
    "q_golden_order": """WITH d AS (SELECT DISTINCT doc_id, lower(trim(coalesce(split, ''))) AS split FROM golden)
SELECT doc_id, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, doc_id, split) AS position FROM d""",
    "q_scaffold_rows": f"""WITH {_SPLIT.strip()} SELECT doc_id, split, '' AS annotator_id, 'pending' AS qa_status, 'maturity_v1.0' AS guideline_version, '{_ABSENT.replace('"absent"', '"uncertain"')}' AS gold_fields_payload FROM sl""",
    "q_union_rows": """SELECT url_canonical AS url, domain, title, word_count, 'capture' AS origin, NULL::VARCHAR AS company FROM captures
UNION ALL SELECT url_canonical, NULL, title, word_count, 'base', company FROM dataset_base""",
    "q_http_good": f"WITH c AS ({_RECOUNT}) SELECT capture_id, coalesce(error IS NULL, false) AND {_GOOD} AS http_good FROM c WHERE source = 'http'",
    "q_exported_paths": f"""SELECT b.url_canonical, capture_id, good, coalesce(p.text_path, '') AS text_path, NOT good OR coalesce(p.text_path, '') = '' AS unresolved
FROM ({corpus_queries.ORACLE['q_best_per_url']}) b LEFT JOIN (SELECT url_canonical, min(text_path) AS text_path FROM dataset_base GROUP BY 1) p ON b.url_canonical = p.url_canonical""",
    "q_fallback_columns": "SELECT capture_id, coalesce(url_final, url_canonical) AS url, coalesce(CAST(to_json(flags) AS VARCHAR), '{}') AS flags_json, '{}' AS none FROM captures",
    "q_error_rows": "SELECT capture_id, coalesce(url_original, url_canonical) AS url, error FROM captures WHERE coalesce(error, '') <> ''",
    "q_stage_reports": f"""WITH c AS ({_RECOUNT}) SELECT 'captures' AS stage, CASE WHEN {_GOOD} THEN 'good' ELSE 'bad' END AS bucket, count(*) AS n FROM c GROUP BY 2
UNION ALL SELECT 'golden', coalesce(lower(trim(split)), ''), count(*) FROM golden GROUP BY 2 UNION ALL SELECT 'predictions', coalesce(model_alias, ''), count(*) FROM predictions GROUP BY 2
UNION ALL SELECT 'dataset_base', 'rows', count(*) FROM dataset_base""",
    "q_jsonl": "SELECT prediction_id, doc_id, sha1(raw_response) AS raw_sha1, array_to_string(error_tags, ',') AS tags FROM predictions",
    "q_csv": "SELECT doc_id, sha1(coalesce(title, '')) AS title_sha1, CAST(length(coalesce(text, '')) AS INTEGER) AS n, text_len FROM dataset_base",
    "q_url_list": f"SELECT {_STRIP('url_original')} AS url FROM captures WHERE {_STRIP('url_original')} <> ''",
    "q_id_list": "SELECT DISTINCT doc_id FROM golden",
    "q_run_files": "SELECT model_alias, prediction_id, confidence FROM predictions",
    "q_text_files": "SELECT doc_id, sha1(text) AS text_sha1 FROM dataset_base WHERE text <> ''",
    "q_stream_windows": "SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS hour, event_type, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2",
    "q_stream_answers": "SELECT DISTINCT run_id, model_alias, doc_id FROM predictions",
}
