"""The reporting layer: distributions, agreement, coverage and trends over predictions.

All reports start from the last prediction of each document and model (``latest``), or from one long
table of signals (document, model, field, status, items), and are one or two aggregations each; model,
run and prompt are columns, never folders or loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.payload import FIELDS, LIST_FIELDS, statuses, stored
from lexmill.functions.text import normalize_year, strip

LEVELS = (0, 1, 2, 3, 4)
# Upper edges of the confidence buckets and their names.
CONFIDENCE = ((0.0, "0"), (0.30, "0.01-0.30"), (0.50, "0.31-0.50"), (0.70, "0.51-0.70"), (0.90, "0.71-0.90"), (1.0, "0.91-1.00"))


def signals(predictions: DataFrame) -> DataFrame:
    """(doc_id, model_alias, field, status, items): one row for each of the nine fields."""
    p = predictions.select("doc_id", "model_alias", stored(F.col("fields_payload")).alias("p"))
    return p.select("doc_id", "model_alias", F.explode(statuses(F.col("p"))).alias("s")).select("doc_id", "model_alias", "s.field", "s.status", "s.items")


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def _tokens(key: str) -> Column:
    return F.coalesce(F.element_at("token_usage", key), F.lit(0))


def run_summary(predictions: DataFrame) -> DataFrame:
    """Per model: rows, validity, errors by kind, latency and tokens."""
    n = F.count(F.lit(1))
    tag = lambda t: F.count_if(F.array_contains(F.coalesce("error_tags", F.array().cast("array<string>")), t))
    done, ms = F.sum(_tokens("completion_tokens")), F.sum(F.coalesce("latency_ms", F.lit(0)))
    return predictions.groupBy("model_alias").agg(
        n.alias("rows"),
        F.count_if("structured_valid").alias("valid_rows"),
        ratio(F.count_if("structured_valid"), n).alias("valid_rate"),
        tag("provider_error").alias("provider_errors"),
        tag("parse_error").alias("parse_errors"),
        tag("schema_error").alias("schema_errors"),
        ratio(ms, n, 2).alias("avg_latency_ms"),
        F.round(ms / F.lit(3.6e6), 4).alias("hours"),
        F.sum(_tokens("prompt_tokens")).alias("prompt_tokens"),
        done.alias("completion_tokens"),
        F.sum(_tokens("total_tokens")).alias("total_tokens"),
        ratio(done, n, 2).alias("avg_completion_tokens"),
        F.round(done / F.greatest(ms / F.lit(1000.0), F.lit(0.001)), 2).alias("tokens_per_second"),
    )


def tag_histogram(predictions: DataFrame) -> DataFrame:
    """(model_alias, tag, n)."""
    return predictions.select("model_alias", F.explode("error_tags").alias("tag")).groupBy("model_alias", "tag").agg(F.count(F.lit(1)).alias("n"))


def maturity_distribution(last: DataFrame) -> DataFrame:
    """(model_alias, n, level_0 .. level_4, avg_level, share_2_up) over all documents of a model;
    unreadable answers count as level 0."""
    n = F.count(F.lit(1))
    return last.groupBy("model_alias").agg(
        n.alias("n"),
        *[F.count_if(F.col("maturity_level") == k).alias(f"level_{k}") for k in LEVELS],
        F.round(F.avg("maturity_level"), 4).alias("avg_level"),
        ratio(F.count_if(F.col("maturity_level") >= 2), n).alias("share_2_up"),
    )


def _pairs(last: DataFrame) -> DataFrame:
    """Every two models' levels of each document; a document has as many rows as it has pairs of
    models, and models are few."""
    per = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("model_alias").alias("m"), F.col("maturity_level").alias("l")))).alias("x"))
    later = lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a["m"].alias("a"), b["m"].alias("b"), a["l"].alias("la"), b["l"].alias("lb")))
    pairs = F.explode(F.flatten(F.transform("x", later)))
    return per.select("doc_id", pairs.alias("p")).select("doc_id", "p.a", "p.b", "p.la", "p.lb")


def agreement(last: DataFrame) -> DataFrame:
    """(a, b, common, equal, rate, within_1, mean_difference) of every two models, a before b."""
    n = F.count(F.lit(1))
    return _pairs(last).groupBy("a", "b").agg(
        n.alias("common"),
        F.count_if(F.col("la") == F.col("lb")).alias("equal"),
        ratio(F.count_if(F.col("la") == F.col("lb")), n).alias("rate"),
        ratio(F.count_if(F.abs(F.col("la") - F.col("lb")) <= 1), n).alias("within_1"),
        F.round(F.avg(F.col("lb") - F.col("la")), 4).alias("mean_difference"),
    )


def average_agreement(last: DataFrame) -> DataFrame:
    """(model_alias, avg_rate): mean of a model's unrounded agreement with each other model."""
    rates = _pairs(last).groupBy("a", "b").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("r"))
    both = rates.select(F.explode(F.array("a", "b")).alias("model_alias"), "r")
    return both.groupBy("model_alias").agg(F.round(F.avg("r"), 4).alias("avg_rate"), F.count(F.lit(1)).alias("others"))


def large_disagreements(last: DataFrame, least: int = 2) -> DataFrame:
    """Documents on which two models are ``least`` levels or more apart."""
    return _pairs(last).where(F.abs(F.col("la") - F.col("lb")) >= least).select("doc_id", "a", "b", F.col("la").alias("level_a"), F.col("lb").alias("level_b"))


def unanimity(last: DataFrame) -> DataFrame:
    """(kind, level, n): documents with two or more models that all give one level, by level, and
    the disputed ones (level -1)."""
    per = last.groupBy("doc_id").agg(F.min("maturity_level").alias("lo"), F.max("maturity_level").alias("hi"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    kind = F.when(F.col("lo") == F.col("hi"), "unanimous").otherwise("disputed")
    return per.select(kind.alias("kind"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("level")).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))


def majority(last: DataFrame) -> DataFrame:
    """(doc_id, level, votes, models): the most frequent level, the lower of two equally frequent."""
    counts = last.groupBy("doc_id").agg(*[F.count_if(F.col("maturity_level") == k).alias(f"c{k}") for k in LEVELS], F.count(F.lit(1)).alias("models"))
    most = F.greatest(*[F.col(f"c{k}") for k in LEVELS])
    level = F.coalesce(*[F.when(F.col(f"c{k}") == most, F.lit(k)) for k in LEVELS])
    return counts.select("doc_id", level.alias("level"), most.alias("votes"), "models")


def issue_table(predictions: DataFrame) -> DataFrame:
    """(model_alias, parse_error, wrong_fields, alias_used, total, share) of schema issues."""
    tags = F.coalesce("error_tags", F.array().cast("array<string>"))
    has = lambda t: F.count_if(F.array_contains(tags, t))
    parts = [has("parse_error"), has("wrong_field_names_detected"), has("evidence_spans_alias_used")]
    total = parts[0] + parts[1] + parts[2]
    return predictions.groupBy("model_alias").agg(
        parts[0].alias("parse_error"), parts[1].alias("wrong_fields"), parts[2].alias("alias_used"), total.alias("total"), ratio(total, F.count(F.lit(1))).alias("share")
    )


def confidence_bucket(c: Column) -> Column:
    out = F.when(c <= CONFIDENCE[0][0], CONFIDENCE[0][1])
    for top, name in CONFIDENCE[1:]:
        out = out.when(c <= top, name)
    return out


def confidence_histogram(last: DataFrame) -> DataFrame:
    """(model_alias, bucket, n, share)."""
    counts = last.groupBy("model_alias", confidence_bucket(F.coalesce("confidence", F.lit(0.0))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("model_alias"))
    return counts.select("model_alias", "bucket", "n", ratio(F.col("n"), whole).alias("share"))


def confidence_stats(last: DataFrame) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.0))
    return last.groupBy("model_alias").agg(F.round(F.avg(c), 4).alias("avg_confidence"), F.max(c).alias("max_confidence"), F.min(c).alias("min_confidence"))


def fill_rate(long: DataFrame) -> DataFrame:
    """(model_alias, field, present, n, rate)."""
    n = F.count(F.lit(1))
    return long.groupBy("model_alias", "field").agg(F.count_if(F.col("status") == "present").alias("present"), n.alias("n"), ratio(F.count_if(F.col("status") == "present"), n).alias("rate"))


def mean_fill(long: DataFrame) -> DataFrame:
    """(model_alias, mean_fill): mean over the nine fields of the unrounded rates."""
    per = long.groupBy("model_alias", "field").agg(F.avg((F.col("status") == "present").cast("double")).alias("r"))
    return per.groupBy("model_alias").agg(F.round(F.avg("r"), 4).alias("mean_fill"))


def span_depth(last: DataFrame) -> DataFrame:
    """Evidence by model: documents with spans, coverage, spans per such document, total, and
    documents with signals but no spans."""
    k = F.size(F.coalesce("evidence_spans", F.array().cast("array<struct<field:string,quote:string,start_char:int,end_char:int>>")))
    with_spans = F.when(k > 0, k)
    signs = F.array_contains(F.map_values(F.coalesce("status_snapshot", F.create_map().cast("map<string,string>"))), "present")
    n = F.count(F.lit(1))
    return last.groupBy("model_alias").agg(
        F.count(with_spans).alias("docs_with_spans"),
        ratio(F.count(with_spans), n).alias("coverage"),
        F.round(F.coalesce(F.avg(with_spans), F.lit(0.0)), 4).alias("avg_spans"),
        F.coalesce(F.percentile(with_spans, F.lit(0.5)), F.lit(0.0)).alias("median_spans"),
        F.coalesce(F.max(with_spans), F.lit(0)).alias("max_spans"),
        F.coalesce(F.sum(k), F.lit(0)).alias("total_spans"),
        F.count_if(signs & (k == 0)).alias("empty_despite_signals"),
    )


def items_per_present(long: DataFrame) -> DataFrame:
    """(model_alias, field, avg_items) of list fields where they are present."""
    some = long.where((F.col("status") == "present") & F.col("field").isin(*LIST_FIELDS))
    return some.groupBy("model_alias", "field").agg(F.round(F.avg(F.size("items")), 4).alias("avg_items"), F.count(F.lit(1)).alias("n"))


def throughput(predictions: DataFrame) -> DataFrame:
    """Models by latency, the fastest first, with the ratio to the fastest."""
    per = predictions.groupBy("model_alias").agg(F.avg("latency_ms").alias("ms"), F.sum("latency_ms").alias("sum"))
    few = Window.partitionBy(F.lit(0))  # one row a model
    return per.select(
        "model_alias", F.round("ms", 2).alias("avg_latency_ms"), F.round(F.col("sum") / F.lit(3.6e6), 4).alias("hours"),
        F.rank().over(few.orderBy("ms")).alias("rank"), F.round(F.col("ms") / F.min("ms").over(few), 4).alias("slowdown"),
    )


def scaling(predictions: DataFrame) -> DataFrame:
    """Change of latency and validity from each model of a family to its next larger one. Family and
    size come from the alias (``fenn_14b`` is 14 of fenn)."""
    family, size = F.regexp_extract("model_alias", r"^(.*)_(\d+)b$", 1), F.regexp_extract("model_alias", r"^(.*)_(\d+)b$", 2)
    per = predictions.where(size != "").groupBy(family.alias("family"), size.cast("int").alias("size")).agg(
        F.avg("latency_ms").alias("ms"), F.avg(F.col("structured_valid").cast("double")).alias("valid")
    )
    w = Window.partitionBy("family").orderBy("size")
    before = lambda c: F.lag(c).over(w)
    return per.select(
        "family", "size", F.round(F.col("ms") / before("ms") - 1, 4).alias("latency_change"), F.round(F.col("valid") - before("valid"), 4).alias("valid_change")
    ).where(F.col("latency_change").isNotNull())


def drift(last: DataFrame, subset: DataFrame) -> DataFrame:
    """(model_alias, all_share, subset_share, delta_pp): share of levels 2 and up on all documents
    and on a subset of doc_ids."""
    s = last.join(subset.select("doc_id").distinct().withColumn("__s", F.lit(True)), "doc_id", "left")
    up = (F.col("maturity_level") >= 2).cast("double")
    a, b = F.avg(up), F.avg(F.when(F.col("__s"), up))
    return s.groupBy("model_alias").agg(F.round(a, 4).alias("all_share"), F.round(b, 4).alias("subset_share"), F.round(100 * (b - a), 4).alias("delta_pp"))


def with_documents(last: DataFrame, dataset_base: DataFrame) -> DataFrame:
    """Predictions with their document's company, industry and year, spelling undone."""
    t = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    d = dataset_base.select("doc_id", t("company").alias("company"), t("industry").alias("industry"), normalize_year(F.col("year")).alias("year"))
    return last.join(d, "doc_id")


def composition(dataset_base: DataFrame) -> DataFrame:
    """(industry, n, share) of the documents."""
    counts = dataset_base.groupBy(strip(F.coalesce("industry", F.lit(""))).alias("industry")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("industry", "n", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def year_bucket(year: Column) -> Column:
    return F.when(year == "", "unknown").when(year.isin("2017", "2018", "2019"), "2017-2019").otherwise(year)


def year_composition(dataset_base: DataFrame) -> DataFrame:
    return dataset_base.groupBy(year_bucket(normalize_year(F.col("year"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_companies(dataset_base: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent companies, ties by name; a top-k report."""
    named = dataset_base.select(strip(F.coalesce("company", F.lit(""))).alias("company")).where(F.col("company") != "")
    return named.groupBy("company").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "company").limit(k)


def _maturity(group: list[str], df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("n"), F.round(F.avg("maturity_level"), 4).alias("avg_level"), ratio(F.count_if(F.col("maturity_level") >= 2), n).alias("share_2_up"),
        ratio(F.count_if(F.col("maturity_level") == 3), n).alias("share_3"), *[F.count_if(F.col("maturity_level") == k).alias(f"level_{k}") for k in LEVELS],
    )


def industry_maturity(joined: DataFrame) -> DataFrame:
    """Levels by industry, valid answers only."""
    return _maturity(["industry"], joined.where("structured_valid"))


def company_maturity(joined: DataFrame, least: int = 5) -> DataFrame:
    """Companies with at least ``least`` valid answers, by average level, ranked."""
    per = _maturity(["company"], joined.where(F.col("structured_valid") & (F.col("company") != ""))).where(F.col("n") >= least)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("avg_level"), F.desc("n"), "company")
    return per.select("company", "n", "avg_level", "share_2_up", "level_3", F.row_number().over(w).alias("rank"))


def year_trend(joined: DataFrame) -> DataFrame:
    return _maturity(["bucket"], joined.where("structured_valid").withColumn("bucket", year_bucket(F.col("year"))))


def coverage_by_industry(long: DataFrame, dataset_base: DataFrame) -> DataFrame:
    """Share of present signals, industry by field (nine columns)."""
    j = with_documents(long, dataset_base)
    rates = [F.round(F.avg(F.when(F.col("field") == f, (F.col("status") == "present").cast("double"))), 4).alias(f) for f in FIELDS]
    return j.groupBy("industry").agg(*rates)


def top_terms(long: DataFrame, dataset_base: DataFrame, field: str = "ai_use_cases", k: int = 10) -> DataFrame:
    """(industry, term, n, rank): each industry's k most frequent items of a field, ties by name."""
    j = with_documents(long.where((F.col("field") == field) & (F.col("status") == "present")), dataset_base)
    terms = j.select("industry", F.explode("items").alias("t")).select("industry", F.lower(strip(F.col("t"))).alias("term")).where(F.col("term") != "")
    counts = terms.groupBy("industry", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("industry").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_reach(top: DataFrame) -> DataFrame:
    """(term, industries, n): in how many industries a term is among the top."""
    return top.groupBy("term").agg(F.count_distinct("industry").alias("industries"), F.sum("n").alias("n"))


def robustness(joined: DataFrame, models: list[str]) -> DataFrame:
    """Average level by industry for a few models side by side, the differences to the first, and
    each model's rank of the industry."""
    avg = [F.avg(F.when(F.col("model_alias") == m, F.col("maturity_level"))).alias(m) for m in models]
    per = joined.where(F.col("structured_valid") & F.col("model_alias").isin(*models)).groupBy("industry").agg(*avg)
    w = lambda m: Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(m), "industry")
    return per.select(
        "industry",
        *[F.round(m, 4).alias(f"avg_{m}") for m in models],
        *[F.round(F.col(m) - F.col(models[0]), 4).alias(f"delta_{m}") for m in models[1:]],
        *[F.round(F.try_divide(F.col(m), F.col(models[0])), 4).alias(f"ratio_{m}") for m in models[1:]],
        *[F.row_number().over(w(m)).alias(f"rank_{m}") for m in models],
    )


def by_run(predictions: DataFrame) -> DataFrame:
    """(run_id, model_alias): levels, validity and oddities of each prompt run and model."""
    tags = F.coalesce("error_tags", F.array().cast("array<string>"))
    has = lambda t: F.count_if(F.array_contains(tags, t))
    n = F.count(F.lit(1))
    return predictions.groupBy("run_id", "model_alias").agg(
        n.alias("n"), F.round(F.avg("maturity_level"), 4).alias("avg_level"), *[F.count_if(F.col("maturity_level") == k).alias(f"level_{k}") for k in LEVELS],
        has("parse_error").alias("parse_errors"), has("wrong_field_names_detected").alias("wrong_fields"), has("evidence_spans_empty_despite_signals").alias("empty_spans"),
        ratio(F.count_if("structured_valid"), n).alias("valid_rate"),
    )


def flips(predictions: DataFrame) -> DataFrame:
    """(run_a, run_b, model_alias, common, changed, up, down, unchanged): levels of the documents two
    runs of a model have in common; the last answer of a run counts."""
    w = Window.partitionBy("doc_id", "model_alias", "run_id").orderBy(F.desc("prediction_id"))
    one = predictions.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
    per = one.groupBy("doc_id", "model_alias").agg(F.array_sort(F.collect_list(F.struct(F.col("run_id").alias("r"), F.col("maturity_level").alias("l")))).alias("x"))
    later = lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a["r"].alias("a"), b["r"].alias("b"), a["l"].alias("la"), b["l"].alias("lb")))
    p = per.select("model_alias", F.explode(F.flatten(F.transform("x", later))).alias("p"))
    la, lb = F.col("p.la"), F.col("p.lb")
    return p.groupBy(F.col("p.a").alias("run_a"), F.col("p.b").alias("run_b"), "model_alias").agg(
        F.count(F.lit(1)).alias("common"), F.count_if(la != lb).alias("changed"), F.count_if(lb > la).alias("up"), F.count_if(lb < la).alias("down"), F.count_if(la == lb).alias("unchanged"),
    )


def fill_by_run(predictions: DataFrame) -> DataFrame:
    """(run_id, field, rate)."""
    p = predictions.select("run_id", stored(F.col("fields_payload")).alias("p"))
    long = p.select("run_id", F.explode(statuses(F.col("p"))).alias("s"))
    return long.groupBy("run_id", F.col("s.field").alias("field")).agg(F.round(F.avg((F.col("s.status") == "present").cast("double")), 4).alias("rate"))


def metric_ranks(predictions: DataFrame) -> DataFrame:
    """(model_alias, metric, value, rank) over validity, latency, confidence and evidence coverage."""
    k = F.size(F.coalesce("evidence_spans", F.array().cast("array<struct<field:string,quote:string,start_char:int,end_char:int>>")))
    per = predictions.groupBy("model_alias").agg(
        F.avg(F.col("structured_valid").cast("double")).alias("valid_rate"), (-F.avg("latency_ms")).alias("speed"), F.avg("confidence").alias("confidence"),
        F.avg((k > 0).cast("double")).alias("evidence"),
    )
    long = per.select("model_alias", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 4).alias("value")) for m in ("valid_rate", "speed", "confidence", "evidence")])).alias("m"))
    flat = long.select("model_alias", "m.metric", "m.value")
    return flat.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("value"))))


def tokens_against_fill(last: DataFrame) -> DataFrame:
    """(model_alias, r): correlation of an answer's completion tokens with its number of present fields."""
    present = F.size(F.filter(F.map_values("status_snapshot"), lambda s: s == "present"))
    return last.groupBy("model_alias").agg(F.round(F.corr(_tokens("completion_tokens").cast("double"), present.cast("double")), 4).alias("r"))


def running_distribution(last: DataFrame, every: int = 10) -> DataFrame:
    """Counts of levels after every ``every`` documents of each model, in the order of doc_id. Documents
    are numbered by range over the cluster and counted per block; only blocks are summed up in order."""
    from lexmill.operators.corpus import numbered

    placed = numbered(last.select("model_alias", "doc_id", "maturity_level"), ["model_alias", "doc_id"], "__n")
    first = placed.groupBy("model_alias").agg(F.min("__n").alias("__first"))
    block = F.floor((F.col("__n") - F.col("__first")) / every).alias("__block")
    blocks = placed.join(first, "model_alias").groupBy("model_alias", block).agg(F.count(F.lit(1)).alias("__size"), *[F.count_if(F.col("maturity_level") == k).alias(f"__{k}") for k in LEVELS])
    w = Window.partitionBy("model_alias").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.select("model_alias", "__size", ((F.col("__block") + 1) * every).cast("int").alias("docs"), *[F.sum(f"__{k}").over(w).alias(f"level_{k}") for k in LEVELS])
    return sums.where(F.col("__size") == every).drop("__size")


def batch_delta(predictions: DataFrame) -> DataFrame:
    """(run_id, level_k deltas, confidence_delta) of each run against the run before it, by name."""
    per = predictions.groupBy("run_id").agg(*[F.count_if(F.col("maturity_level") == k).alias(f"level_{k}") for k in LEVELS], F.avg("confidence").alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("run_id")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    return per.select("run_id", *[d(f"level_{k}").alias(f"level_{k}") for k in LEVELS], F.round(d("c"), 4).alias("confidence_delta")).where(F.col("confidence_delta").isNotNull())


def grounding(last: DataFrame, dataset_base: DataFrame) -> DataFrame:
    """(model_alias, spans, verbatim, rate, long_quotes): evidence quotes that stand verbatim in the
    document's text, and those of more than 100 characters."""
    d = dataset_base.select("doc_id", "text")
    s = last.select("doc_id", "model_alias", F.explode("evidence_spans").alias("s")).join(d, "doc_id")
    ok = F.coalesce(F.contains("text", F.col("s.quote")) & (F.col("s.quote") != ""), F.lit(False))
    return s.groupBy("model_alias").agg(F.count(F.lit(1)).alias("spans"), F.count_if(ok).alias("verbatim"), ratio(F.count_if(ok), F.count(F.lit(1))).alias("rate"), F.count_if(F.length("s.quote") > 100).alias("long_quotes"))


def qa_trigger(golden: DataFrame, last: DataFrame, share: float = 0.1) -> DataFrame:
    """(guideline_version, n, disagree, rate, revise): reviewed gold rows whose level or deployment
    status a majority of models doesn't share, and whether they are too many."""
    g = golden.where(F.col("qa_status") == "done").groupBy("doc_id").agg(F.max(F.struct("guideline_version", "gold_fields_payload")).alias("g"))
    g = g.select("doc_id", F.col("g.guideline_version").alias("guideline_version"), stored(F.col("g.gold_fields_payload")).alias("gold"))
    m = majority(last).select("doc_id", "level")
    j = g.join(m, "doc_id")
    bad = F.count_if(F.col("gold.maturity_level") != F.col("level"))
    return j.groupBy("guideline_version").agg(F.count(F.lit(1)).alias("n"), bad.alias("disagree"), ratio(bad, F.count(F.lit(1))).alias("rate"), (bad / F.count(F.lit(1)) > share).alias("revise"))
