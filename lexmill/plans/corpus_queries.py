"""Queries on the corpus: quality, duplicates, addresses, the document base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.html import block_flags, error_class, login_flags
from lexmill.functions.text import RE2_SPACE, count_words, safe_slug, sha1_text
from lexmill.functions.url import TRACKING_KEYS, base_domain, canonicalize_url, host_of, normalize_url
from lexmill.operators import corpus
from lexmill.runtime import read

WORDS_SQL = rf"coalesce(len(regexp_extract_all(text, '[^{RE2_SPACE}]+')), 0)"
STRIP = lambda c: rf"regexp_replace({c}, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"
HOST_SQL = lambda c: f"lower(regexp_extract({STRIP(f'coalesce({c}, {chr(39)*2})')}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
CANON_SQL = lambda c: f"""(SELECT CASE WHEN q = '' THEN b ELSE b || '?' || q END FROM (
    SELECT lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:')) || substr(regexp_extract(u, '^[^?]*'), length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:')) + 1) AS b,
           array_to_string([x for x in string_split(regexp_extract(u, '\\?(.*)$', 1), '&') if x <> '' AND regexp_extract(x, '^[^=]*') NOT IN ({_KEYS})], '&') AS q
    FROM (SELECT regexp_replace({STRIP(c)}, '#.*$', '') AS u)))"""  # noqa: E731


def q_good_by_source(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "documents").select(
        F.coalesce("source", F.lit("")).alias("source"), count_words(F.col("text")).alias("w"), F.coalesce(F.length("text"), F.lit(0)).alias("n")
    )
    good = F.count_if(corpus.is_good(F.col("w"), F.col("n")))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), good.alias("good"), F.round(good / F.count(F.lit(1)), 4).alias("good_share"))


def q_dedup_text(spark: SparkSession, root: str) -> DataFrame:
    d = read(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", sha1_text(F.trim("text")).alias("text_sha1"), count_words(F.col("text")).alias("words"))
    best = F.max(F.struct("words", (-F.col("doc_id")).alias("back")))
    return d.groupBy("text_sha1").agg(best.alias("b"), F.count(F.lit(1)).alias("copies")).select("text_sha1", (-F.col("b.back")).alias("doc_id"), F.col("b.words").cast("bigint").alias("words"), "copies")


def q_canonical_urls(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "captures").select("capture_id", canonicalize_url(F.col("url_original")).alias("url"))


def q_url_features(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url_original")
    return read(spark, root, "captures").select(
        "capture_id",
        normalize_url(u).alias("normal"),
        host_of(u).alias("host"),
        base_domain(u).alias("base_domain"),
        corpus.is_medium_backed(u).alias("medium_backed"),
        corpus.is_medium_like(u).alias("medium_like"),
        corpus.is_youtube(u).alias("youtube"),
        safe_slug(F.col("title"), 40).alias("slug"),
    )


def q_quality(spark: SparkSession, root: str) -> DataFrame:
    return corpus.scored(read(spark, root, "captures")).select("capture_id", "word_count", "text_len", "good", F.round("qscore", 4).alias("qscore"), "srank", "text_sha1")


def q_best_per_url(spark: SparkSession, root: str) -> DataFrame:
    return corpus.best_keys(read(spark, root, "captures")).select("url_canonical", "capture_id", "good", "srank", F.round("qscore", 4).alias("qscore"))


def q_page_rejects(spark: SparkSession, root: str) -> DataFrame:
    return corpus.rejects(read(spark, root, "captures"))


def q_bucket_route(spark: SparkSession, root: str) -> DataFrame:
    return corpus.routed(read(spark, root, "captures")).groupBy("bucket", "base_domain").agg(F.count(F.lit(1)).alias("n"))


def q_block_flags(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "captures")
    f, g = block_flags(F.col("text"), F.col("text")), login_flags(F.col("text"))
    return c.select("capture_id", f["paywalled"].alias("paywalled"), f["blocked"].alias("blocked"), g["blocked"].alias("blocked_general"), g["login_required"].alias("login_required"))


def q_error_class(spark: SparkSession, root: str) -> DataFrame:
    c = corpus.recount(read(spark, root, "captures"))
    flag = lambda k: F.coalesce(F.element_at("flags", k), F.lit(False))
    kind = error_class(F.col("source"), F.col("text"), F.col("word_count"), F.col("text_len"), flag("blocked"), flag("paywalled"))
    return c.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(kind, F.lit("ok")).alias("kind")).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_doc_numbering(spark: SparkSession, root: str) -> DataFrame:
    return corpus.dataset_base(corpus.best_keys(read(spark, root, "captures"))).select("doc_id", "url_canonical", "word_count", "text_len")


def q_union_sources(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "captures").select(F.col("url_canonical").alias("url"), "domain", "title", "word_count", F.lit("capture").alias("origin"))
    b = read(spark, root, "dataset_base").select(F.col("url_canonical").alias("url"), "company", "title", "word_count", F.lit("base").alias("origin"))
    u = corpus.union_sources(c, b)
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("domain").alias("domains"), F.count("company").alias("companies"), F.sum("word_count").alias("words"))


def q_http_best(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "captures").where(F.col("source") == "http").select(F.col("url_original").alias("url"), "word_count", "text_len")
    best = corpus.best_http(rows.select("url", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("text_len", F.lit(0)).alias("text_len")))
    base = read(spark, root, "dataset_base").select("doc_id", normalize_url(F.col("url_canonical")).alias("url"))
    return base.join(best, "url", "left").select("doc_id", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("text_len", F.lit(0)).alias("text_len"))


def q_base_duplicates(spark: SparkSession, root: str) -> DataFrame:
    c = read(spark, root, "captures")
    n, distinct = F.count(F.lit(1)), F.count_distinct(canonicalize_url(F.col("url_canonical")))
    return c.agg(n.alias("n"), distinct.alias("pages"), (n - distinct).alias("duplicates"))


def q_clean_metadata(spark: SparkSession, root: str) -> DataFrame:
    return corpus.clean_metadata(read(spark, root, "dataset_base")).select("doc_id", "company", "industry", "year", "title")


def q_list_order_all(spark: SparkSession, root: str) -> DataFrame:
    """The documents of a list in the list's order, all of them: here of the golden test split by id."""
    golden = read(spark, root, "golden").where(F.lower(F.trim("split")) == "test").select("doc_id").distinct()
    listed = golden.join(read(spark, root, "dataset_base").select("doc_id", "title"), "doc_id")
    return corpus.numbered(listed, ["doc_id"], "position").select("doc_id", F.col("position").cast("int").alias("position")).orderBy("position")


def q_list_order(spark: SparkSession, root: str) -> DataFrame:
    """The first documents of q_list_order_all, by the optional limit on their number."""
    return q_list_order_all(spark, root).limit(50)


QUERIES = {f.__name__: f for f in (
    q_good_by_source, q_dedup_text, q_canonical_urls, q_url_features, q_quality, q_best_per_url, q_page_rejects, q_bucket_route, q_block_flags,
    q_error_class, q_doc_numbering, q_union_sources, q_http_best, q_base_duplicates, q_clean_metadata, q_list_order, q_list_order_all,
)}

_JUNK = " + ".join(f"CASE WHEN contains(lower(substr(coalesce(text, ''), 1, 1200)), '{p}') THEN {corpus.JUNK_PENALTY} ELSE 0 END" for p in corpus.JUNK)
_BLANK = rf"(text IS NULL OR NOT regexp_matches(text, '[^{RE2_SPACE}]'))"
SCORED_SQL = f"""
r AS (
  SELECT *, CASE WHEN NOT {_BLANK} AND coalesce(word_count, 0) = 0 THEN {WORDS_SQL} ELSE coalesce(word_count, 0) END AS wc,
         CASE WHEN NOT {_BLANK} AND coalesce(text_len, 0) = 0 THEN length(text) ELSE coalesce(text_len, 0) END AS tl,
         {CANON_SQL("coalesce(url_canonical, url_original, '')")} AS url
  FROM captures),
s AS (
  SELECT *, wc >= {corpus.WORDS} AND tl >= {corpus.LENGTH} AS good,
         CASE WHEN coalesce(text, '') = '' AND wc = 0 AND tl = 0 THEN -1e9
              ELSE CAST(wc AS DOUBLE) + tl / 200.0 + CASE WHEN length(coalesce(title, '')) >= 8 THEN 50 ELSE 0 END - ({_JUNK}) END AS qscore,
         CASE WHEN source = 'http' THEN 0
              WHEN source = 'medium' THEN CASE WHEN contains(coalesce(extraction_method, ''), 'amp') THEN 1 WHEN contains(coalesce(extraction_method, ''), 'json') THEN 2 ELSE 3 END
              WHEN source = 'a2' THEN 4 ELSE 9 END AS srank
  FROM r)"""
_BEST = SCORED_SQL + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY good DESC, qscore DESC, srank, wc DESC, tl DESC, capture_id) AS rn FROM s) WHERE rn = 1)"""
_any = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_T = "lower(substr(coalesce(text, ''), 1, 2000))"
_H = "lower(substr(coalesce(text, ''), 1, 12000))"
_H2 = "lower(substr(coalesce(text, ''), 1, 20000))"
# The phrases of functions/html.py as the SQL has them; both change together.
_PAY = ["member-only", "members-only", "this story is for members", "become a member", "to continue reading", "get unlimited access"]
_BLOCK = ["unusual traffic", "verify you are a human", "cf-chl", "cloudflare", "captcha", "access denied", "temporarily unavailable"]
_LOGIN = ["sign in", "log in", "login", "join linkedin", "authwall", "create an account"]
_NORMAL = lambda c: f"CASE WHEN {STRIP(c)} = '' THEN '' WHEN regexp_matches({STRIP(c)}, '^[a-zA-Z][a-zA-Z0-9+\\-.]*://') THEN {STRIP(c)} ELSE 'https://' || {STRIP(c)} END"
_HOST = HOST_SQL("url_original")
_BASE = lambda h: f"regexp_extract(regexp_replace({h}, ':\\d+$', ''), '([^.]+\\.[^.]+|[^.]+)\\.?$', 1)"
_SLUG = (
    rf"trim(regexp_replace(regexp_replace({STRIP(chr(39).join(['coalesce(title, ', '', ')']))}, '[{RE2_SPACE}]+', ' ', 'g'), '[^a-zA-Z0-9\-_. ]+', '', 'g'))"
)
ORACLE = {
    "q_good_by_source": f"""
SELECT coalesce(source, '') AS source, count(*) AS docs,
       count(*) FILTER ({WORDS_SQL} >= 300 AND coalesce(length(text), 0) >= 1000) AS good,
       round(count(*) FILTER ({WORDS_SQL} >= 300 AND coalesce(length(text), 0) >= 1000) / count(*), 4) AS good_share
FROM documents GROUP BY 1""",
    "q_dedup_text": f"""
SELECT text_sha1, doc_id, words, copies FROM (
  SELECT sha1(trim(text, ' ')) AS text_sha1, doc_id, {WORDS_SQL} AS words, count(*) OVER (PARTITION BY sha1(trim(text, ' '))) AS copies,
         row_number() OVER (PARTITION BY sha1(trim(text, ' ')) ORDER BY {WORDS_SQL} DESC, doc_id) AS rn
  FROM documents WHERE text IS NOT NULL) WHERE rn = 1""",
    "q_canonical_urls": f"SELECT capture_id, {CANON_SQL('url_original')} AS url FROM captures",
    "q_url_features": f"""
SELECT capture_id, {_NORMAL('url_original')} AS normal, {_HOST} AS host, {_BASE(_HOST)} AS base_domain,
       regexp_replace({_HOST}, '^www\\.', '') = 'medium.com'
         OR regexp_matches(regexp_replace(regexp_extract({STRIP('url_original')}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '(?i)-[0-9a-f]{{10,14}}$') AS medium_backed,
       contains({_HOST}, 'medium.com') OR ends_with({_HOST}, 'towardsdatascience.com') OR ends_with({_HOST}, 'betterprogramming.pub')
         OR ends_with({_HOST}, 'levelup.gitconnected.com') AS medium_like,
       contains(lower({STRIP('url_original')}), 'youtube.com') OR contains(lower({STRIP('url_original')}), 'youtu.be') AS youtube,
       CASE WHEN trim(substr(replace({_SLUG}, ' ', '_'), 1, 40), '_') = '' THEN 'doc' ELSE trim(substr(replace({_SLUG}, ' ', '_'), 1, 40), '_') END AS slug
FROM captures""",
    "q_quality": "WITH " + SCORED_SQL + """
SELECT capture_id, CAST(wc AS INTEGER) AS word_count, CAST(tl AS INTEGER) AS text_len, good, round(qscore, 4) AS qscore, CAST(srank AS INTEGER) AS srank, sha1(coalesce(text, '')) AS text_sha1 FROM s""",
    "q_best_per_url": "WITH " + _BEST + "SELECT url AS url_canonical, capture_id, good, CAST(srank AS INTEGER) AS srank, round(qscore, 4) AS qscore FROM b",
    "q_page_rejects": f"""
WITH c AS (SELECT capture_id, {CANON_SQL("coalesce(url_canonical, '')")} AS url_canonical,
                  CASE WHEN text IS NULL THEN 'text_file_not_found' WHEN {_BLANK} THEN 'text_is_empty' ELSE 'usable' END AS state FROM captures),
d AS (SELECT *, row_number() OVER (PARTITION BY url_canonical, state ORDER BY capture_id) AS rn FROM c)
SELECT capture_id, url_canonical, CASE WHEN state <> 'usable' THEN state ELSE 'duplicate_url_canonical' END AS reason FROM d WHERE state <> 'usable' OR rn > 1""",
    "q_bucket_route": "WITH " + SCORED_SQL + f""", h AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host FROM s WHERE NOT good)
SELECT CASE WHEN regexp_replace(host, '^www\\.', '') = 'medium.com'
              OR regexp_matches(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '(?i)-[0-9a-f]{{10,14}}$')
            THEN 'medium' ELSE 'a2' END AS bucket, {_BASE('host')} AS base_domain, count(*) AS n FROM h GROUP BY 1, 2""",
    "q_block_flags": f"""
SELECT capture_id, {_any(f"{_T} || ' ' || {_H}", _PAY)} AS paywalled, {_any(_H, _BLOCK)} AS blocked, {_any(_H2, [w for w in _BLOCK if w != "temporarily unavailable"])} AS blocked_general,
       {_any(_H2, _LOGIN)} AS login_required FROM captures""",
    "q_error_class": "WITH " + SCORED_SQL + f""", k AS (
  SELECT coalesce(source, '') AS source, CASE
    WHEN source = 'medium' AND coalesce(flags['blocked'], false) THEN 'blocked'
    WHEN source = 'medium' AND coalesce(flags['paywalled'], false) THEN 'paywalled'
    WHEN {_BLANK} THEN 'no_text'
    WHEN source = 'medium' AND (wc < 250 OR tl < 1000) THEN 'too_short'
    WHEN source IS DISTINCT FROM 'medium' AND (wc < 300 OR tl < 1000) THEN 'too_short' ELSE 'ok' END AS kind FROM s)
SELECT source, kind, count(*) AS n FROM k GROUP BY 1, 2""",
    "q_doc_numbering": "WITH " + _BEST + """
SELECT 'DOC' || lpad(CAST(row_number() OVER (ORDER BY url, title NULLS LAST, tl) AS VARCHAR), 6, '0') AS doc_id, url AS url_canonical, CAST(wc AS INTEGER) AS word_count, CAST(tl AS INTEGER) AS text_len
FROM b WHERE good""",
    "q_union_sources": """
SELECT 'capture' AS origin, count(*) AS n, count(domain) AS domains, CAST(0 AS BIGINT) AS companies, CAST(sum(word_count) AS BIGINT) AS words FROM captures
UNION ALL SELECT 'base', count(*), 0, count(company), CAST(sum(word_count) AS BIGINT) FROM dataset_base""",
    "q_http_best": f"""
WITH h AS (SELECT url_original AS url, coalesce(word_count, 0) AS word_count, coalesce(text_len, 0) AS text_len FROM captures WHERE source = 'http'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY word_count DESC, text_len DESC) AS rn FROM h) WHERE rn = 1),
d AS (SELECT doc_id, {_NORMAL('url_canonical')} AS url FROM dataset_base)
SELECT doc_id, coalesce(word_count, 0) AS word_count, coalesce(text_len, 0) AS text_len FROM d LEFT JOIN b USING (url)""",
    "q_base_duplicates": f"SELECT count(*) AS n, count(DISTINCT {CANON_SQL('url_canonical')}) AS pages, count(*) - count(DISTINCT {CANON_SQL('url_canonical')}) AS duplicates FROM captures",
    "q_clean_metadata": f"""
SELECT doc_id, {STRIP("coalesce(company, '')")} AS company, {STRIP("coalesce(industry, '')")} AS industry, regexp_replace({STRIP("coalesce(year, '')")}, '\\.0$', '') AS year,
       {STRIP("coalesce(title, '')")} AS title FROM dataset_base""",
    "q_list_order": """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS position FROM (SELECT DISTINCT g.doc_id FROM golden g JOIN dataset_base USING (doc_id) WHERE lower(trim(g.split)) = 'test')
ORDER BY position LIMIT 50""",
    "q_list_order_all": """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS position FROM (SELECT DISTINCT g.doc_id FROM golden g JOIN dataset_base USING (doc_id) WHERE lower(trim(g.split)) = 'test')
ORDER BY position""",
}
