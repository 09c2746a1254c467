"""Captures of several sources collapsed to one best text per canonical address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import count_words, is_blank, normalize_year, strip, to_count
from lexmill.functions.url import base_domain, canonicalize_url, host_of, normalize_url
from lexmill.runtime import cut

# Phrases that mark a text as junk, each with its penalty, and the score of nothing.
JUNK = ("cookie", "subscribe", "sign in", "log in", "enable javascript", "access denied", "captcha")
JUNK_PENALTY = 200
WORDS, LENGTH = 300, 1000


def recount(df: DataFrame) -> DataFrame:
    """``df`` with word_count and text_len as whole numbers, counted anew where a text stands beside
    a count of 0 or none."""
    has = ~is_blank(F.col("text"))
    wc, tl = F.coalesce("word_count", F.lit(0)), F.coalesce("text_len", F.lit(0))
    return df.withColumns(
        {
            "word_count": F.when(has & (wc == 0), count_words(F.col("text")).cast("int")).otherwise(wc.cast("int")),
            "text_len": F.when(has & (tl == 0), F.length("text")).otherwise(tl.cast("int")),
        }
    )


def is_good(word_count: Column, text_len: Column) -> Column:
    """Whether a text is long enough to be kept."""
    return F.coalesce((word_count >= WORDS) & (text_len >= LENGTH), F.lit(False))


def quality_score(word_count: Column, text_len: Column, title: Column, text: Column) -> Column:
    """Longer is better, a real title adds, junk phrases near the start subtract; a row without text
    and counts scores -1e9."""
    wc, tl, t = F.coalesce(word_count, F.lit(0)), F.coalesce(text_len, F.lit(0)), F.coalesce(text, F.lit(""))
    head = F.lower(F.substring(t, 1, 1200))
    junk = sum([F.when(F.contains(head, F.lit(p)), JUNK_PENALTY).otherwise(0) for p in JUNK[1:]], F.when(F.contains(head, F.lit(JUNK[0])), JUNK_PENALTY).otherwise(0))
    bonus = F.when(F.length(F.coalesce(title, F.lit(""))) >= 8, 50).otherwise(0)
    return F.when((t == "") & (wc == 0) & (tl == 0), -1e9).otherwise(wc.cast("double") + tl / 200.0 + bonus - junk)


def source_rank(source: Column, method: Column) -> Column:
    """Order of preference of sources, the best first."""
    m = F.coalesce(method, F.lit(""))
    medium = F.when(F.contains(m, F.lit("amp")), 1).when(F.contains(m, F.lit("json")), 2).otherwise(3)
    return F.when(source == "http", 0).when(source == "medium", medium).when(source == "a2", 4).otherwise(9)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def scored(captures: DataFrame) -> DataFrame:
    """``captures`` recounted, with canonical address, good, qscore, srank and text_sha1."""
    c = recount(captures).withColumn("url_canonical", canonicalize_url(F.coalesce("url_canonical", "url_original", F.lit(""))))
    return c.withColumns(
        {
            "good": is_good(F.col("word_count"), F.col("text_len")),
            "qscore": quality_score(F.col("word_count"), F.col("text_len"), F.col("title"), F.col("text")),
            "srank": source_rank(F.col("source"), F.col("extraction_method")),
            "text_sha1": F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")),
        }
    )


def best_keys(captures: DataFrame) -> DataFrame:
    """The best capture of each canonical address without its text and flags: good before not, then
    quality, source, words, length, and at last the earlier capture_id. Combined before the shuffle;
    texts are only read."""
    order = [F.col("good"), F.col("qscore"), -F.col("srank"), F.col("word_count"), F.col("text_len"), -F.col("capture_id")]
    s = scored(captures)
    kept = F.struct(*[c for c in s.columns if c not in ("url_canonical", "text", "flags")])
    return s.groupBy("url_canonical").agg(F.max_by(kept, F.struct(*order)).alias("__best")).select("url_canonical", "__best.*")


def best_per_url(captures: DataFrame) -> DataFrame:
    """best_keys with text and flags, which are fetched by capture_id for the captures that won; of rows
    that share a capture_id one is taken."""
    heavy = captures.select("capture_id", *[c for c in ("text", "flags") if c in captures.columns])
    return best_keys(captures).join(heavy, "capture_id").dropDuplicates(["capture_id"])


def rejects(captures: DataFrame) -> DataFrame:
    """(capture_id, url_canonical, reason) of the rows a document base doesn't take: no text, a blank
    one, or a later row of an address whose first usable row was taken. Good or not doesn't matter."""
    c = captures.select("capture_id", canonicalize_url(F.coalesce("url_canonical", F.lit(""))).alias("url_canonical"), "text")
    state = c.withColumn("__state", F.when(F.col("text").isNull(), "text_file_not_found").when(is_blank(F.col("text")), "text_is_empty").otherwise("usable")).drop("text")
    w = Window.partitionBy("url_canonical", "__state").orderBy("capture_id")
    reason = F.when(F.col("__state") != "usable", F.col("__state")).when(F.row_number().over(w) > 1, "duplicate_url_canonical")
    return state.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__state")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in a total order. Rows are sorted by range over the
    cluster; only the sizes of the parts, not the rows, meet to give each part its first number."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = cut(parted.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(F.broadcast(first.select("__part", "__first")), "__part")
    return joined.withColumn(name, F.col("__first") + F.col("__at") + 1).drop("__id", "__part", "__at", "__first")


def dataset_base(best: DataFrame) -> DataFrame:
    """Good rows numbered DOC000001 and on by address and title (nulls last): the document base."""
    rows = best.where("good").select("url_canonical", "title", "word_count", "text_len", *[c for c in ("text", "company", "industry", "year") if c in best.columns])
    placed = numbered(rows, ["url_canonical", F.asc_nulls_last("title"), "text_len"], "__number")
    return placed.withColumn("doc_id", F.format_string("DOC%06d", "__number")).drop("__number")


def best_http(rows: DataFrame) -> DataFrame:
    """The HTTP row of each address with most words, then characters."""
    w = Window.partitionBy("url").orderBy(F.desc("word_count"), F.desc("text_len"))
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def is_medium_backed(url: Column) -> Column:
    """Whether the address belongs to the platform, or its path ends as the platform's do."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(strip(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return (host == "medium.com") | path.rlike(r"(?i)-[0-9a-f]{10,14}$")


def is_medium_like(url: Column) -> Column:
    """Whether the host is the platform's or one of the domains it serves."""
    h = host_of(url)
    return F.contains(h, F.lit("medium.com")) | F.endswith(h, F.lit("towardsdatascience.com")) | F.endswith(h, F.lit("betterprogramming.pub")) | F.endswith(h, F.lit("levelup.gitconnected.com"))


def is_youtube(url: Column) -> Column:
    """Whether the address is, or holds, one of the video site's."""
    u = F.lower(strip(F.coalesce(url, F.lit(""))))
    return F.contains(u, F.lit("youtube.com")) | F.contains(u, F.lit("youtu.be"))


def routed(captures: DataFrame) -> DataFrame:
    """Rows that aren't good with the bucket they are fetched by next: medium or a2."""
    s = scored(captures).where(~F.col("good"))
    return s.select("capture_id", "url_canonical", base_domain(F.col("url_canonical")).alias("base_domain"), F.when(is_medium_backed(F.col("url_canonical")), "medium").otherwise("a2").alias("bucket"))


def clean_metadata(df: DataFrame) -> DataFrame:
    """company, industry and title trimmed with nulls as '', year without '.0'."""
    t = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    return df.withColumns({"company": t("company"), "industry": t("industry"), "title": t("title"), "year": normalize_year(F.col("year"))})


def http_good(status: Column, word_count: Column, text_len: Column) -> Column:
    """Whether a fetched page was answered with 200 and its text is long enough."""
    return F.coalesce(status == 200, F.lit(False)) & is_good(word_count, text_len)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that ``df`` has; where it is null, the next. None of them is null."""
    there = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def flags_json(df: DataFrame, column: str = "flags") -> Column:
    """Flags as JSON text: maps and structs are written, text that isn't blank is passed on, the rest is {}."""
    kind = dict(df.dtypes).get(column)
    if kind is None:
        return F.lit("{}")
    if kind == "string":
        return F.when(is_blank(F.col(column)), F.lit("{}")).otherwise(F.col(column))
    return F.coalesce(F.to_json(column), F.lit("{}"))


def with_paths(best: DataFrame, exported: DataFrame) -> DataFrame:
    """``best`` with the path each page was exported to, '' for none, and whether the page is unresolved:
    not good, or without a path. A page that was exported twice has its least path."""
    paths = exported.groupBy("url_canonical").agg(F.min("text_path").alias("text_path"))
    joined = best.join(paths, "url_canonical", "left").withColumn("text_path", F.coalesce("text_path", F.lit("")))
    return joined.withColumn("unresolved", ~F.col("good") | (F.col("text_path") == ""))


def error_rows(captures: DataFrame) -> DataFrame:
    """(capture_id, url, error) of the captures that failed, as the error file lists them."""
    return captures.where(F.coalesce("error", F.lit("")) != "").select("capture_id", first_of(captures, "url_original", "url_canonical").alias("url"), "error")


def stage_report(stage: str, df: DataFrame, bucket: Column) -> DataFrame:
    """(stage, bucket, n): rows of a stage's result by bucket, nulls as ''."""
    return df.groupBy(F.coalesce(bucket.cast("string"), F.lit("")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "bucket", "n")


def bucket(rows: DataFrame) -> DataFrame:
    """A bucket of fetched pages, one row an address: addresses in normal form, counts as whole numbers
    (0 for what isn't one), null texts as ''. The row with most words stays, then most characters, then
    the greatest text. Columns a bucket lacks count as missing."""
    there = lambda c, otherwise: F.col(c) if c in rows.columns else F.lit(otherwise)
    shaped = rows.select(
        normalize_url(F.col("url")).alias("url_norm"),
        *[to_count(there(c, 0).cast("string")).alias(c) for c in ("status_code", "word_count", "text_len")],
        F.coalesce(there("text", "").cast("string"), F.lit("")).alias("text"),
    )
    best = shaped.groupBy("url_norm").agg(F.max(F.struct("word_count", "text_len", "text", "status_code")).alias("b"))
    named = best.select("url_norm", "b.word_count", "b.text_len", "b.text", "b.status_code")
    return named.withColumns({"base_domain": base_domain(F.col("url_norm")), "is_medium_candidate": is_medium_backed(F.col("url_norm"))})
