"""Values cut off before they are finished, and how often each source cuts.

A value without terminal punctuation is unfinished: open (a sentence or structure stops inside, or a
mark of a cut ends it) or loose (a closing line, list item or signature that needs no full stop, so
that the ending alone can't tell). Two things cut values, and each leaves its own trace:

* a limit of a field or of a model's output stops many values at one length. The histograms of the
  unfinished values' lengths, in characters and in bytes, per source and for the whole column, are
  tested for spikes; every unfinished value at a spike's length is cut, open or loose (``limit``).
  Lengths a mark is added to (480 and "…") are spikes of their own;
* a broken transfer stops a value anywhere and leaves no spike; what shows it is an open ending
  (``transfer``).

Only lengths, sources and small class codes are shuffled, never the texts, and of those only the
unfinished values'.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.url import page_key
from lexmill.runtime import cut, spread

COMPLETE, LOOSE, OPEN = 0, 1, 2
UNITS = ("chars", "bytes")

_MARK = regex.compile(
    r"(?:…|\.\.\.|�|\[(?:\.\.\.|…)\]|[\[(<]\W{0,2}(?:cut|truncated|trunc|snip|continued|more|gekürzt|tronqué|cortado|обрезано)\b\W{0,3}[\])>])\s*$", regex.I
)
_TERMINAL = regex.compile(r"[.!?。！？؟][\"'”’»›“)\]\s]*$")
_CLOSED = regex.compile(r"[\"”»“)\]]\s*$")
_EMOJI = regex.compile(r"[\p{So}\p{Emoji_Presentation}]️?\s*$")
_URL = regex.compile(r"^\W*(?:https?://|www\.)\S+$")
_BULLET = regex.compile(r"^\s*(?:[-*•–·▪]|\d{1,3}[.)]|[a-z]\))\s+\S")
_LABEL = regex.compile(
    r"^\s*(?:next up|next|sources?|appendix|annex|references?|further reading|see also|related|contact|tags|keywords|notes?|credits|filed under|quellen?|anhang"
    r"|fuentes?|anexo|annexe|источник\p{L}*|приложение)\b[^:.!?]{0,12}:\s+\S",
    regex.I,
)
_SIGNED = regex.compile(r"^\s*[—–-]{1,2}\s+\p{L}")
_RULE = regex.compile(r"^\s*(?:\*\s?\*\s?\*|-\s?-\s?-|_{3,}|#{1,3}|={3,})")
_PLACED = regex.compile(r"^\s*[\p{L}’' .\-]{2,40},\s+(?:\d{1,2}\.?\s+)?\p{Lu}\p{L}+(?:\s+\d{4})?\s*$")
_MONTHS = regex.compile(
    r"(?:january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember"
    r"|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre"
    r"|octubre|noviembre|diciembre|январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)\p{L}*(?:\s+\d{4})?\s*$",
    regex.I,
)
_THANKS = regex.compile(r"^\s*(?:thanks|thank you|danke|merci|gracias|спасибо)\b", regex.I)


def prose_ending(text: str | None) -> int:
    """Class of a text's ending. Null and blank texts are complete: nothing of them is missing."""
    if not text:
        return COMPLETE
    body = text.rstrip()
    if not body:
        return COMPLETE
    if _MARK.search(body[-60:]):
        return OPEN
    line = body[body.rfind("\n") + 1 :]
    if _RULE.match(line):
        return LOOSE if regex.search(r"\w", line) else COMPLETE
    if _TERMINAL.search(line[-12:]):
        return COMPLETE
    if _EMOJI.search(line[-4:]) or _URL.match(line):
        return LOOSE
    if line[-1] in ",;:–—-([„«“":
        return OPEN
    if line.lstrip()[:1] == "(" and line.endswith(")"):
        return LOOSE
    alone = "\n" in body and len(line) < 110
    if alone and (_BULLET.match(line) or _SIGNED.match(line) or _LABEL.match(line) or _THANKS.match(line)):
        return LOOSE
    if alone and _PLACED.match(line) and _MONTHS.search(line):
        return LOOSE
    return OPEN


_DOUBLE = regex.compile(r'"(?:[^"\\]|\\.)*+"', regex.S)
_SINGLE = regex.compile(r"(?<=[{\[,:]\s*)'(?:[^\\]|\\.)*?'(?=\s*[,:}\]])", regex.S)
_THINK = regex.compile(r"<think>.*?</think>", regex.S | regex.I)
_REFUSED = regex.compile(r"^\W*(?:n/?a|no(?: data| answer| information| evidence)?|none|null|nothing|unknown|not (?:applicable|available|found)|keine (?:angabe|daten)|aucune? \w+|sin datos|нет данных)\b", regex.I)
_LEAD = regex.compile(r"^\s*(?:here\s+is|here's|sure|certainly|below is)\b[^{}]*$", regex.I)


def answer_ending(raw: str | None) -> int:
    """Class of a model answer's ending. Null, blank, refused and malformed but closed answers are
    complete; open is an unclosed structure, fence or thought, or unfinished prose after it."""
    if not raw:
        return COMPLETE
    body = raw.strip()
    if not body:
        return COMPLETE
    if body[0] == "{":
        try:
            json.loads(body)
            return COMPLETE
        except (ValueError, RecursionError):
            pass
    if _MARK.search(body[-40:]):
        return OPEN
    rest = _THINK.sub("", body).lstrip()
    if rest[:7].lower() == "<think>":
        return OPEN
    if body.lower().startswith("<think>") and not rest:
        return OPEN
    if "<think>".startswith(rest.lower()) and len(rest) > 1:
        return OPEN
    fenced = rest.count("```") % 2 == 1
    at = rest.find("{")
    if at < 0:
        if fenced or _LEAD.match(rest) and rest.rstrip()[-1] in ":,":
            return OPEN
        if _LEAD.match(rest):
            return LOOSE if _TERMINAL.search(rest[-12:]) else OPEN
        return COMPLETE if _TERMINAL.search(rest[-12:]) or _REFUSED.match(rest) else LOOSE
    end = _structure_end(rest[at:])
    if end is None:
        return OPEN
    tail = rest[at + end :].strip()
    if not tail:
        return OPEN if fenced else COMPLETE
    after = tail.removeprefix("```").strip() if fenced or tail.startswith("```") else tail
    if fenced and not tail.startswith("```"):
        return OPEN
    if rest.count("```") % 2 == 1:
        return OPEN
    if not regex.search(r"\w", after):
        return OPEN if "`" in after and not after.startswith("```") else COMPLETE
    if "{" in after or "}" in after:
        return COMPLETE
    return COMPLETE if _TERMINAL.search(after[-12:]) or after.endswith("```") else OPEN


def _structure_end(text: str) -> int | None:
    """Where the object that begins the text closes, None if it never does. Strings are skipped; an
    object whose brackets don't match is closed if its last character closes one and as many
    brackets close as open but one."""
    blank = lambda m: "s" * len(m.group())
    single = text[1:].lstrip().startswith("'")
    bare = (_SINGLE if single else _DOUBLE).sub(blank, text)
    depth = 0
    for m in regex.finditer(r"[{}\[\]]", bare):
        depth += 1 if m.group() in "{[" else -1
        if depth == 0:
            return m.end()
    quotes = text.count("'" if single else '"') - text.count("\\'" if single else '\\"')
    last = max(bare.rfind("}"), 0)
    tail = text[last + 1 :].strip()
    if last and not tail.strip("`").strip() and quotes % 2 == 0 and depth == 1 and regex.search(r"[}\]]\s*\}$", bare[: last + 1]) and "confidence" in text:
        return last + 1  # a bracket is missing inside, the end is there
    return None


def _classed(rows: DataFrame, kind: Callable[[str | None], int]) -> DataFrame:
    """rows of (row_key, source, value) as (row_key, source, chars, bytes, ending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pa.array([kind(v) for v in batch.column(4).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ends], names=["row_key", "source", "chars", "bytes", "ending"])

    sized = rows.select("row_key", "source", F.length("value").alias("chars"), F.octet_length("value").alias("bytes"), "value")
    return sized.mapInArrow(run, "row_key string, source string, chars int, bytes int, ending int")


def length_spikes(classed: DataFrame, reach: int = 20, least: int = 4, chance: float = 0.01) -> DataFrame:
    """(source, unit, length, n, around, most): lengths at least ``least`` unfinished values have, and
    more than the ``reach`` lengths on either side explain: by Chernoff's bound of a Poisson count with
    their mean ``around``, a histogram without a limit has such a length with at most ``chance``, over
    all its lengths together. ``most`` is the greatest length of the source's unfinished values. The source '' stands for
    the whole column. Null values have no length; an empty table no spikes."""
    both = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS]))
    open_ended = classed.where((F.col("ending") != COMPLETE) & (F.col("chars") > 0))
    per = open_ended.select("source", both.alias("u")).groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("unit", "length").agg(F.sum("n").alias("n")).select(F.lit("").alias("source"), "unit", "length", "n")
    lengths = per.where(F.col("source") != "").unionByName(whole)
    # a source's histogram has at most as many bins as there are lengths, so the window stays small
    by = Window.partitionBy("source", "unit")
    w = by.orderBy("length").rangeBetween(-reach, reach)
    around = (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * reach)
    seen = lengths.withColumns({"around": around, "most": F.max("length").over(by), "bins": F.count(F.lit(1)).over(by)})
    mean = F.greatest(F.col("around"), F.lit(0.5 / reach))  # one value in both sides is the least that is known of them
    tail = F.col("n") - mean + F.col("n") * F.log(mean / F.col("n"))
    return seen.where((F.col("n") >= least) & (F.col("n") > mean) & (tail < F.log(F.lit(chance) / F.col("bins")))).drop("bins")


def _sources(dataset_base: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    host = F.regexp_extract(page_key(F.col("url_canonical")), r"^[^/?]*", 0)
    texts = dataset_base.select(F.col("doc_id").cast("string").alias("row_key"), F.coalesce(host, F.lit("")).alias("source"), F.col("text").alias("value"))
    answers = predictions.select(
        F.col("prediction_id").cast("string").alias("row_key"), F.coalesce("model_alias", F.lit("")).alias("source"), F.col("raw_response").alias("value")
    )
    return texts, answers


def judged(rows: DataFrame, kind: Callable[[str | None], int]) -> DataFrame:
    """rows of (row_key, source, value) as (row_key, source, by): what cut the value, ``limit`` or
    ``transfer``, null for one that isn't cut."""
    classed = cut(_classed(spread(rows), kind)).withColumn("__row", F.monotonically_increasing_id())  # small: keys, lengths and classes, made once
    marks = length_spikes(classed).select("source", "unit", "length").distinct()
    unfinished = classed.where(F.col("ending") != COMPLETE)
    keys = F.explode(F.array(*[F.struct(s.alias("source"), F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS for s in (F.lit(""), F.col("source"))]))
    stopped = unfinished.select("__row", keys.alias("k")).select("__row", "k.*").join(marks, ["source", "unit", "length"], "left_semi").select("__row").distinct()
    by = F.when(F.col("hit"), F.lit("limit")).when(F.col("ending") == OPEN, F.lit("transfer"))
    flagged = unfinished.join(stopped.withColumn("hit", F.lit(True)), "__row", "left").select("row_key", "source", by.alias("by"))
    return classed.where(F.col("ending") == COMPLETE).select("row_key", "source", F.lit(None).cast("string").alias("by")).unionByName(flagged)


def _each(dataset_base: DataFrame, predictions: DataFrame) -> Iterator[tuple[str, DataFrame, Callable[[str | None], int]]]:
    texts, answers = _sources(dataset_base, predictions)
    yield "dataset_base", texts, prose_ending
    yield "predictions", answers, answer_ending


def truncated(dataset_base: DataFrame, predictions: DataFrame) -> DataFrame:
    """(source_table, row_key): the rows of cut_rows."""
    return cut_rows(dataset_base, predictions).drop("by")


def cut_rows(dataset_base: DataFrame, predictions: DataFrame) -> DataFrame:
    """(source_table, row_key, by): the rows whose text or raw_response is cut, and what cut it. Null
    and blank values never are; repeated rows are reported as often as they stand; empty tables give
    no rows."""
    parts = [judged(rows, kind).where(F.col("by").isNotNull()).select(F.lit(name).alias("source_table"), "row_key", "by") for name, rows, kind in _each(dataset_base, predictions)]
    return parts[0].unionByName(parts[1])


def limits(dataset_base: DataFrame, predictions: DataFrame) -> DataFrame:
    """(source_table, source, unit, length, n, around, at_maximum): the lengths at which limits stop
    values, and whether it is the greatest length among the source's unfinished values."""
    parts = []
    for name, rows, kind in _each(dataset_base, predictions):
        spikes = length_spikes(cut(_classed(spread(rows), kind)))
        parts.append(spikes.select(F.lit(name).alias("source_table"), "source", "unit", "length", "n", F.round("around", 4).alias("around"), (F.col("length") == F.col("most")).alias("at_maximum")))
    return parts[0].unionByName(parts[1])


def truncation_rates(dataset_base: DataFrame, predictions: DataFrame) -> DataFrame:
    """(source_table, source, n, cut, rate, by_limit, by_transfer) per host of url_canonical for texts
    and per model_alias for answers; a missing source is ''. All rows count, nulls as not cut."""
    parts = []
    for name, rows, kind in _each(dataset_base, predictions):
        counts = judged(rows, kind).groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.count("by").alias("cut"), F.count_if(F.col("by") == "limit").alias("by_limit"), F.count_if(F.col("by") == "transfer").alias("by_transfer")
        )
        parts.append(counts.select(F.lit(name).alias("source_table"), "source", "n", "cut", F.round(F.col("cut") / F.col("n"), 6).alias("rate"), "by_limit", "by_transfer"))
    return parts[0].unionByName(parts[1])
