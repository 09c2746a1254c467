"""Extraction payloads: scanning, normalising, checking.

A model's answer is free text with a JSON object somewhere in it. The scanner is the one part that
needs Python (an Arrow UDF that returns canonical JSON); everything after it works on VARIANT values
and built-in expressions, so that quoted and bare scalars stay distinguishable.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import strip

# The payload's fields and the names they go by in answers.
STATUSES = ("present", "absent", "uncertain")
LIST_FIELDS = (
    "ai_use_cases",
    "adoption_patterns",
    "ai_stack",
    "kpi_signals",
    "budget_signals",
    "org_change_signals",
    "risk_signals",
    "roadmap_signals",
)
SCALAR_FIELD = "deployment_scope"
FIELDS = (*LIST_FIELDS, SCALAR_FIELD)
QUOTE_NAMES = ("quote", "text", "excerpt", "content", "evidence", "span")
START_NAMES = ("start_char", "start", "begin", "from", "offset")
END_NAMES = ("end_char", "end", "finish", "to", "stop")
WRONG_NAMES = ("use_cases", "stack", "usecases", "kpis", "risks")
MOST_SPANS, LONGEST_QUOTE = 30, 500

SPAN = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("quote", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]
)
_LIST = T.StructType([T.StructField("status", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])
_SCALAR = T.StructType([T.StructField("status", T.StringType()), T.StructField("value", T.StringType())])
PAYLOAD = T.StructType(
    [T.StructField(f, _LIST) for f in LIST_FIELDS]
    + [
        T.StructField(SCALAR_FIELD, _SCALAR),
        T.StructField("maturity_level", T.IntegerType()),
        T.StructField("maturity_rationale", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence_spans", T.ArrayType(SPAN)),
    ]
)


def _finite(value):
    """The value with numbers JSON can't write (NaN, infinities) as null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return value


def first_object(raw: str | None) -> str | None:
    """Canonical JSON of the first object in the text: the whole text if it is one, else the first
    ``{`` from which one decodes, whatever follows it. None where there is none. Nesting too deep
    for the decoder counts as none."""
    text = (raw or "").strip()
    if not text:
        return None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(_finite(value), ensure_ascii=False)
        except RecursionError:
            return None
        except ValueError:
            # an object closes with a brace: where none is left, none of the openings ahead can decode
            at = text.find("{", at + 1)
            if at >= 0 and text.find("}", at) < 0:
                return None
    return None


@F.pandas_udf(T.StringType())
def scan_object(raw: pd.Series) -> pd.Series:
    """Column form of first_object."""
    return raw.map(first_object, na_action="ignore").astype(object)


def _kind(v: Column) -> Column:
    """Upper-case type name of a VARIANT; null for a missing one."""
    return F.schema_of_variant(v)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once a row, however often ``use`` names it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _as_text(v: Column) -> Column:
    """Text of a VARIANT: strings plain, everything else as JSON; null and missing give ''."""
    return _bind(
        _kind(v), lambda k: F.when(k.isNull() | (k == "VOID"), F.lit("")).when(k == "STRING", strip(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
    )


def _status(v: Column) -> Column:
    return _bind(F.lower(_as_text(v)), lambda s: F.when(s.isin(*STATUSES), s).otherwise(F.lit("uncertain")))


def _unique(items: Column) -> Column:
    """The items without later repetitions that differ in case only."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        items, empty, lambda acc, x: F.when(F.array_contains(F.transform(acc, lambda y: F.lower(y)), F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    )


def _items(v: Column) -> Column:
    """Items of a list field: a list's non-blank entries as text, a string's comma-separated pieces
    (blank ones kept), any other value as one item; null gives none."""
    none = F.array().cast("array<string>")

    def by_kind(kind: Column) -> Column:
        entries = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _as_text(x)), lambda x: x != "")
        text = F.try_variant_get(v, "$", "string")
        pieces = F.transform(F.split(text, ","), lambda x: strip(x))
        return (
            F.when(kind.isNull() | (kind == "VOID"), none).when(kind.startswith("ARRAY"), _unique(entries)).when((kind == "STRING") & (text == ""), none)
            .when(kind == "STRING", _unique(pieces)).otherwise(F.array(F.to_json(v)))
        )

    return _bind(_kind(v), by_kind)


def _integer(v: Column) -> Column:
    """Whole number: of a bare number its whole part, of a string only if it spells one, of a truth
    value 1 or 0; null otherwise."""
    return _bind(
        _kind(v),
        lambda k: F.when(k == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("bigint"))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint")),
    )


def _span(v: Column) -> Column:
    pick = lambda names: F.coalesce(*[_present(F.try_variant_get(v, f"$.{n}", "variant")) for n in names])
    number = lambda names: _bind(pick(names), lambda x: _bind(_integer(x).try_cast("int"), lambda n: F.when(n >= 0, n)))
    offsets = F.struct(number(START_NAMES).alias("a"), number(END_NAMES).alias("b"))
    swap = lambda o: F.coalesce(o["b"] < o["a"], F.lit(False))
    ordered = _bind(offsets, lambda o: F.struct(F.when(swap(o), o["b"]).otherwise(o["a"]).alias("a"), F.when(swap(o), o["a"]).otherwise(o["b"]).alias("b")))
    field = _bind(F.try_variant_get(v, "$.field", "variant"), lambda x: _bind(_as_text(x), lambda t: F.when(t.isin(*FIELDS, "maturity_rationale"), t).otherwise(F.lit(""))))
    quote = _bind(pick(QUOTE_NAMES), lambda x: F.coalesce(F.substring(_as_text(x), 1, LONGEST_QUOTE), F.lit("")))
    return _bind(ordered, lambda o: F.struct(field.alias("field"), quote.alias("quote"), o["a"].alias("start_char"), o["b"].alias("end_char")))


def _present(v: Column) -> Column:
    return _bind(v, lambda x: F.when(_kind(x) != "VOID", x))


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _list_field(raw: Column) -> Column:
    """struct(status, items) of a list field, whether it is an object or bare items."""
    none = F.array().cast("array<string>")
    within = lambda name, use: _bind(F.try_variant_get(raw, f"$.{name}", "variant"), use)

    def bare(items: Column) -> Column:
        return F.struct(F.when(F.size(items) > 0, F.lit("present")).otherwise(F.lit("uncertain")).alias("status"), items.alias("items"))

    own = _bind(within("status", _status), lambda s: F.struct(s.alias("status"), F.when(s == "absent", none).otherwise(within("items", _items)).alias("items")))
    return F.when(_is_object(raw), own).otherwise(_bind(_items(raw), bare))


def _scalar_field(raw: Column) -> Column:
    within = lambda name, use: _bind(F.try_variant_get(raw, f"$.{name}", "variant"), use)
    bare = _bind(_as_text(raw), lambda t: F.struct(F.when(t != "", F.lit("present")).otherwise(F.lit("uncertain")).alias("status"), t.alias("value")))
    own = _bind(within("status", _status), lambda s: F.struct(s.alias("status"), F.when(s == "absent", F.lit("")).otherwise(within("value", _as_text)).alias("value")))
    return F.when(_is_object(raw), own).otherwise(bare)


def _confidence(sure: Column) -> Column:
    text = F.trim(F.try_variant_get(sure, "$", "string")).try_cast("double")
    number = F.when(_kind(sure) == "STRING", text).otherwise(F.try_variant_get(sure, "$", "double"))
    return _bind(number, lambda n: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(n), F.lit(0.0)).otherwise(F.coalesce(n, F.lit(0.0))))), 4))


def normalize(canonical: Column) -> Column:
    """PAYLOAD of a canonical JSON object. Null, unreadable JSON and anything but an object give the
    empty payload: every status uncertain, no items, level and confidence 0."""

    def payload(v: Column) -> Column:
        get = lambda name, use: _bind(F.try_variant_get(v, f"$.{name}", "variant"), use)
        spans = F.filter(F.slice(F.try_variant_get(v, "$.evidence_spans", "array<variant>"), 1, MOST_SPANS), lambda s: _is_object(s))
        return F.struct(
            *[get(f, _list_field).alias(f) for f in LIST_FIELDS],
            get(SCALAR_FIELD, _scalar_field).alias(SCALAR_FIELD),
            get("maturity_level", lambda x: F.greatest(F.lit(0), F.least(F.lit(4), F.coalesce(_integer(x), F.lit(0)))).cast("int")).alias("maturity_level"),
            get("maturity_rationale", _as_text).alias("maturity_rationale"),
            get("confidence", _confidence).alias("confidence"),
            F.coalesce(F.transform(spans, lambda s: _span(s)), F.array().cast(T.ArrayType(SPAN))).alias("evidence_spans"),
        )

    return _bind(F.try_parse_json(canonical), payload)


def stored(payload: Column) -> Column:
    """PAYLOAD of a stored, already normalised payload's JSON; null gives the empty payload."""
    p = F.from_json(payload, PAYLOAD)
    none = F.array().cast("array<string>")
    parts = [
        F.struct(F.coalesce(p[f]["status"], F.lit("uncertain")).alias("status"), F.coalesce(p[f]["items"], none).alias("items")).alias(f) for f in LIST_FIELDS
    ]
    s = p[SCALAR_FIELD]
    parts.append(F.struct(F.coalesce(s["status"], F.lit("uncertain")).alias("status"), F.coalesce(s["value"], F.lit("")).alias("value")).alias(SCALAR_FIELD))
    parts += [
        F.coalesce(p["maturity_level"], F.lit(0)).alias("maturity_level"),
        F.coalesce(p["maturity_rationale"], F.lit("")).alias("maturity_rationale"),
        F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(p["evidence_spans"], F.array().cast(T.ArrayType(SPAN))).alias("evidence_spans"),
    ]
    return F.struct(*parts)


def empty() -> Column:
    """The payload of a record nothing is known about."""
    return stored(F.lit(None).cast("string"))


def parse_error_payload() -> Column:
    """The payload written for an answer that couldn't be read: every status absent."""
    none = F.array().cast("array<string>")
    parts = [F.struct(F.lit("absent").alias("status"), none.alias("items")).alias(f) for f in LIST_FIELDS]
    parts.append(F.struct(F.lit("absent").alias("status"), F.lit("").alias("value")).alias(SCALAR_FIELD))
    parts += [F.lit(0).alias("maturity_level"), F.lit("").alias("maturity_rationale"), F.lit(0.0).alias("confidence"), F.array().cast(T.ArrayType(SPAN)).alias("evidence_spans")]
    return F.struct(*parts)


def problems(p: Column) -> Column:
    """Names of the rules a payload breaks; none for a normalised one."""
    checks = []
    for f in LIST_FIELDS:
        checks += [F.when(p[f].isNull(), F.lit(f"{f}:not_dict")), F.when(~p[f]["status"].isin(*STATUSES), F.lit(f"{f}:bad_status")), F.when(p[f].isNotNull() & p[f]["items"].isNull(), F.lit(f"{f}:items_not_list"))]
    s = p[SCALAR_FIELD]
    checks += [F.when(s.isNull(), F.lit(f"{SCALAR_FIELD}:not_dict")), F.when(~s["status"].isin(*STATUSES), F.lit(f"{SCALAR_FIELD}:bad_status")), F.when(s.isNotNull() & s["value"].isNull(), F.lit(f"{SCALAR_FIELD}:value_none"))]
    level, sure = p["maturity_level"], p["confidence"]
    checks.append(F.when(level.isNull() | (level < 0) | (level > 4), F.lit("maturity_level:out_of_range")))
    checks.append(F.when(sure.isNull() | (sure < 0) | (sure > 1), F.lit("confidence:out_of_range")))
    checks.append(F.when(p["evidence_spans"].isNull(), F.lit("evidence_spans:not_list")))
    return F.array_compact(F.array(*checks))


def warnings(raw: Column, p: Column) -> Column:
    """Tags of the oddities of an answer and its payload: left thoughts, other names for a span's
    parts, signals without evidence, a level without a reason, wrong field names."""
    text = F.coalesce(raw, F.lit(""))
    holds = lambda names: [F.contains(text, F.lit(f'"{n}":')) for n in names]
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    signals = any_of([(p[f]["status"] == "present") & (F.size(p[f]["items"]) > 0) for f in LIST_FIELDS])
    low = F.lower(text)
    return F.array_compact(
        F.array(
            F.when(F.contains(text, F.lit("<think>")) | F.contains(text, F.lit("</think>")), F.lit("qwen3_thinking_present")),
            F.when(any_of(holds(["text", "start", "end", "excerpt"])) & ~any_of(holds(["quote", "start_char", "end_char"])), F.lit("evidence_spans_alias_used")),
            F.when(signals & (F.size(p["evidence_spans"]) == 0), F.lit("evidence_spans_empty_despite_signals")),
            F.when((p["maturity_level"] > 0) & (p["maturity_rationale"] == ""), F.lit("maturity_rationale_empty")),
            F.when(any_of([F.contains(low, F.lit(f'"{n}"')) for n in WRONG_NAMES]), F.lit("wrong_field_names_detected")),
        )
    )


def snapshot(p: Column) -> Column:
    """Status of every field by its name."""
    return F.create_map(*[x for f in FIELDS for x in (F.lit(f), p[f]["status"])])


def statuses(p: Column) -> Column:
    """Array of (field, status, items) in the order of FIELDS; the scalar field's value is its item."""
    rows = [F.struct(F.lit(f).alias("field"), p[f]["status"].alias("status"), p[f]["items"].alias("items")) for f in LIST_FIELDS]
    value = F.when(p[SCALAR_FIELD]["value"] == "", F.array().cast("array<string>")).otherwise(F.array(p[SCALAR_FIELD]["value"]))
    rows.append(F.struct(F.lit(SCALAR_FIELD).alias("field"), p[SCALAR_FIELD]["status"].alias("status"), value.alias("items")))
    return F.array(*rows)


def flatten(p: Column) -> list[Column]:
    """The flat columns of a payload: statuses, items joined by '; ', the rest, nested ones as JSON."""
    out = [p[SCALAR_FIELD]["status"].alias("deployment_scope_status"), p[SCALAR_FIELD]["value"].alias("deployment_scope_value")]
    for f in LIST_FIELDS:
        out += [p[f]["status"].alias(f"{f}_status"), F.array_join(p[f]["items"], "; ").alias(f"{f}_items")]
    return [
        *out,
        p["maturity_level"].alias("maturity_level"),
        p["maturity_rationale"].alias("maturity_rationale"),
        p["confidence"].alias("confidence"),
        F.to_json(p["evidence_spans"], {"ignoreNullFields": "false"}).alias("evidence_spans"),
        F.to_json(p, {"ignoreNullFields": "false"}).alias("fields_payload"),
    ]
