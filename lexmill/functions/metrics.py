"""Scores of a predicted payload against a gold one, as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.payload import FIELDS, LIST_FIELDS, SCALAR_FIELD
from lexmill.functions.text import strip


def status_accuracy(gold: Column, pred: Column) -> Column:
    """Share of the nine fields whose statuses agree."""
    same = [F.when(F.coalesce(gold[f]["status"], F.lit("uncertain")) == F.coalesce(pred[f]["status"], F.lit("uncertain")), 1).otherwise(0) for f in FIELDS]
    return sum(same[1:], same[0]) / F.lit(float(len(FIELDS)))


def deployment_exact(gold: Column, pred: Column) -> Column:
    """1 if the deployment statuses agree and, where present, the values do but for case and padding."""
    g, p = gold[SCALAR_FIELD], pred[SCALAR_FIELD]
    value = lambda c: F.lower(strip(F.coalesce(c["value"], F.lit(""))))
    return F.when(g["status"] != p["status"], 0.0).when(g["status"] != "present", 1.0).when(value(g) == value(p), 1.0).otherwise(0.0)


def item_set(items: Column) -> Column:
    """Items as a set: trimmed, lower case, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(strip(x))), lambda x: x != ""))


def item_counts(gold: Column, pred: Column) -> dict[str, Column]:
    """True and false positives and false negatives by field: tp_<field>, fp_<field>, fn_<field>."""
    out = {}
    for f in LIST_FIELDS:
        g, p = item_set(gold[f]["items"]), item_set(pred[f]["items"])
        both = F.size(F.array_intersect(g, p))
        out |= {f"tp_{f}": both, f"fp_{f}": F.size(p) - both, f"fn_{f}": F.size(g) - both}
    return out


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall, 0 where there is nothing."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def kappa(gold: Column, pred: Column, least: int = 0, most: int = 4) -> Column:
    """Quadratically weighted kappa of two columns of levels, as an aggregate in one pass: with
    weights (g - p)^2 the expected disagreement needs only first and second moments. 1 where the
    expected disagreement is 0, 0 for no rows."""
    clamp = lambda c: F.greatest(F.lit(least), F.least(F.lit(most), c)).cast("double")
    g, p = clamp(gold), clamp(pred)
    seen = F.avg((g - p) * (g - p))
    expected = F.avg(g * g) + F.avg(p * p) - 2 * F.avg(g) * F.avg(p)
    return F.when(F.count(g) == 0, 0.0).when(F.abs(expected) < 1e-12, 1.0).otherwise(1 - seen / expected)


def quote_similarity(a: Column, b: Column) -> Column:
    """1 for equal quotes (both blank included), 0 if one is blank, 0.75 if one contains the other,
    else the Jaccard index of their words. Case and padding don't count."""
    x, y = F.lower(strip(F.coalesce(a, F.lit("")))), F.lower(strip(F.coalesce(b, F.lit(""))))
    words = lambda c: F.array_distinct(F.split(c, r"(?U)\s+"))
    u, v = words(x), words(y)
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(u, v)), F.size(F.array_union(u, v))), F.lit(0.0))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 0.75).otherwise(jaccard)


def interval_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of [a, b) and [c, d) over their hull, 0 where either is void."""
    hull = F.greatest(b, d) - F.least(a, c)
    inner = F.least(b, d) - F.greatest(a, c)
    return F.when((inner <= 0) | (hull <= 0), 0.0).otherwise(inner / hull)


def span_score(g: Column, p: Column) -> Column:
    """Interval overlap if all four offsets are there, else similarity of the quotes."""
    offsets = [g["start_char"], g["end_char"], p["start_char"], p["end_char"]]
    full = offsets[0].isNotNull() & offsets[1].isNotNull() & offsets[2].isNotNull() & offsets[3].isNotNull()
    return F.when(full, interval_overlap(*offsets)).otherwise(quote_similarity(g["quote"], p["quote"]))


def span_overlap(gold: Column, pred: Column) -> Column:
    """Mean over the gold spans of the best score among predicted spans of the same field; a blank
    field matches any. Both lists empty score 1, a single empty one 0."""
    name = lambda s: strip(F.coalesce(s["field"], F.lit("")))
    best = lambda g: F.coalesce(
        F.array_max(F.transform(F.filter(pred, lambda p: (name(g) == name(p)) | (name(g) == "") | (name(p) == "")), lambda p: span_score(g, p))), F.lit(0.0)
    )
    total = F.aggregate(F.transform(gold, best), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(gold) <= 0) & (F.size(pred) <= 0), 1.0).when((F.size(gold) <= 0) | (F.size(pred) <= 0), 0.0).otherwise(total / F.size(gold))


def judge_score(groundedness: Column, completeness: Column, hallucination_risk: Column, legacy_zero_risk: bool = True) -> Column:
    """Mean of groundedness, completeness and the absence of hallucination, each clamped to 0..1. A
    missing risk is 1; with ``legacy_zero_risk`` a risk of exactly 0 is too."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    h = F.coalesce(hallucination_risk.cast("double"), F.lit(1.0))
    if legacy_zero_risk:
        h = F.when(h == 0, 1.0).otherwise(h)
    g, c = F.coalesce(groundedness.cast("double"), F.lit(0.0)), F.coalesce(completeness.cast("double"), F.lit(0.0))
    return (clamp(g) + clamp(c) + (1 - clamp(h))) / 3


def strict_score(status: Column, deployment: Column, macro_f1: Column, maturity: Column, kappa_norm: Column, spans: Column) -> Column:
    """Fixed blend of the components."""
    return 0.15 * status + 0.10 * deployment + 0.30 * macro_f1 + 0.20 * maturity + 0.15 * kappa_norm + 0.10 * spans
