"""Text and signs of trouble in fetched pages."""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import is_blank

# Phrases that show a paywall, a block or a login wall.
PAYWALL = ("member-only", "members-only", "this story is for members", "become a member", "to continue reading", "get unlimited access")
BLOCK = ("unusual traffic", "verify you are a human", "cf-chl", "cloudflare", "captcha", "access denied", "temporarily unavailable")
BLOCK_GENERAL = ("cf-chl", "cloudflare", "captcha", "access denied", "unusual traffic", "verify you are a human")
LOGIN = ("sign in", "log in", "login", "join linkedin", "authwall", "create an account")
SHORTEST_AMP, SHORTEST_DOM, LONG_STRING = 200, 400, 2000


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


def _start(text: Column, n: int) -> Column:
    return F.lower(F.substring(F.coalesce(text, F.lit("")), 1, n))


def block_flags(text: Column, page: Column) -> Column:
    """struct(paywalled, blocked) from the start of a text and of its page; null counts as empty."""
    t, h = _start(text, 2000), _start(page, 12000)
    return F.struct((_any(t, PAYWALL) | _any(h, PAYWALL)).alias("paywalled"), _any(h, BLOCK).alias("blocked"))


def login_flags(page: Column) -> Column:
    """struct(blocked, login_required) from the start of a page."""
    h = _start(page, 20000)
    return F.struct(_any(h, BLOCK_GENERAL).alias("blocked"), _any(h, LOGIN).alias("login_required"))


def error_class(source: Column, text: Column, words: Column, length: Column, blocked: Column, paywalled: Column) -> Column:
    """Why a capture failed, null if it didn't. Captures of the medium source are checked for blocks
    and paywalls first and may be shorter."""
    medium = F.coalesce(source == "medium", F.lit(False))
    short = F.when(medium, words < 250).otherwise(words < 300) | (length < 1000)
    return F.when(medium & blocked, "blocked").when(medium & paywalled, "paywalled").when(is_blank(text), "no_text").when(short, "too_short")


def strip_guard(body: Column) -> Column:
    """A JSON body without the guard some services put before it."""
    return F.regexp_replace(F.trim(body), r"^\)\]\}',?\s*", "")


_DROP = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"


def text_of(node: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and comments dropped, tags turned into line ends,
    the common entities decoded, blank lines dropped."""
    t = F.regexp_replace(node, _DROP, "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def _element(page: Column, tag: str) -> Column:
    return F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def article_text(page: Column) -> Column:
    """Text of the first article, else main element; null if shorter than 200 characters."""
    node = F.when(_element(page, "article") != "", _element(page, "article")).otherwise(_element(page, "main"))
    t = text_of(node)
    return F.when(F.length(t) >= SHORTEST_AMP, t)


def page_title(page: Column) -> Column:
    """The title element's text, null where there is none."""
    t = F.trim(text_of(_element(page, "title")))
    return F.when(t != "", t)


def dom_text(page: Column) -> Column:
    """struct(method, text): text of the first of article, main, role=main, section and body that
    has at least 400 characters; nulls where none has."""
    role = F.regexp_extract(page, r"""(?is)<(\w+)\b[^>]*\brole=["']main["'][^>]*>(.*?)</\1\s*>""", 2)
    steps = [("article", _element(page, "article")), ("main", _element(page, "main")), ("role_main", role), ("section", _element(page, "section")), ("body", _element(page, "body"))]
    kind = T.StructType([T.StructField("method", T.StringType()), T.StructField("text", T.StringType())])
    found = [F.when(F.length(text_of(node)) >= SHORTEST_DOM, F.struct(F.lit(f"playwright_{name}").alias("method"), text_of(node).alias("text"))) for name, node in steps]
    return F.coalesce(*found, F.lit(None).cast(kind))


_AROUND = r"(?is)<(nav|header|footer|aside|form|menu)\b.*?</\1\s*>"


def fallback_text(page: Column) -> Column:
    """Text of a page without the elements that surround an article, for pages whose own elements give
    none; null if shorter than 400 characters."""
    t = text_of(F.regexp_replace(_element(page, "body"), _AROUND, ""))
    return F.when(F.length(t) >= SHORTEST_DOM, t)


def longest_html(body: str | None) -> str | None:
    """The longest string of markup of more than 2000 characters anywhere in a JSON body."""
    try:
        todo = [json.loads(re.sub(r"^\)\]\}',?\s*", "", (body or "").strip()))]
    except (ValueError, RecursionError):
        return None
    best = ""
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            todo += value.values()
        elif isinstance(value, list):
            todo += value
        elif isinstance(value, str) and len(value) > max(LONG_STRING, len(best)) and ("<p" in value or "<article" in value or "<h" in value):
            best = value
    return entities.unescape(best) if best and "<" not in best else best or None


@F.pandas_udf(T.StringType())
def json_html(body: pd.Series) -> pd.Series:
    """Column form of longest_html."""
    return body.map(longest_html, na_action="ignore").astype(object)
