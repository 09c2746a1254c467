"""Column expressions on web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys dropped by canonicalisation (exact spelling).
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
    "ref",
    "source",
    "cmpid",
    "mkt_tok",
)

# Keys that only track visits when pages are compared (any spelling); every utm_ key is one as well.
PAGE_TRACKING = (
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsctatracking", "yclid",
    "igshid", "twclid", "ttclid", "li_fat_id", "mkt_tok", "vero_id", "oly_anon_id", "oly_enc_id", "_openstat", "wickedid", "_ga", "_gl", "s_cid", "icid", "srsltid",
)


def page_key(url: Column) -> Column:
    """One string per page: spellings of an address that URL rules treat as equal, or that differ
    only in scheme, leading ``www.``, default port, trailing slash, fragment, padding, parameter
    order or tracking parameters, give the same key. Host case is ignored, path case is not.

    Null gives null; blank gives the empty string, which is no page.
    """
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    u = F.regexp_replace(u, r"#(?s).*$", "")
    u = F.regexp_replace(u, r"(?i)^(?:https?:)?//", "")
    head = F.regexp_extract(u, r"^[^/?]*", 0)
    host = F.lower(F.regexp_replace(head, r"^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"\.$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    rest = F.substr(u, F.length(head) + F.lit(1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_extract(rest, r"\?((?s).*)$", 1)
    pairs = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^[^=]*", 0)).rlike("^(?:utm_.*|" + "|".join(PAGE_TRACKING) + ")$"),
    )
    full = F.concat(_escapes(path), F.lit("?"), F.array_join(F.array_sort(F.transform(pairs, _escapes)), "&"))
    return F.concat(host, full)


def _escapes(part: Column) -> Column:
    """Percent escapes in one spelling: unreserved characters plain, hexadecimal digits upper case."""
    pieces = F.split(part, "%")
    decoded = F.transform(
        pieces,
        lambda s, i: F.when(i == 0, s)
        .when(
            s.rlike("^(?i:3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a]|2[de]|5f|7e)"),
            F.concat(F.decode(F.unhex(F.substring(s, 1, 2)), "UTF-8"), F.substr(s, F.lit(3))),
        )
        .when(s.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), F.upper(F.substring(s, 1, 2)), F.substr(s, F.lit(3))))
        .otherwise(F.concat(F.lit("%"), s)),
    )
    return F.when(F.instr(part, "%") > 0, F.array_join(decoded, "")).otherwise(part)


def canonicalize_url(url: Column) -> Column:
    """Trimmed address without fragment and tracking keys; the other parameters are re-encoded in
    order, blank ones kept. Null gives null."""
    u = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"#(?s).*$", "")
    base = F.regexp_extract(u, r"^[^?]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + F.lit(1)))
    query = F.regexp_extract(u, r"\?((?s).*)$", 1)

    def encode(text: Column) -> Column:
        plain = F.try_url_decode(text)
        coded = F.url_encode(F.coalesce(plain, text))
        return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.regexp_extract(p, r"^[^=]*", 0)
    value = lambda p: F.regexp_extract(p, r"=((?s).*)$", 1)
    kept = F.filter(pairs, lambda p: ~F.coalesce(F.try_url_decode(name(p)), name(p)).isin(*TRACKING_KEYS))
    coded = F.array_join(F.transform(kept, lambda p: F.concat(encode(name(p)), F.lit("="), encode(value(p)))), "&")
    return F.when(coded == "", base).otherwise(F.concat(base, F.lit("?"), coded))


def normalize_url(url: Column) -> Column:
    """Trimmed address, ``https://`` put before it where it has no scheme; blank stays blank."""
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(u == "", u).when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def host_of(url: Column) -> Column:
    """Authority of the address in lower case; null, blank and unreadable addresses give ''."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def base_domain(url: Column) -> Column:
    """Last two labels of the host, an approximation of the registrable domain without a suffix list."""
    host = F.regexp_replace(F.regexp_replace(host_of(normalize_url(F.coalesce(url, F.lit("")))), r"^.*@", ""), r":\d+$", "")
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)\.?$", 1)
