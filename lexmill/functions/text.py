"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a DuckDB/RE2 class, for oracles; Spark uses (?U)\s.
RE2_SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True where ``text`` is null, empty or white space only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def count_words(text: Column) -> Column:
    """Number of runs of characters that aren't Unicode white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def sha1_text(text: Column) -> Column:
    """Hexadecimal SHA-1 of the UTF-8 bytes; null counts as empty."""
    return F.sha1(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def safe_slug(text: Column, longest: int = 80) -> Column:
    """File-name form: white space runs become one space, characters outside ``[A-Za-z0-9-_. ]``
    go, spaces become underscores, at most ``longest`` characters, 'doc' where nothing is left."""
    s = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    s = F.replace(F.trim(F.regexp_replace(s, r"[^a-zA-Z0-9\-_. ]+", "")), F.lit(" "), F.lit("_"))
    s = F.regexp_replace(F.substring(s, 1, longest), r"^_+|_+$", "")
    return F.when(s == "", F.lit("doc")).otherwise(s)


def normalize_year(year: Column) -> Column:
    """Trimmed year as text without a trailing '.0'; null gives ''."""
    return F.regexp_replace(strip(F.coalesce(year.cast("string"), F.lit(""))), r"\.0$", "")


def to_bool(value: Column) -> Column:
    """True for 1, true, yes and y in any case and padding, else false; null is false."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def to_count(value: Column) -> Column:
    """Integer of a loosely typed number, 0 where it isn't one."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0)).try_cast("int")
