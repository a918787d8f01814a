"""Text measures and whitespace rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as whitespace when splitting Unicode text into words.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Printable ASCII is told by one comparison; only other characters are held against the whole class.
WORD = rf"(?:[!-~]++|[^{WS}]++)++"
GAP = rf"(?![!-~])[{WS}]++"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(text, GAP, " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_estimate(words: Column) -> Column:
    """floor(words * 1.3) in exact integer arithmetic."""
    scaled = words.cast("long") * 13
    return ((scaled - scaled % 10) / 10).cast("long")


def char_count(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _rounded_tenths(numerator: Column, denominator: Column) -> Column:
    """10 * numerator / denominator, rounded half up in exact integer arithmetic; null for a zero denominator."""
    doubled = 20 * numerator + denominator
    step = F.nullif(2 * denominator, F.lit(0))
    return ((doubled - F.pmod(doubled, step)) / step).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """``a/b`` with one decimal and an ``x``; ``N/A`` when b is zero."""
    tenths = _rounded_tenths(a, b)
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("x"))
    return F.coalesce(shown, F.lit("N/A"))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one decimal; 0 when whole is zero."""
    return F.coalesce(_rounded_tenths(part * 100, whole) / 10, F.lit(0.0))
