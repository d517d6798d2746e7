"""Keys, text and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters between two terms of the text index, as a regular expression.
TERM_BREAK = r"([-~?<>=”“△/(),.·;’‘\s\[\]\n\r])+"
#: Terms of fewer characters are left out.
LEAST_TERM = 2


def padded(n: Column, width: int = 10) -> Column:
    """A number as text of a fixed width, so that text order is number order."""
    return F.lpad(n.cast("string"), width, "0")


def decimal_key(x: Column, places: int = 10) -> Column:
    """A number below ten with fixed places."""
    return F.format_string(f"%.{places}f", x)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def terms(text: Column, pattern: str = TERM_BREAK) -> Column:
    """The terms of a text, repeated as they stand."""
    return F.filter(F.transform(F.split(text, pattern), lambda t: F.trim(t)), lambda t: F.length(t) >= LEAST_TERM)


def date_millis(text: Column, end: bool = False) -> Column:
    """yyyyMMdd or yyyyMMddHHmmss, UTC, in milliseconds; a day as an upper bound is its 23:59:59."""
    full = F.when(F.length(text) == 8, F.concat(text, F.lit("235959" if end else "000000"))).otherwise(text)
    return (micros(F.to_timestamp_ntz(full, F.lit("yyyyMMddHHmmss"))) / 1000).cast("long")


def links(html: Column) -> Column:
    """Targets of the anchors of a page, in order."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))


def anchors(html: Column) -> Column:
    """(target, anchor text) of the anchors of a page, in order."""
    pattern = F.lit('<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("target"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("anchor"))


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)
