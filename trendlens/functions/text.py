"""Text predicates and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendlens.functions._util import as_col

MODES = ("contains", "regex")


def matches(c: Column | str, value: str, mode: str = "contains") -> Column:
    """Case-insensitive match of ``value`` in ``c``; a null cell never matches.

    ``contains`` is a literal substring test (metacharacters are plain text);
    ``regex`` is a Java regular expression found anywhere in the text, with both
    sides lower-cased first, as the dashboards did.
    """
    text = F.lower(as_col(c))
    if mode == "contains":
        return text.contains(value.lower())
    if mode == "regex":
        return text.rlike(value.lower())
    raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def day(c: Column | str) -> Column:
    """Calendar day of a date, timestamp or ISO text column."""
    return F.to_date(as_col(c))


def day_text(c: Column | str) -> Column:
    """Day as ``yyyy-MM-dd`` text."""
    return F.date_format(as_col(c), "yyyy-MM-dd")


def thousands(c: Column | str) -> Column:
    """Number with thousands separators and no decimals (``1,234``)."""
    return F.format_number(as_col(c), 0)
