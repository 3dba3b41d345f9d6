"""Null tokens and date parsing on load."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendlens.functions._util import as_col

# The cell texts pandas' CSV reader turns into a missing value by
# default (its documented ``na_values`` list), in its own order.
PANDAS_NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

BAD_DATE_POLICIES = ("fail", "null")


def null_if_token(c: Column | str, tokens: Iterable[str] = ("",)) -> Column:
    """Null where the whole cell equals one of ``tokens`` (exact, no trimming)."""
    col = as_col(c)
    tokens = list(tokens)
    if not tokens:
        return col
    return F.when(col.isin(tokens), F.lit(None).cast("string")).otherwise(col)


def parse_timestamp(c: Column | str, fmt: str | None = None, on_bad: str = "fail") -> Column:
    """Text to ``TIMESTAMP_NTZ`` (no time zone is ever applied).

    ``on_bad='fail'`` raises on a non-null text that does not parse (whatever the
    ANSI setting); ``on_bad='null'`` turns it into null.
    """
    if on_bad not in BAD_DATE_POLICIES:
        raise ValueError(f"on_bad must be one of {BAD_DATE_POLICIES}, got {on_bad!r}")
    col = as_col(c)
    if fmt is None:
        parsed = col.try_cast("timestamp_ntz")
    else:
        parsed = F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
    if on_bad == "null":
        return parsed
    return F.when(
        col.isNotNull() & parsed.isNull(),
        F.raise_error(F.concat(F.lit("unparsable date: "), col.cast("string"))).cast("timestamp_ntz"),
    ).otherwise(parsed)
