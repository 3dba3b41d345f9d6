"""Column builders: each returns a ``pyspark.sql.Column`` and touches no data."""

from trendlens.functions.brands import PLAIN_LIST_PATTERN, parse_brands
from trendlens.functions.labels import fallback_label, mapped_label
from trendlens.functions.nulls import PANDAS_NA_TOKENS, null_if_token, parse_timestamp
from trendlens.functions.text import day, day_text, matches, thousands

__all__ = [
    "PANDAS_NA_TOKENS",
    "PLAIN_LIST_PATTERN",
    "day",
    "day_text",
    "fallback_label",
    "mapped_label",
    "matches",
    "null_if_token",
    "parse_brands",
    "parse_timestamp",
    "thousands",
]
