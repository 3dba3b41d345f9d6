"""Row filters (C1-C14).  Each returns a filtered ``DataFrame``; Catalyst merges
consecutive filters and pushes what it can into the Parquet scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions.text import matches

# The option meaning "no filter", and the topic names of the
# pre-rolled total rows that charts leave out (compared lower-cased).
ALL = "All"
TOTAL_TOPICS = ("all", "total", "overall")
# Fixed value: the one topic the category map leaves out (exact case).
MAP_EXCLUDED_TOPIC = "all"

DateLike = dt.date | str


def _given(value) -> bool:
    return value is not None and value != ALL and value != ""


def value_predicate(column: str | None, value) -> Column | None:
    """``column = value`` compared as text; ``None`` when the filter is off.  A
    value without a column to compare it with is an error, not "off"."""
    if not _given(value):
        return None
    if column is None:
        raise ValueError(f"cannot filter on {value!r}: the table has no such column")
    return F.col(column).cast("string") == F.lit(str(value))


def all_of(*predicates: Column | None) -> Column | None:
    """Conjunction of the predicates that are on."""
    out = None
    for p in predicates:
        if p is not None:
            out = p if out is None else out & p
    return out


def where(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def by_value(df: DataFrame, column: str | None, value) -> DataFrame:
    """``column = value`` compared as text (C1, C2, C6); skipped if not given."""
    return where(df, value_predicate(column, value))


def by_levels(
    df: DataFrame,
    level1=None,
    level2=None,
    level1_col: str | None = "level1",
    level2_col: str | None = "level2",
) -> DataFrame:
    """Conjunction of the category filters."""
    return by_value(by_value(df, level1_col, level1), level2_col, level2)


def _as_date(value: DateLike) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str):
        return dt.date.fromisoformat(value)  # the whole text; anything else raises ValueError
    raise ValueError(f"not a date: {value!r}")


def normalise_range(date_range) -> tuple[dt.date | None, dt.date | None] | None:
    """``None`` -> no filter; one date -> that day; ``(a, b)`` -> inclusive
    range, open at an end that is ``None``."""
    if date_range is None:
        return None
    if isinstance(date_range, (dt.date, str)):
        d = _as_date(date_range)
        return d, d
    if isinstance(date_range, Sequence) and len(date_range) == 2:
        a, b = (None if d is None else _as_date(d) for d in date_range)
        return None if a is None and b is None else (a, b)
    raise ValueError(f"date_range must be a date or a (start, end) pair, got {date_range!r}")


def dates_predicate(column: str | None, date_range) -> Column | None:
    """Inclusive day range on ``column``; null dates never pass.  A range
    without a column is an error."""
    bounds = normalise_range(date_range)
    if bounds is None:
        return None
    if column is None:
        raise ValueError("cannot filter by date: the table has no date column")
    start, end = bounds
    day = F.to_date(F.col(column))
    if start is None:
        return day <= F.lit(end)
    if end is None:
        return day >= F.lit(start)
    if start == end:
        return day == F.lit(start)
    return day.between(F.lit(start), F.lit(end))


def by_dates(df: DataFrame, column: str | None, date_range) -> DataFrame:
    """Inclusive day range on ``column``."""
    return where(df, dates_predicate(column, date_range))


def in_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """``column IN (values)`` (C7), pushed into the scan."""
    return df.filter(F.col(column).isin(list(values)))


def search(df: DataFrame, column: str, value: str | None, mode: str = "contains") -> DataFrame:
    """Case-insensitive search (C8, C9); an empty value means no filter."""
    if not value:
        return df
    return df.filter(matches(column, value, mode))


def drop_totals(df: DataFrame, column: str = "topic", words: Iterable[str] = TOTAL_TOPICS) -> DataFrame:
    """Leave out pre-rolled total rows, any case (C11).  Null topics stay."""
    c = F.col(column)
    return df.filter(c.isNull() | ~F.lower(c.cast("string")).isin(list(words)))


def drop_value_keep_null(df: DataFrame, column: str, value: str = MAP_EXCLUDED_TOPIC) -> DataFrame:
    """``column IS DISTINCT FROM value`` (C12): exact case, null rows kept."""
    return df.filter(~F.col(column).eqNullSafe(value))


def non_null(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a null in any of ``columns``."""
    cond = None
    for c in columns:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df if cond is None else df.filter(cond)
