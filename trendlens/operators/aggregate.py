"""Aggregates.

Conventions kept from the dashboards:

* a null grouping key is not a group (rows with a null key leave the result);
* the sum of a group whose values are all null is 0, not null;
* distinct counts skip nulls.

All aggregates are partial + final (map-side combine), so a hot key such as the
pre-rolled ``all`` topic collapses to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_numeric(df: DataFrame, *columns: str) -> None:
    """Raise ``ValueError`` for a metric that is not numeric."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if c not in fields:
            raise ValueError(f"no column {c!r}")
        if not isinstance(fields[c], T.NumericType):
            raise ValueError(f"metric column {c!r} is {fields[c].simpleString()}, not numeric")


def total(c: str | Column, name: str) -> Column:
    """``sum`` that gives 0 for an empty or all-null group."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col), F.lit(0)).alias(name)


def sums_by(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Sum ``metrics`` per non-null ``key``."""
    metrics = list(dict.fromkeys(metrics))
    if not metrics:
        raise ValueError("need at least one metric")
    check_numeric(df, *metrics)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[total(m, m) for m in metrics])
    )


TOPIC_METRICS = ("raw_conversations", "raw_messages", "raw_users")


def topic_totals(df: DataFrame, topic: str = "topic", metrics: Sequence[str] = TOPIC_METRICS) -> DataFrame:
    """Conversations, messages and users per topic."""
    return sums_by(df, topic, metrics)


def counts_by(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows per non-null ``key``."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def topic_volume(df: DataFrame, topic: str = "topic") -> DataFrame:
    """``sum(volume)`` and non-null keyword count per topic (E4) on mapped rows."""
    return (
        df.filter(F.col(topic).isNotNull())
        .groupBy(topic)
        .agg(total("volume", "volume"), F.count("keyword").alias("keyword_count"))
    )


def brand_volume(df: DataFrame, brands: str = "brands_list") -> DataFrame:
    """Explode the brand lists and sum volume per brand (E5).

    A brand listed twice in one row counts twice; rows with ``[]`` vanish.
    """
    return (
        df.select(F.explode_outer(brands).alias("brand"), "volume")
        .filter(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(total("volume", "volume"))
    )


def daily_sums(df: DataFrame, date: str, key: str, metric: str, day_name: str = "date_only") -> DataFrame:
    """``sum(metric)`` per (day, key) over non-null keys; the null day is kept
    as its own group, so topic totals can be derived from this frame too."""
    check_numeric(df, metric)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.to_date(F.col(date)).alias(day_name), F.col(key))
        .agg(F.sum(metric).alias(metric))
    )


def distinct_count(c: str) -> Column:
    return F.count_distinct(F.col(c))


def typed_null(type_name: str = "bigint") -> Column:
    return F.lit(None).cast(type_name)


def trend_kpis(
    df: DataFrame,
    topic: str | None = "topic",
    metric: str | None = "raw_conversations",
    users: str | None = "raw_users",
) -> DataFrame:
    """One row: total_rows, unique_topics, total_conversations, total_users.

    An absent role gives a typed null ("N/A").  Total rows are included.
    """
    if metric is not None:
        check_numeric(df, metric)
    if users is not None:
        check_numeric(df, users)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        (distinct_count(topic) if topic else typed_null()).alias("unique_topics"),
        (total(metric, "total_conversations") if metric else typed_null().alias("total_conversations")),
        (total(users, "total_users") if users else typed_null().alias("total_users")),
    )


def dataset_info(
    df: DataFrame,
    topic: str | None = "topic",
    level1: str | None = "level1",
    level2: str | None = "level2",
    date: str | None = "date",
) -> DataFrame:
    """Rows, distinct topics / level1 / level2, first and last day.

    The rows are first counted per (topic, level1, level2), so the distinct
    counts expand that frame and not the rows.  An absent role gives a typed
    null.
    """
    keys = {"topic": topic, "level1": level1, "level2": level2}
    day = F.to_date(F.col(date)) if date else typed_null("date")
    per_key = df.groupBy(*[F.col(c).alias(f"_{k}") for k, c in keys.items() if c]).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(day).alias("_first"), F.max(day).alias("_last")
    )
    distinct = {"unique_topics": "topic", "unique_level1": "level1", "unique_level2": "level2"}
    return per_key.agg(
        total("_rows", "total_rows"),
        *[(distinct_count(f"_{k}") if keys[k] else typed_null()).alias(name) for name, k in distinct.items()],
        F.min("_first").alias("min_date"),
        F.max("_last").alias("max_date"),
    )


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """First and last day, the default date filter."""
    return df.agg(F.min(F.to_date(date)).alias("min_date"), F.max(F.to_date(date)).alias("max_date"))


def filter_counts(df: DataFrame, predicate: Column | None) -> DataFrame:
    """Rows before and after a filter in one pass."""
    after = F.count(F.lit(1)) if predicate is None else F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), after.alias("rows_after"))


def distinct_values(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Sorted distinct non-null values, as text."""
    name = name or column
    return (
        df.select(F.col(column).cast("string").alias(name))
        .filter(F.col(name).isNotNull())
        .distinct()
        .orderBy(name)
    )


def group_count(df: DataFrame, name: str = "groups") -> DataFrame:
    """Number of rows of an aggregated frame as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))
