"""Brand lists as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.brands import parse_brands
from trendlens.operators.aggregate import total


def with_brands_list(df: DataFrame, source: str = "brands", name: str = "brands_list", exact: bool | str = True) -> DataFrame:
    """Add the parsed list column."""
    return df.withColumn(name, parse_brands(source, exact=exact))


def explode_brands(df: DataFrame, keep: Sequence[str] = ("keyword", "volume"), brands: str = "brands_list") -> DataFrame:
    """One row per listed brand (R2); rows with ``[]`` vanish, duplicates stay.

    ``explode_outer`` + a null filter rather than ``explode``: for the latter
    Spark infers ``size(list) > 0`` below the projection and evaluates the list
    parser twice.
    """
    return df.select(*keep, F.explode_outer(brands).alias("brand")).filter(F.col("brand").isNotNull())


def distinct_brands(df: DataFrame, brands: str = "brands_list") -> DataFrame:
    """Sorted distinct brands."""
    return (
        df.select(F.explode_outer(brands).alias("brand"))
        .filter(F.col("brand").isNotNull())
        .distinct()
        .orderBy("brand")
    )


def has_brand(df: DataFrame, brand: str, brands: str = "brands_list") -> DataFrame:
    """Exact list membership (the ``exact=True`` brand search, S17)."""
    return df.filter(F.array_contains(F.col(brands), F.lit(brand)))


def keyword_kpis(df: DataFrame, topic: str = "topic", brands: str = "brands_list") -> DataFrame:
    """One row: total_keywords, unique_topics, total_volume, unique_brands.

    Computed in a single pass: ``posexplode_outer`` yields at least one row per
    keyword row, and the first of them (position 0 or no brand) carries the
    row-level counts, so nothing is joined or scanned twice.
    """
    exploded = df.select(
        topic, "volume", F.posexplode_outer(F.col(brands)).alias("_pos", "_brand")
    )
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    return exploded.agg(
        F.count_if(first).alias("total_keywords"),
        F.count_distinct(F.col(topic)).alias("unique_topics"),
        total(F.when(first, F.col("volume")), "total_volume"),
        F.count_distinct(F.col("_brand")).alias("unique_brands"),
    )
