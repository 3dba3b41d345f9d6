"""Ordering, top-N, rank and pages.

Every order is total: ``metric DESC NULLS LAST`` then the key ascending, then
any extra tie-breakers, so a top-N never depends on the partitioning.
``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps its
own n best rows and only those reach the final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_order(metric: str, key: str, *tiebreak: str) -> list[Column]:
    return [F.col(metric).desc_nulls_last(), F.col(key).asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in tiebreak
    ]


def ordered(df: DataFrame, metric: str, key: str, *tiebreak: str) -> DataFrame:
    """Groups by metric, largest first (G1)."""
    return df.orderBy(*ranking_order(metric, key, *tiebreak))


def top_n(df: DataFrame, n: int, metric: str, key: str, *tiebreak: str) -> DataFrame:
    """The ``n`` best rows."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.orderBy(*ranking_order(metric, key, *tiebreak)).limit(n)


def with_rank(df: DataFrame, metric: str, key: str, *tiebreak: str, name: str = "rank") -> DataFrame:
    """1-based rank as the first column.

    Use it on an already limited frame: the window has no partition key, so it
    runs in one task, which is only right for a handful of rows.
    """
    w = Window.orderBy(*ranking_order(metric, key, *tiebreak))
    return df.select(F.row_number().over(w).cast("bigint").alias(name), *df.columns)


def ranked_top(df: DataFrame, n: int, metric: str, key: str, *tiebreak: str) -> DataFrame:
    """``top_n`` followed by ``with_rank``."""
    return with_rank(top_n(df, n, metric, key, *tiebreak), metric, key, *tiebreak)


def rank_all(df: DataFrame, metric: str, key: str, *tiebreak: str, name: str = "rank") -> DataFrame:
    """1-based rank of every row of a frame of any size as the first column.

    Rows are dealt by ranges of the order and sorted within them, and written
    once with their place; the rows of each range are counted, and a range's
    offset (one number for each task) is added to the places.  No task sees more
    than its range.
    """
    from trendlens.sources.writers import materialize

    order, place = ranking_order(metric, key, *tiebreak), "_place"
    while place in df.columns:
        place = f"_{place}"
    low = (1 << 33) - 1  # of a generated id: the place within the task
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn(place, F.monotonically_increasing_id()), "ranges")
    task = F.shiftright(place, 33)
    counted = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    offsets, before = [], 0
    for r in counted:
        offsets.append((r["task"], before))
        before += r["n"]
    if not offsets:
        return df.select(F.lit(0).cast("bigint").alias(name), *df.columns).limit(0)
    table = df.sparkSession.createDataFrame(offsets, "_task bigint, _before bigint")
    joined = placed.join(F.broadcast(table), task == F.col("_task"))
    rank = F.col("_before") + F.col(place).bitwiseAND(F.lit(low)) + 1
    return joined.select(rank.alias(name), *[F.col(c) for c in df.columns])


def top_n_by(df: DataFrame, by: Sequence[str], n: int, metric: str, key: str, *tiebreak: str, name: str = "rank") -> DataFrame:
    """The ``n`` best rows of every category, with their rank in it, in one pass.

    Spark limits each task's rows of a category to ``n`` before they are
    shuffled (``WindowGroupLimit``), so a category with a third of all rows
    sends ``n`` rows for each task.  A null in ``by`` is a category.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    w = Window.partitionBy(*by).orderBy(*ranking_order(metric, key, *tiebreak))
    ranked = df.select(F.row_number().over(w).cast("int").alias(name), *df.columns)
    return ranked.where(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


def page_after(df: DataFrame, order: Sequence[str], size: int, token: Sequence | None = None) -> DataFrame:
    """The next ``size`` rows in ``order`` after the row whose values of
    ``order`` are ``token`` (none: the first page); a page deep in the table
    holds ``size`` rows per task, like the first.  The token of the next page is
    the last row's values; ``order`` must tell rows apart.  Nulls come last.
    """
    after = F.lit(token is None)
    same = F.lit(token is not None)
    for c, value in zip(order, token or (), strict=False):
        if value is not None:
            after = after | (same & F.coalesce(F.col(c) > F.lit(value), F.lit(True)))
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return df.where(after).orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(size)


def for_display(df: DataFrame, metric: str, key: str) -> DataFrame:
    """Reverse a top-N for a bottom-up bar chart (G6); apply to a limited frame."""
    return df.orderBy(F.col(metric).asc_nulls_first(), F.col(key).desc_nulls_first())


def page(df: DataFrame, order: Sequence[str], size: int, index: int = 0) -> DataFrame:
    """Page ``index`` (0-based) of ``size`` rows in ``order`` (G7); bounded by
    ``(index + 1) * size`` rows per task."""
    cols = [F.col(c).asc_nulls_last() for c in order]
    return df.orderBy(*cols).offset(index * size).limit(size)


def after_first(df: DataFrame, key: str, skip: int) -> DataFrame:
    """All rows past the first ``skip`` distinct ``key`` values, in key order.

    ``df`` must hold distinct, non-null keys (as the value lists do).  Instead of
    a global OFFSET, which moves every row into one task, the boundary key is
    found with a bounded top-k and used as a scalar in a distributed filter.
    """
    if skip <= 0:
        return df.orderBy(F.col(key).asc())
    boundary = df.select(key).orderBy(F.col(key).asc()).limit(skip).agg(F.max(key).alias("b"))
    return df.filter(F.col(key) > boundary.scalar()).orderBy(F.col(key).asc())
