"""Exports: the category jobs (M13, M14) and the rows behind the trending tab
(A15, A16), to CSV or Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from trendlens.operators.filters import in_values
from trendlens.plans.roles import Roles, detect_roles, present
from trendlens.plans.trending import filtered
from trendlens.sources.readers import read_parquet
from trendlens.sources.writers import export_name, tee, write_csv, write_table


def category_rows(spark: SparkSession, source: str, values: Iterable[str], column: str = "category") -> DataFrame:
    """Dataset rows whose ``column`` is one of ``values`` (A6, C7); the IN list
    is pushed into the Parquet scan."""
    return in_values(read_parquet(spark, source), column, values)


def export_categories(
    spark: SparkSession,
    source: str,
    values: Iterable[str],
    out: str,
    fmt: str = "csv",
    column: str = "category",
    single_file: bool = False,
    second_out: str | None = None,
) -> int:
    """M13 (CSV) / M14 (Parquet, optionally a second copy): one write job whose
    row count is observed while writing; returns that count."""
    rows = category_rows(spark, source, values, column)
    if second_out:
        return tee(rows, out, second_out, fmt, single_file=single_file)
    return write_table(rows, out, fmt, single_file=single_file)


def export_filtered(
    df: DataFrame,
    folder: str,
    level1: str | None = None,
    level2: str | None = None,
    date_range=None,
    roles: Roles | None = None,
    single_file: bool = False,
) -> tuple[str, int]:
    """The rows that the filters leave, all columns, as CSV under the name that
    the categories give (A16).  Returns the path and the number of rows, which is
    observed during the write.  An export of the same name is replaced."""
    roles = present(roles or detect_roles(df.columns), df.columns)
    path = f"{folder.rstrip('/')}/{export_name(level1, level2)}"
    return path, write_csv(filtered(df, roles, level1, level2, date_range), path, single_file=single_file)
