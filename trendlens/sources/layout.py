"""A file layout that prunes on several columns at once.

Rows are ordered by a Z-order key: each column's value becomes its rank among
quantiles of the column, and the ranks' bits are interleaved.  Files are ranges
of that key, so each covers a small part of *every* column's range, and the
minima and maxima in the Parquet footers let a filter on any of the columns
skip most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.sources.writers import write_parquet

#: Bits of a column's rank: 2 ** BITS quantile ranges.
BITS = 6
#: Bytes of a text that decide its rank; texts equal in them share one.
TEXT_BYTES = 7
ACCURACY = 10_000


def as_number(df: DataFrame, column: str) -> Column:
    """A number in the column's order, for its quantiles."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        return F.conv(head, 16, 10).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"no Z-order of {column}, a {kind.simpleString()}")


def quantiles(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """The bounds between the ranges of each column, 2 ** bits - 1 at most, from
    one aggregate (mergeable summaries of bounded size)."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(as_number(df, c), shares, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(found[i] or [])) for i, c in enumerate(columns)}


def rank(number: Column, bounds: Sequence, first: int = 0) -> Column:
    """Number of bounds at or below ``number`` (a null: none), by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(number >= F.lit(bounds[middle]), rank(number, bounds[middle + 1 :], first + middle + 1)).otherwise(
        rank(number, bounds[:middle], first)
    )


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The ranks' bits, the highest of each first, in one number."""
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for k, r in enumerate(ranks):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(ranks) + k))
    return out


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = BITS) -> int:
    """Writes ``files`` Parquet files, each a range of the Z-order of
    ``columns``; returns the number of rows.

    Rows of one cell, a hot value of all columns, are told apart by the
    columns' values and a hash, so that they fall into several files.
    """
    if not columns or len(columns) * bits > 62:
        raise ValueError("1 to 62 / bits columns")
    bounds = quantiles(df, columns, bits)
    z, salt = "_z", "_salt"
    while z in df.columns or salt in df.columns:
        z, salt = f"_{z}", f"_{salt}"
    scalars = [F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    key = interleaved([rank(as_number(df, c), bounds[c]) for c in columns], bits)
    keyed = df.withColumn(z, key).withColumn(salt, F.xxhash64(*scalars))
    order = [z, *columns, salt]
    return write_parquet(keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*df.columns), path)
