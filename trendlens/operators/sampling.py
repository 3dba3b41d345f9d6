"""Samples of an exact size per category.

Bottom-k: every row has a hash of its key columns; a category's sample is its k
rows of the smallest hashes, so it is the same for any partitioning and a sample
of a smaller k is part of it.  No category is sorted as a whole.  A first read
counts, per category, the rows by the number of leading zero bits of their hash
(at most 61 counts, partial sums in every task).  These give a bound below which
a category has k rows or more, about 2 k of them; a second read keeps
only rows below their category's bound, and those are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.sources.writers import HASH_NULL, HASH_SEPARATOR, HASHES, materialize

BITS = 60


def row_hash(keys: Sequence[str], seed: int = 42, hash: str = "xxhash64") -> Column:
    """A number below 2 ** 60.  ``md5`` takes the first 15 hex digits of the MD5
    of seed and keys as text (``|``-joined, null as ``\\N``), which any engine
    can reproduce."""
    if hash == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 64 - BITS)
    if hash == "md5":
        text = F.concat_ws(HASH_SEPARATOR, F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit(HASH_NULL)) for k in keys])
        return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")
    raise ValueError(f"hash must be one of {HASHES}")


def _own(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def sample_per_category(
    df: DataFrame, by: Sequence[str], k: int, keys: Sequence[str] | None = None, seed: int = 42, hash: str = "xxhash64"
) -> DataFrame:
    """Exactly min(k, n) rows of every category, the values of ``by`` (a null is
    a value): those of the smallest hashes of ``keys`` (default: all scalar
    columns), ties by all scalar columns in their order."""
    if k < 0:
        raise ValueError("k must be >= 0")
    scalars = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    h, zeros, place = _own(df, "hash"), _own(df, "zeros"), _own(df, "place")
    hashed = df.withColumn(h, row_hash(list(keys or scalars), seed, hash))
    hashed = hashed.withColumn(zeros, F.when(F.col(h) == 0, BITS).otherwise(BITS - F.length(F.bin(h))))

    counts = hashed.groupBy(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.col(zeros).alias("zeros")).agg(F.count(F.lit(1)).alias("n"))
    names = [f"by{i}" for i in range(len(by))]
    most_first = Window.partitionBy(*names).orderBy(F.col("zeros").desc()).rowsBetween(Window.unboundedPreceding, 0)
    enough = F.when(F.sum("n").over(most_first) >= k, F.col("zeros"))
    bounds = counts.withColumn("bound", enough).groupBy(*names).agg(F.coalesce(F.max("bound"), F.lit(0)).alias("bound"))
    bounds = materialize(bounds, "bottom-k")  # a row for each category; its written size decides how it is joined

    below = F.col(zeros) >= F.col("bound")
    for c, name in zip(by, names, strict=True):
        below = F.col(c).eqNullSafe(F.col(name)) & below
    order = [F.col(h), *[F.col(c).asc_nulls_last() for c in scalars]]
    ranked = hashed.join(bounds, below).withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(place) <= k).select(*df.columns)
