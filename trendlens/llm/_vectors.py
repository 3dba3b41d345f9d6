"""Vectors of integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Integer components beyond +-LIMIT count as +-LIMIT, so that sums of squares stay far from the ends of 64 bits.
LIMIT = 1 << 23


def is_whole(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integers(vector: Column) -> Column:
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    # a double too large for a long is cut before its floor is taken
    cut = lambda x: F.greatest(F.least(x.cast("double"), F.lit(LIMIT / SCALE)), F.lit(-LIMIT / SCALE))
    return F.transform(vector, lambda x: whole(cut(x)).cast("int"))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """``vec_id, v`` (integers) and further columns of the rows whose vector is whole."""
    rows = df.where(is_whole(F.col(vec_col)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col)).alias("v"), *more)


def common_length(vectors: DataFrame) -> int | None:
    """Length of the vector of the smallest id (a null id comes last); None
    without rows."""
    order = F.struct(F.col("vec_id").isNull().alias("z"), F.col("vec_id").alias("i"), F.size("v").alias("length"))
    return vectors.agg(F.min(order)["length"].alias("length")).first()["length"]


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of an Arrow column, all of one length, as rows of int64."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
