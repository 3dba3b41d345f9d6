"""Scans (A1-A11).

Spark reads files in splits (``spark.sql.files.maxPartitionBytes``) and Parquet
in Arrow-sized column batches, so the dashboard's chunked reading needs no user
code: ``chunk_size`` is accepted for compatibility and has no effect on the
result, which is the same as the unchunked read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.nulls import PANDAS_NA_TOKENS, null_if_token, parse_timestamp

# File suffixes read as Parquet / CSV when the type is "auto".
PARQUET_SUFFIXES = (".parquet", ".pq")
CSV_SUFFIXES = (".csv",)
FILE_TYPES = ("auto", "csv", "parquet")


def detect_format(path: str, file_type: str = "auto") -> str:
    """Reader for ``path`` (A3): by suffix when ``auto``, CSV when unknown."""
    if file_type not in FILE_TYPES:
        raise ValueError(f"file_type must be one of {FILE_TYPES}, got {file_type!r}")
    if file_type != "auto":
        return file_type
    lowered = path.rstrip("/").lower()
    if lowered.endswith(PARQUET_SUFFIXES):
        return "parquet"
    return "csv"


def is_web(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


def check_location(path: str) -> None:
    """Spark's file readers take no web locations (A4): ``read_table`` sends
    them to :mod:`remote`.  Object-store and HDFS paths go straight to Spark."""
    if is_web(path):
        raise ValueError("HTTP(S) URLs are read by read_table, or by read_remote_csv and read_remote_parquet")


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet file or dataset directory (A2, A6); filters and column pruning reach the scan."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        check_location(p)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*paths)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    null_tokens: Iterable[str] | None = ("",),
    pandas_na: bool = False,
    multiline: bool = False,
    mode: str = "FAILFAST",
    corrupt_column: str | None = None,
) -> DataFrame:
    """CSV with a header row.

    * ``schema=None`` infers types, which costs one extra pass over the files;
      give a schema at scale.
    * Quotes are doubled inside quoted cells (``"q""r"``), as pandas writes them.
    * ``null_tokens``: whole-cell texts read as null (default: only empty);
      ``pandas_na=True`` uses pandas' default list, where even ``NA`` is null.
    * ``multiline`` only when cells hold line breaks: it stops file splitting.
    * ``mode``: ``FAILFAST`` raises on a malformed row, ``PERMISSIVE`` keeps it
      (raw text in ``corrupt_column`` if given), ``DROPMALFORMED`` drops it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        check_location(p)
    reader = (
        spark.read.option("header", "true")
        .option("escape", '"')
        .option("multiLine", "true" if multiline else "false")
        .option("mode", mode)
    )
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    tokens = list(PANDAS_NA_TOKENS) if pandas_na else list(null_tokens or ())
    if not set(tokens) - {""}:  # an empty cell is null in any type
        reader = reader.option("inferSchema", "true") if schema is None else reader.schema(schema)
        return normalise_nulls(reader.csv(paths), tokens)
    if schema is None:
        return infer_types(normalise_nulls(reader.csv(paths), tokens))
    # a token is no number and no date: read text, null the tokens, then cast
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared.fields])
    return cast_text(normalise_nulls(reader.schema(text).csv(paths), tokens), declared, mode, corrupt_column)


def cast_text(df: DataFrame, schema: T.StructType, mode: str = "FAILFAST", corrupt_column: str | None = None) -> DataFrame:
    """Text columns to ``schema``; a text that does not fit raises, becomes null
    (``PERMISSIVE``) or drops its row (``DROPMALFORMED``)."""
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    bad = None
    for f in typed:
        wrong = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        bad = wrong if bad is None else bad | wrong
    if bad is not None and mode.upper() == "DROPMALFORMED":
        df = df.filter(~bad)
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if f in typed:
            c = c.try_cast(f.dataType)
            if mode.upper() == "FAILFAST":
                message = F.concat(F.lit(f"not a {f.dataType.simpleString()} in {f.name}: "), F.col(f.name))
                fits = F.col(f.name).isNull() | c.isNotNull()
                c = F.when(fits, c).otherwise(F.raise_error(message).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


# Types tried for a text column, narrowest first.
INFERRED_TYPES = ("bigint", "double", "boolean", "date", "timestamp_ntz")


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to the first of ``INFERRED_TYPES`` that all their non-null
    cells fit (one job); a column without such cells stays text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checks = [F.count(F.col(c)).alias(f"{i}") for i, c in enumerate(texts)]
    checks += [F.count(F.col(c).try_cast(t)).alias(f"{i} {t}") for i, c in enumerate(texts) for t in INFERRED_TYPES]
    if not checks:
        return df
    found = df.agg(*checks).first()
    fits = {
        c: next((t for t in INFERRED_TYPES if found[f"{i}"] and found[f"{i} {t}"] == found[f"{i}"]), None) for i, c in enumerate(texts)
    }
    return df.select(*[F.col(c).cast(fits[c]).alias(c) if fits.get(c) else F.col(c) for c in df.columns])


def normalise_nulls(df: DataFrame, tokens: Iterable[str] = ("",), columns: Iterable[str] | None = None) -> DataFrame:
    """Null out whole-cell tokens in string columns."""
    tokens = list(tokens)
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(columns) & string_cols if columns is not None else string_cols
    if not tokens or not targets:
        return df
    return df.select(*[null_if_token(c, tokens).alias(c) if c in targets else c for c in df.columns])


def parse_dates(df: DataFrame, column: str = "date", fmt: str | None = None, on_bad: str = "fail") -> DataFrame:
    """Text dates to ``TIMESTAMP_NTZ`` when the column exists and is text."""
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.StringType):
        return df
    return df.withColumn(column, parse_timestamp(column, fmt=fmt, on_bad=on_bad))


def _names(schema: T.StructType | str) -> list[str]:
    return (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).names


def read_table(
    spark: SparkSession,
    path: str | list[str],
    file_type: str = "auto",
    schema: T.StructType | None = None,
    null_tokens: Iterable[str] | None = ("",),
    pandas_na: bool = False,
    date_column: str | None = "date",
    on_bad_date: str = "fail",
    use_chunking: bool = False,
    chunk_size: int | None = None,
    multiline: bool = False,
    mode: str = "FAILFAST",
    corrupt_column: str | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """Load a CSV or Parquet table, or several of the same columns, and coerce
    its ``date`` column (A1-A7, H1).

    Each path of a list has its own type, so CSV and Parquet files may be mixed;
    their frames are united by column name.  ``use_chunking`` / ``chunk_size``
    are accepted for compatibility, with a warning; Spark always reads in splits.
    HTTP(S) locations are read by byte ranges (:mod:`remote`).
    """
    if use_chunking or chunk_size is not None:
        warnings.warn("chunk_size has no effect: Spark reads in splits (spark.sql.files.maxPartitionBytes)", stacklevel=2)
    by_format: dict[tuple[str, bool], list[str]] = {}
    for p in [path] if isinstance(path, str) else path:
        by_format.setdefault((detect_format(p, file_type), is_web(p)), []).append(p)
    frames = []
    for (fmt, web), paths in by_format.items():
        if web:
            from trendlens.sources import remote

            if fmt == "parquet":
                frames.append(remote.read_remote_parquet(spark, paths, None if schema is None else _names(schema)))
            elif multiline:
                raise ValueError("multiline cells cannot be read by ranges; copy the file to shared storage first")
            else:
                frames.append(
                    remote.read_remote_csv(
                        spark, paths, schema, null_tokens=null_tokens, pandas_na=pandas_na, mode=mode, corrupt_column=corrupt_column
                    )
                )
        elif fmt == "parquet":
            frames.append(read_parquet(spark, paths, schema))
        else:
            frames.append(
                read_csv(
                    spark, paths, schema=schema, null_tokens=null_tokens, pandas_na=pandas_na, multiline=multiline, mode=mode, corrupt_column=corrupt_column
                )
            )
    if date_column:
        frames = [parse_dates(df, date_column, fmt=date_format, on_bad=on_bad_date) for df in frames]
    return union(*frames)


def union(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same column names (H1); a column that one
    frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cached(df: DataFrame) -> DataFrame:
    """Keep a frame for reuse across actions (A11); the caller unpersists."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
