"""Loading a CSV table without losing its bad rows.

Every row is read as text and checked once.  One write deals the rows into two
folders: good rows with their declared types, and rejected ones as they were
read, with the reasons.  The counts are observed during that write, so they hold
for exactly the rows that were written.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.nulls import PANDAS_NA_TOKENS
from trendlens.sources.readers import check_location, normalise_nulls

OK, RAW, REASONS, LINE = "_ok", "_raw", "_reasons", "_line"


@dataclass(frozen=True)
class Loaded:
    """``good`` has the declared columns; ``rejected`` the cells as text,
    ``reasons``, and the whole ``line`` of a row that has not as many cells as
    there are columns."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def faults(schema: T.StructType, required: Iterable[str]) -> Column:
    """What is wrong with a row of text cells: an array, empty if nothing is."""
    found = [F.when(F.col(LINE).isNotNull(), F.lit("wrong number of cells"))]
    for f in schema.fields:
        c = F.col(f.name)
        if f.name in set(required):
            found.append(F.when(c.isNull(), F.lit(f"no {f.name}")))
        if not isinstance(f.dataType, T.StringType):
            wrong = c.isNotNull() & c.try_cast(f.dataType).isNull()
            found.append(F.when(wrong, F.concat(F.lit(f"not a {f.dataType.simpleString()} in {f.name}: "), c)))
    return F.array_compact(F.array(*found))


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    out: str,
    required: Iterable[str] = (),
    null_tokens: Iterable[str] = ("",),
    pandas_na: bool = False,
    multiline: bool = False,
) -> Loaded:
    """Reads a CSV table with a header row and writes its good and rejected rows
    below ``out``.  ``required`` columns may not be null; other cells are null
    where their whole text is a null token."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        check_location(p)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(LINE, T.StringType())])
    reader = spark.read.schema(text).option("header", "true").option("escape", '"').option("multiLine", str(multiline).lower())
    cells = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).csv(paths)
    names = [f.name for f in schema.fields]
    cells = normalise_nulls(cells, PANDAS_NA_TOKENS if pandas_na else null_tokens, names)

    checked = cells.withColumn(REASONS, faults(schema, required)).withColumn(OK, F.size(REASONS) == 0)
    typed = [F.when(F.col(OK), F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields]
    raw = F.when(~F.col(OK), F.struct(*names, LINE)).alias(RAW)
    rows = checked.select(*typed, raw, REASONS, OK)
    seen = Observation("rows_loaded")
    rows = rows.observe(seen, F.count_if(OK).alias("good"), F.count_if(~F.col(OK)).alias("rejected"))
    rows.write.partitionBy(OK).parquet(out)

    written = spark.read.schema(rows.schema).parquet(out)
    good = written.where(F.col(OK)).select(*names)
    rejected = written.where(~F.col(OK)).select(f"{RAW}.*", F.col(REASONS).alias("reasons")).withColumnRenamed(LINE, "line")
    counts = seen.get
    return Loaded(good, rejected, int(counts["good"]), int(counts["rejected"]))
