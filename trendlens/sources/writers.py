"""Sinks and data-preparation jobs.

Writers are the only functions that run a Spark job.  By default they write in
parallel, one file per task.  ``single_file=True`` (the export jobs' "one file
to download") funnels the *final* write through one task with
``repartition(1)``, which at least keeps the upstream stages parallel
(``coalesce(1)`` would pull the whole upstream into that one task); it is meant
for small, already filtered or aggregated outputs, never for a full table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.operators.aggregate import total
from trendlens.session import scratch_path

WRITE_MODES = ("overwrite", "append", "error", "errorifexists", "ignore")


def arrays_as_text(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text (R4): CSV holds only scalars."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def days_as_text(df: DataFrame) -> DataFrame:
    """Date-times as text: a pure day as ``yyyy-MM-dd``, else with its time."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            pure = c == F.date_trunc("day", c)
            c = F.when(pure, F.date_format(c, "yyyy-MM-dd")).otherwise(c.cast("string")).alias(f.name)
        out.append(c)
    return df.select(*out)


def _prepare(df: DataFrame, single_file: bool, partition_by: Sequence[str] | None) -> DataFrame:
    if single_file and partition_by:
        raise ValueError("single_file and partition_by exclude each other")
    return df.repartition(1) if single_file else df


def _writer(df: DataFrame, mode: str, partition_by, max_records_per_file):
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    return w


def write_csv(
    df: DataFrame,
    path: str,
    single_file: bool = False,
    mode: str = "overwrite",
    header: bool = True,
    partition_by: Sequence[str] | None = None,
    max_records_per_file: int | None = None,
) -> int:
    """CSV with a header, quotes doubled, blanks kept, empty text and null both
    written as an empty cell, days without a time, as pandas writes them (A12,
    A15).  Returns the row count, observed during the write itself (A18), so
    the plan runs once."""
    out = _prepare(days_as_text(arrays_as_text(df)), single_file, partition_by)
    obs = Observation("rows_written")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    (
        _writer(out, mode, partition_by, max_records_per_file)
        .option("header", "true" if header else "false")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    return int(obs.get["rows"])


def write_parquet(
    df: DataFrame,
    path: str,
    single_file: bool = False,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    max_records_per_file: int | None = None,
) -> int:
    """Parquet (A13, A19); returns the observed row count."""
    out = _prepare(df, single_file, partition_by)
    obs = Observation("rows_written")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    _writer(out, mode, partition_by, max_records_per_file).parquet(path)
    return int(obs.get["rows"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **kw) -> int:
    if fmt == "parquet":
        return write_parquet(df, path, **kw)
    if fmt == "csv":
        return write_csv(df, path, **kw)
    raise ValueError(f"unknown format {fmt!r}")


def tee(df: DataFrame, first: str, second: str, fmt: str = "parquet", **kw) -> int:
    """The same rows at two paths.

    The upstream runs once.  A Parquet copy is written from the first one's
    files; CSV does not hold types, so both CSV copies are written from one
    Parquet frame below ``spark.checkpoint.dir``.  The observed row counts
    must agree.
    """
    if fmt == "csv":
        df = materialize(df, "tee")
    n = write_table(df, first, fmt, **kw)
    again = df if fmt == "csv" else df.sparkSession.read.schema(df.schema).parquet(first)
    m = write_table(again, second, fmt, **kw)
    if m != n:
        raise RuntimeError(f"{n} rows at {first}, {m} at {second}")
    return n


_UNSAFE = re.compile(r"[/\\\s]+")
# Fixed value: file-name prefix of the filtered-rows export.
EXPORT_PREFIX = "filtered_topics"


def export_name(level1: str | None = None, level2: str | None = None, prefix: str = EXPORT_PREFIX) -> str:
    """``filtered_topics_{level1}_{level2}.csv`` (A16), path-safe."""
    parts = [prefix, str(level1 if level1 is not None else "All"), str(level2 if level2 is not None else "All")]
    return _UNSAFE.sub("_", "_".join(parts)) + ".csv"


def rollup(
    df: DataFrame,
    keys: Sequence[str] = ("date", "level1", "level2", "topic"),
    metrics: Sequence[str] = ("raw_conversations", "raw_messages", "raw_users"),
) -> DataFrame:
    """Pre-aggregated table (A20): sums per key tuple, null keys kept as groups
    so that totals over the rollup equal totals over the detail rows."""
    return df.groupBy(*keys).agg(*[total(m, m) for m in metrics])


#: Rows a partitioned write puts into one file of a key at most, about.
ROWS_PER_FILE = 5_000_000


def spread_by_key(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt by key, a key of many rows over several tasks.

    One count per key (a small frame) says into how many parts a key falls; a
    row's part is a hash of its own columns.  So a key has as many files as its
    rows need, not one from every task, and a hot key is not one task.
    """
    renamed = {k: f"_key{i}" for i, k in enumerate(keys)}
    parts = df.groupBy(*[F.col(k).alias(v) for k, v in renamed.items()]).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).cast("int").alias("_parts")
    )
    parts = materialize(parts, "key_parts")  # a row for each key: joined by its written size, without dealing by the hot key
    same = None
    for k, v in renamed.items():
        cond = df[k].eqNullSafe(parts[v])
        same = cond if same is None else same & cond
    hashed = [F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    dealt = df.join(parts, same, "left").withColumn("_part", F.pmod(F.xxhash64(*hashed), F.col("_parts")))
    return dealt.repartition(*[F.col(k) for k in keys], F.col("_part")).select(*df.columns)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    max_records_per_file: int | None = ROWS_PER_FILE,
) -> int:
    """Split into smaller files by column values (A19); later reads that filter
    on ``partition_by`` skip whole folders.

    A folder name cannot tell an empty text from a null, so an empty text in a
    key column is an error.
    """
    keys = list(partition_by)
    texts = [f.name for f in df.schema.fields if f.name in keys and isinstance(f.dataType, T.StringType)]
    for c in texts:
        message = F.lit(f"empty text in partition column {c}")
        df = df.withColumn(c, F.when(F.col(c) == "", F.raise_error(message).cast("string")).otherwise(F.col(c)))
    spread = spread_by_key(df, keys, max_records_per_file or ROWS_PER_FILE)
    return write_table(spread, path, fmt, partition_by=keys, max_records_per_file=max_records_per_file)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing Parquet under ``spark.checkpoint.dir`` and
    reading it back; unlike ``localCheckpoint`` it survives executor loss."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table that are worth a task of their own.
ROWS_PER_TASK = 10_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in as many tasks as they are worth, but one
    for each core at least.  Every shuffle leaves files for each task before it;
    of small tables that are shuffled again and again, these and not the rows
    fill the disks.  A table with many rows keeps its tasks."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample for a first look."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by(df: DataFrame, column: str, fractions: dict, seed: int = 42) -> DataFrame:
    """Stratified sample, one fraction per value of ``column``."""
    return df.sampleBy(column, fractions, seed)


# Key separator and null marker of the portable (md5) sample hash.
HASH_SEPARATOR = "|"
HASH_NULL = "\\N"
HASHES = ("xxhash64", "md5")


def sample_bucket(keys: Iterable[str], buckets: int, hash: str = "xxhash64") -> Column:
    """Bucket ``0 .. buckets-1`` of each row, from a hash of ``keys``.

    ``xxhash64`` is Spark's fast native hash; ``md5`` takes the first 32 bits
    of the MD5 of the keys as text (``|``-joined, null as ``\\N``), which any
    engine with ``md5`` can reproduce.
    """
    keys = list(keys)
    if hash == "xxhash64":
        h = F.xxhash64(*[F.col(k) for k in keys])
    elif hash == "md5":
        text = F.concat_ws(HASH_SEPARATOR, *[F.coalesce(F.col(k).cast("string"), F.lit(HASH_NULL)) for k in keys])
        h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    else:
        raise ValueError(f"hash must be one of {HASHES}")
    return F.pmod(h, F.lit(buckets))


def hash_sample(df: DataFrame, keys: Iterable[str], buckets: int, keep: int = 0, hash: str = "xxhash64") -> DataFrame:
    """Deterministic sample by key hash (A22): every row of a kept key is kept,
    whatever the partitioning, so samples of related tables stay joinable."""
    if buckets <= 0 or not 0 <= keep < buckets:
        raise ValueError("need buckets > 0 and 0 <= keep < buckets")
    return df.filter(sample_bucket(keys, buckets, hash) == keep)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows for display."""
    return df.limit(n)
