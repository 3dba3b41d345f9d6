"""Results kept in the shared folder for later sessions.

A result's key is a hash of its plan, with names and types of its columns, and
of the files it reads, with their sizes and times.  Another filter, or a file
that was changed, added or removed, is therefore another key: nothing is
ever stale, and nothing has to be told.  A result counts once its marker is
there, which is written whole and by one writer only; who comes second reads the
first one's rows.
"""

from __future__ import annotations

import hashlib
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from trendlens.session import shared_dir
from trendlens.sources import files

MARKER = "current"
#: Leaves of a plan whose rows are files, so that the listing tells a change.
FILE_LEAVES = ("LogicalRelation", "OneRowRelation")


def _plan(df: DataFrame) -> str:
    """The canonical plan as text, no field left out."""
    spark, limit = df.sparkSession, "spark.sql.debug.maxToStringFields"
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if kinds - set(FILE_LEAVES) or not df.inputFiles():
        raise ValueError(f"only results of files can be kept, not of {sorted(kinds)}")
    before = spark.conf.get(limit)
    spark.conf.set(limit, str((1 << 31) - 1))
    try:
        text = plan.canonicalized().toString()
    finally:
        spark.conf.set(limit, before)
    # a function's name does not tell its code
    foreign = any(part in node for node in _nodes(df._jdf.queryExecution().optimizedPlan()) for part in ("Python", "MapIn", "FlatMap", "MapPartitions"))
    if not plan.deterministic() or foreign or "UDF(" in text:
        raise ValueError("only results of deterministic built-in functions can be kept")
    return text


def _nodes(plan) -> list[str]:
    """Names of the plan's nodes."""
    below = plan.children()
    return [plan.nodeName(), *(n for i in range(below.size()) for n in _nodes(below.apply(i)))]


def result_key(df: DataFrame) -> str:
    parts = [_plan(df), df.schema.json(), *files.listing(df.sparkSession, df.inputFiles())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def cache_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trendlens/results"


def kept(df: DataFrame, root: str | None = None) -> DataFrame:
    """``df`` from the kept result, which is computed and written if there is
    none yet.  The result must come from files by deterministic built-in
    functions; anything else raises ``ValueError``."""
    spark = df.sparkSession
    folder = f"{root or cache_root(spark)}/{result_key(df)}"
    if MARKER not in files.names(spark, folder):
        name = f"rows-{os.urandom(8).hex()}"
        df.write.parquet(f"{folder}/{name}")
        try:
            files.write_text(spark, f"{folder}/{MARKER}", name, overwrite=False)
        except Py4JJavaError:  # another writer was first
            if MARKER not in files.names(spark, folder):
                raise
            files.delete(spark, f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{files.read_text(spark, f'{folder}/{MARKER}')}")


def forget(df: DataFrame, root: str | None = None) -> None:
    """Deletes the kept result of ``df``, if there is one."""
    files.delete(df.sparkSession, f"{root or cache_root(df.sparkSession)}/{result_key(df)}")
