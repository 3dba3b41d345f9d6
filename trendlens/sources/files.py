"""Small text files through Spark's own file systems, whatever the store."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, without hidden ones; none if it isn't there."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(n for n in found if not n.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    """The whole file or none of it: it is written beside its place and renamed.
    Without ``overwrite`` a file that is there already is an error."""
    folder, name = path.rsplit("/", 1)
    beside, fs = _fs(spark, f"{folder}/.{name}.{os.urandom(8).hex()}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(beside, jvm.org.apache.hadoop.fs.Path(path), how)
    except Exception:
        fs.delete(beside, False)
        raise


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def listing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Path, size and time of each file, in the order of the paths."""
    out = []
    for path in sorted(paths):
        at, fs = _fs(spark, path)
        status = fs.getFileStatus(at)
        out.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return out
