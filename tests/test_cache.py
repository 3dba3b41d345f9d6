"""Kept results: hits, misses after a change, writers at a time."""

import threading

import pytest
from pyspark.sql import functions as F

from helpers import rows
from trendlens.session import scratch_path
from trendlens.sources import cache, files


@pytest.fixture
def table(spark):
    path = scratch_path(spark, "table")
    spark.range(100).selectExpr("id", "id % 7 AS k", "concat('t', id) AS t").repartition(3).write.parquet(path)
    return path


def sums(spark, path, least=0):
    return spark.read.parquet(path).where(F.col("id") >= least).groupBy("k").agg(F.sum("id").alias("s"))


def test_the_second_call_reads_the_kept_rows(spark, table):
    root = scratch_path(spark, "results")
    first = cache.kept(sums(spark, table), root)
    again = cache.kept(sums(spark, table), root)
    assert rows(first) == rows(again) == rows(sums(spark, table))
    assert again.inputFiles() == first.inputFiles() and all(root.removeprefix("file:") in f for f in again.inputFiles())
    assert len(files.names(spark, root)) == 1
    assert rows(cache.kept(sums(spark, table, 50), root)) == rows(sums(spark, table, 50))  # another filter
    renamed = sums(spark, table).withColumnRenamed("s", "total")
    assert cache.kept(renamed, root).columns == ["k", "total"] and len(files.names(spark, root)) == 3


def test_a_changed_table_is_computed_anew(spark, table):
    root = scratch_path(spark, "results")
    before = rows(cache.kept(sums(spark, table), root))
    spark.range(100, 120).selectExpr("id", "id % 7 AS k", "'x' AS t").write.mode("append").parquet(table)
    after = rows(cache.kept(sums(spark, table), root))
    assert after != before and after == rows(sums(spark, table))
    cache.forget(sums(spark, table), root)
    assert len(files.names(spark, root)) == 1
    assert rows(cache.kept(sums(spark, table), root)) == after


def test_writers_at_a_time_and_half_written_results(spark, table):
    root, got = scratch_path(spark, "results"), []
    folder = f"{root}/{cache.result_key(sums(spark, table))}"
    sums(spark, table, 90).write.parquet(f"{folder}/rows-lost")  # without a marker
    run = lambda: got.append(rows(cache.kept(sums(spark, table), root)))
    threads = [threading.Thread(target=run) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [rows(sums(spark, table))] * 4
    assert len(files.names(spark, folder)) == 3  # the marker, its rows, and the lost ones


def test_long_plans_differ_in_their_last_field(spark, table):
    def wide(last):
        return spark.read.parquet(table).select(*[(F.col("id") + k).alias(f"c{k}") for k in range(60)], F.lit(last).alias("z"))

    assert cache.result_key(wide(1)) != cache.result_key(wide(2)) and cache.result_key(wide(1)) == cache.result_key(wide(1))


def test_what_no_listing_can_tell_is_refused(spark, table):
    frame = spark.read.parquet(table)
    for df in (
        spark.createDataFrame([(1,)], "a int"),
        frame.join(spark.createDataFrame([(1,)], "id long"), "id"),
        frame.withColumn("r", F.rand()),
        frame.withColumn("u", F.udf(lambda x: x, "long")("id")),
    ):
        with pytest.raises(ValueError, match="can be kept"):
            cache.kept(df)
