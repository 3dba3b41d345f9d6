"""Readers and writers: format detection, CSV dialect, null tokens, exports."""

import os

import pytest

from helpers import rows
from trendlens.functions.nulls import PANDAS_NA_TOKENS
from trendlens.session import scratch_path
from trendlens.sources import readers, writers


def test_detect_format():
    assert readers.detect_format("s3a://b/x.parquet") == "parquet"
    assert readers.detect_format("/d/x.PQ") == "parquet"
    assert readers.detect_format("/d/x.csv") == "csv"
    assert readers.detect_format("/d/x.txt") == "csv"
    assert readers.detect_format("/d/x.txt", "parquet") == "parquet"
    with pytest.raises(ValueError):
        readers.detect_format("/d/x", "excel")


def test_http_is_no_file_read(spark):
    for read in (readers.read_csv, readers.read_parquet):
        with pytest.raises(ValueError, match="read_table"):
            read(spark, "https://example.invalid/x.csv")


def test_csv_text_round_trip_like_pandas(spark):
    df = spark.createDataFrame([("q\"r", 1), ("", 2), (None, 3)], "t string, n bigint")
    path = scratch_path(spark, "csvtext")
    assert writers.write_csv(df, path, single_file=True) == 3
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(files) == 1
    text = open(os.path.join(path, files[0])).read().splitlines()
    assert text == ["t,n", '"q""r",1', ",2", ",3"]
    back = readers.read_csv(spark, path, schema="t string, n bigint")
    assert rows(back) == sorted([("q\"r", 1), (None, 2), (None, 3)], key=repr)


def test_pandas_null_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("ok",), ("n/a",), (" NA",)], "c string")
    out = readers.normalise_nulls(df, PANDAS_NA_TOKENS)
    assert rows(out) == sorted([(None,), (None,), ("ok",), (None,), (" NA",)], key=repr)


def test_arrays_exported_as_json(spark):
    df = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    path = scratch_path(spark, "arr")
    writers.write_csv(df, path)
    back = readers.read_csv(spark, path, schema="l string")
    assert back.first().l == '["a","b"]'


def test_tee_writes_two_equal_copies(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    a, b = scratch_path(spark, "tee_a"), scratch_path(spark, "tee_b")
    assert writers.tee(df, a, b) == 100
    assert rows(spark.read.parquet(a)) == rows(spark.read.parquet(b)) == rows(df)


def test_partitioned_write_prunes(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 3 AS STRING) AS k")
    path = scratch_path(spark, "part")
    writers.write_partitioned(df, path, ["k"])
    back = spark.read.schema(df.schema).parquet(path)
    assert rows(back.select("id", "k")) == rows(df)
    plan = back.filter("k = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_export_name():
    assert writers.export_name("A/B", "c d") == "filtered_topics_A_B_c_d.csv"
    assert writers.export_name() == "filtered_topics_All_All.csv"


def test_hash_sample_is_deterministic(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 AS k")
    a = writers.hash_sample(df, ["k"], 5, 0)
    assert rows(a) == rows(writers.hash_sample(df.repartition(7), ["k"], 5, 0))
    keys = {r.k for r in a.collect()}
    assert all(r.k in keys for r in df.collect() if r.k in keys)
    assert a.count() % 100 == 0


def test_materialize_survives_as_files(spark):
    df = spark.range(10)
    m = writers.materialize(df, "mat")
    assert rows(m) == rows(df)
    assert "InMemoryTableScan" not in m._jdf.queryExecution().executedPlan().toString()


def test_portable_hash_sample(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 10 AS STRING) AS k", "IF(id % 7 = 0, NULL, 'x') AS n")
    a = writers.hash_sample(df, ["k", "n"], 3, 1, hash="md5")
    assert rows(a) == rows(writers.hash_sample(df.repartition(5), ["k", "n"], 3, 1, hash="md5"))
    assert 0 < a.count() < 1000
    with pytest.raises(ValueError):
        writers.hash_sample(df, ["k"], 3, 0, hash="crc")


def test_parse_dates_with_format(spark):
    import datetime as dt

    df = spark.createDataFrame([("02/01/2024",), ("bad",)], "date string")
    got = [r.date for r in readers.parse_dates(df, fmt="dd/MM/yyyy", on_bad="null").collect()]
    assert got == [dt.datetime(2024, 1, 2), None]


def test_csv_failure_modes(spark):
    path = scratch_path(spark, "malformed")
    good = spark.createDataFrame([("a", "1"), ("b", "x")], "t string, n string")
    writers.write_csv(good, path)
    schema = "t string, n bigint"
    with pytest.raises(Exception):
        readers.read_csv(spark, path, schema=schema).collect()
    kept = readers.read_csv(
        spark, path, schema="t string, n bigint, _bad string", mode="PERMISSIVE", corrupt_column="_bad"
    )
    assert rows(kept.select("t", "n")) == [("a", 1), ("b", None)]
    assert sum(r._bad is not None for r in kept.collect()) == 1
    dropped = readers.read_csv(spark, path, schema=schema, mode="DROPMALFORMED")
    assert rows(dropped) == [("a", 1)]


def test_tee_csv(spark):
    df = spark.createDataFrame([('q"r', 1), (None, 2)], "t string, n bigint")
    a, b = scratch_path(spark, "tee_csv_a"), scratch_path(spark, "tee_csv_b")
    assert writers.tee(df, a, b, fmt="csv") == 2
    schema = "t string, n bigint"
    assert rows(readers.read_csv(spark, a, schema=schema)) == rows(readers.read_csv(spark, b, schema=schema)) == rows(df)


def test_chunk_size_warns(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    with pytest.warns(UserWarning, match="no effect"):
        assert readers.read_table(spark, f"{tmp_path}/t", file_type="parquet", chunk_size=1000).count() == 3
