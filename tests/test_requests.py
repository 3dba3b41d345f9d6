"""Requests that can't be met raise; nothing is dropped in silence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from trendlens.__main__ import main
from trendlens.functions.brands import literal_list
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.plans import brand, catalog, trending
from trendlens.session import scratch_path
from trendlens.sources import fixtures as fx
from trendlens.sources.readers import infer_types, read_csv, read_table
from trendlens.sources.writers import tee, write_csv, write_parquet, write_partitioned


@pytest.fixture(scope="module")
def bare(spark):
    return spark.createDataFrame([("a", 3), ("b", 5)], "topic string, raw_conversations bigint")


def test_filters_without_their_column_raise(bare):
    for request in ({"level1": "X"}, {"level2": "Y"}, {"date_range": "2024-01-05"}):
        with pytest.raises(ValueError):
            trending.top_topics(bare, **request)
    kw = bare.select(F.col("topic").alias("keyword"), F.col("raw_conversations").alias("volume"))
    with pytest.raises(ValueError):
        brand.keyword_filters(kw, country="US")
    with pytest.raises(ValueError):
        brand.keyword_filters(kw, date_range=("2024-01-01", None))
    assert trending.top_topics(bare, level1="All", level2=None).count() == 2


@pytest.mark.parametrize("text", ["2024-01-0512", "2024-01-05 10:00", "05.01.2024", ""])
def test_dates_are_read_whole(text):
    with pytest.raises(ValueError):
        flt.normalise_range((text, None))


def test_open_ranges(spark):
    day = lambda d: dt.date(2024, 1, d)
    df = spark.createDataFrame([(day(1),), (day(2),), (day(3),), (None,)], "date date")
    count = lambda r: flt.by_dates(df, "date", r).count()
    assert [count(r) for r in (("2024-01-02", None), (None, "2024-01-02"), (None, None), None, "2024-01-02")] == [2, 2, 4, 4, 1]
    assert trending.caption(date_range=("2024-01-02", None)) == " (dates: from 2024-01-02)"


def test_map_column_on_both_sides_of_the_broadcast_bound(spark):
    kw = fx.keywords(spark, SF_SMALL).withColumn("extra", F.create_map(F.lit("a"), F.col("volume")))
    m = catalog._map(spark, SF_SMALL)
    small = brand.prepare_keywords(kw, m)
    large = brand.prepare_keywords(kw, m, max_broadcast_bytes=0, salts=4)
    cols = [c for c in small.columns if c != "extra"]
    assert rows(small, *cols) == rows(large, *cols)
    assert large.where("extra['a'] = volume").count() == large.count()


def test_csv_keeps_text(spark):
    texts = ["  lead", "trail  ", 'q"r', "two\nlines", "a,b", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = scratch_path(spark, "texts")
    write_csv(df, path)
    assert rows(read_csv(spark, path, schema="id int, text string", multiline=True)) == rows(df)
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    assert tee(df, a, b, fmt="csv") == len(texts)
    for p in (a, b):
        assert rows(read_table(spark, p, file_type="csv", schema="id int, text string", multiline=True)) == rows(df)


def test_csv_days(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 00:00:00' a, timestamp_ntz'2024-01-05 10:30:00' b, date'2024-01-06' c")
    path = scratch_path(spark, "days")
    write_csv(df, path)
    assert [r.value for r in spark.read.text(path).collect()][-1] == "2024-01-05,2024-01-05 10:30:00,2024-01-06"


def test_null_tokens_in_typed_columns(spark):
    path = scratch_path(spark, "typed")
    spark.createDataFrame([("a", "1", "2024-01-05"), ("NA", "NA", "null"), ("c", "x", "NaN")], "k string, n string, d string").write.csv(path, header=True)
    schema = "k string, n bigint, d date"
    assert rows(read_csv(spark, path, schema=schema, pandas_na=True, mode="PERMISSIVE")) == sorted(
        [("a", 1, dt.date(2024, 1, 5)), (None, None, None), ("c", None, None)], key=repr
    )
    assert read_csv(spark, path, schema=schema, pandas_na=True, mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="not a bigint"):
        read_csv(spark, path, schema=schema, pandas_na=True).collect()
    typed = infer_types(spark.createDataFrame([("1", "1.5", "x", None), (None, "2", "y", None)], "a string, b string, c string, d string"))
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string", "string"]


def test_date_format_of_a_table(spark):
    path = scratch_path(spark, "dates") + ".csv"
    spark.createDataFrame([("05/01/2024",)], "date string").write.csv(path, header=True)
    out = read_table(spark, path, schema="date string", date_format="dd/MM/yyyy").collect()
    assert out[0].date == dt.datetime(2024, 1, 5)


def test_odd_list_cells():
    assert literal_list(r"['\ud800',]") == []
    assert literal_list("[0x" + "f" * 6000 + "]") == []
    assert literal_list("('a', 1, None, True)") == ["a", "1", "True"]


def test_partitioned_write(spark):
    path = scratch_path(spark, "parts")
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id").repartition(16)
    assert write_partitioned(df, path, ["k"], max_records_per_file=200) == 1000
    files = spark.read.parquet(path).select(F.input_file_name().alias("f"), "k").distinct().groupBy("k").count().collect()
    assert all(r["count"] <= 16 for r in files) and sum(r["count"] for r in files) <= 12
    with pytest.raises(Exception, match="empty text in partition column"):
        write_partitioned(spark.createDataFrame([("", 1)], "k string, v int"), scratch_path(spark, "bad"), ["k"])


def test_info_without_roles(spark, capsys, bare):
    path = scratch_path(spark, "bare") + ".parquet"
    write_parquet(bare, path)
    assert main(["info", path], spark) == 0
    assert "unique_level1" in capsys.readouterr().out
    r = agg.dataset_info(bare, "topic", None, None, None).first()
    assert (r.total_rows, r.unique_topics, r.unique_level1, r.min_date) == (2, 2, None, None)


def test_from_alone_is_open_ended(spark, capsys):
    path = scratch_path(spark, "facts") + ".parquet"
    write_parquet(fx.topic_facts(spark, SF_SMALL), path)
    assert main(["top", path, "--from", "1996-01-01"], spark) == 0
    assert "dates: from 1996-01-01" in capsys.readouterr().out


def test_lazy_report_writes_for_the_second_output_only(spark):
    rep = brand.overview(fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL))
    first, second = rep.kpis, rep.brands
    files = lambda df: {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    assert any("part.parquet" in f for f in first.inputFiles())
    assert not any("part.parquet" in f for f in second.inputFiles()) and files(second)
    assert rep.kpis is first

