"""Hot keys: one (category, sub_category) pair holding a third of all keyword
rows, derived from the test tables."""

import pytest
from pyspark.sql import functions as F

from helpers import SF_ORACLE, rows
from trendlens.operators.joins import attach_topics, attach_topics_salted, attach_topics_to_pairs
from trendlens.plans import brand, catalog
from trendlens.sources import fixtures as fx


def _skewed_keywords(spark):
    kw = fx.keywords(spark, SF_ORACLE)
    k = F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint")
    hot = k % 3 == 0
    return kw.withColumn("level1", F.when(hot, F.lit("HOT")).otherwise(F.col("level1"))).withColumn(
        "level2", F.when(hot, F.lit(None)).otherwise(F.col("level2"))
    )


def _tasks_holding_hot_pair(df):
    per_task = (
        df.filter((F.col("level1") == "HOT") & F.col("level2").isNull())
        .groupBy(F.spark_partition_id().alias("task"))
        .count()
    )
    return per_task.count()


def test_salted_join_spreads_a_hot_pair(spark):
    kw = _skewed_keywords(spark)
    tmap = catalog._map(spark, SF_ORACLE).union(
        spark.createDataFrame([("hot topic", "HOT", None)], "topic string, category string, sub_category string")
    )
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the raw shuffle layout
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain = attach_topics(kw, tmap)
        salted = attach_topics_salted(kw, tmap, salts=8, heavy_rows=100)
        assert _tasks_holding_hot_pair(plain) == 1
        assert _tasks_holding_hot_pair(salted) >= 4
        assert rows(salted) == rows(plain)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_salted_semi_join_for_large_pair_lists(spark):
    from trendlens.plans import brand

    kw, m = brand.with_lists(fx.keywords(spark, SF_ORACLE)), catalog._map(spark, SF_ORACLE)
    topics = brand.pair_topics(kw, m).filter(F.col("topic").contains("red"))
    a = brand.eager_top_keywords(kw, topics, semi=True)
    b = brand.eager_top_keywords(kw, topics, semi=True, max_broadcast_bytes=-1)
    assert rows(a) == rows(b) and len(rows(a)) == 50


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_hot_map_pair_is_spread(spark, adaptive):
    """A third of the *map* on one pair: its topic rows come out of several tasks."""
    pairs = fx.hot_pair(fx.keywords(spark, SF_ORACLE)).select("level1", "level2").distinct()
    tmap = fx.hot_map(spark, SF_ORACLE)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    saved["spark.sql.adaptive.coalescePartitions.enabled"] = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        split = attach_topics_to_pairs(pairs, tmap)
        plain = attach_topics(pairs, tmap)
        assert _tasks_holding_hot_pair(plain) == 1
        assert _tasks_holding_hot_pair(split) >= 4
        assert rows(split, *plain.columns) == rows(plain)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_broadcast_fan_out_runs_in_all_tasks(spark):
    """Keywords of one split and a broadcast map: the copies are made in all tasks."""
    kw = spark.createDataFrame(
        [(f"k{i}", i, None, "A" if i % 3 else None, "B") for i in range(200)],
        "keyword string, volume long, brands string, level1 string, level2 string",
    ).coalesce(1)
    kw = kw.withColumn("date", F.lit("2024-01-01").cast("date"))
    tmap = spark.createDataFrame([(f"t{i}", "A", "B") for i in range(20)], "topic string, category string, sub_category string")
    expected = rows(attach_topics(kw, tmap), "keyword", "topic")
    for out in (brand.prepare_keywords(kw, tmap), brand.rows_from_topics(kw, brand.pair_topics(kw, tmap), 0)):
        assert rows(out, "keyword", "topic") == expected
        per_task = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(per_task) == 8 and max(r["count"] for r in per_task) < len(expected) / 2
