"""The three logical input tables, derived from the TPC-H-style test tables.

The test tables hold no nulls, no pre-rolled totals and no list text, so the
derivation injects them by key, exactly as the fixture definition in
``FIXTURES.md`` does (the same CTEs are the SQL oracle's inputs).  Everything is
DataFrame API over the whole tables; nothing is sampled.

At scale the fact derivation is two shuffle joins (lineitem to part, lineitem
to supplier); nation is a fixed 25-row dimension and is broadcast by Spark's
own size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared schemas of the test tables that are read: no inference job per read.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: str, k: int):
    return F.col(c) % F.lit(k) == 0


def topic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device, country, topic, level1, level2, raw_messages, raw_users,
    raw_conversations, date."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return j.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("mobile")).otherwise(F.lit("desktop")).alias("device"),
        F.when(_mod("n_nationkey", 9), F.lit(None)).otherwise(F.col("n_name")).alias("country"),
        F.when(_mod("p_partkey", 41), F.lit(None))
        .when(_mod("p_partkey", 17), F.lit("all"))
        .when(_mod("p_partkey", 19), F.lit("Total"))
        .otherwise(F.col("p_name"))
        .alias("topic"),
        F.when(_mod("p_partkey", 23), F.lit(None)).otherwise(F.col("p_type")).alias("level1"),
        F.when(_mod("p_partkey", 10), F.lit(None)).otherwise(F.col("p_brand")).alias("level2"),
        F.col("l_linenumber").cast("bigint").alias("raw_messages"),
        (F.col("l_linenumber") + 1).cast("bigint").alias("raw_users"),
        F.col("l_quantity").cast("bigint").alias("raw_conversations"),
        F.when(_mod("l_orderkey", 50), F.lit(None).cast("date"))
        .otherwise(F.col("l_shipdate").cast("date"))
        .alias("date"),
    )


def map_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file the category map is projected from: topic, category,
    sub_category (the fixture keeps ``PROMO`` categories out of it)."""
    facts = topic_facts(spark, sf_dir)
    return facts.filter(F.col("level1").isNull() | (F.col("level1") != "PROMO")).select(
        "topic", F.col("level1").alias("category"), F.col("level2").alias("sub_category")
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, volume, brands, level1, level2, country, date."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brand_text = F.concat(
        F.lit("['"),
        F.col("p_brand"),
        F.lit("', 'Brand#"),
        (F.col("p_partkey") % 25 + 1).cast("string"),
        F.lit("']"),
    )
    return part.select(
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("keyword"),
        (F.col("p_size") * 10).cast("bigint").alias("volume"),
        F.when(_mod("p_partkey", 13), F.lit(None))
        .when(_mod("p_partkey", 7), F.lit("[]"))
        .when(_mod("p_partkey", 11), F.lit("not a list"))
        .otherwise(brand_text)
        .alias("brands"),
        F.when(_mod("p_partkey", 23), F.lit(None)).otherwise(F.col("p_type")).alias("level1"),
        F.when(_mod("p_partkey", 10), F.lit(None)).otherwise(F.col("p_brand")).alias("level2"),
        F.when(_mod("p_partkey", 29), F.lit(None))
        .when(_mod("p_partkey", 3), F.lit("US"))
        .otherwise(F.lit("DE"))
        .alias("country"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("date"),
    )


def hot_pair(kw: DataFrame) -> DataFrame:
    """Keyword rows with a third of them on the pair (``HOT``, null)."""
    hot = F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint") % 3 == 0
    return kw.withColumn("level1", F.when(hot, F.lit("HOT")).otherwise(F.col("level1"))).withColumn(
        "level2", F.when(~hot, F.col("level2"))
    )


def hot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map with one topic for each part, a third of them on (``HOT``, null)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    hot = _mod("p_partkey", 3)
    return part.select(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("topic"),
        F.when(hot, F.lit("HOT")).otherwise(F.col("p_type")).alias("category"),
        F.when(~hot, F.col("p_brand")).alias("sub_category"),
    )


# List literals beyond plain lists, by p_partkey % 7.
ODD_LISTS = ("['A', 'B',]", "('A', 'x')", r"['it\'s']", "[1, 2.5, True, None, 'z']", r"['\ud800',]", "{'a': 1}")


def odd_brand_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords whose brand cells hold odd list literals."""
    kw = keywords(spark, sf_dir).withColumn("_k", F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint") % 7)
    cell = F.col("brands")
    for i, text in enumerate(ODD_LISTS):
        cell = F.when(F.col("_k") == i, F.lit(text)).otherwise(cell)
    return kw.withColumn("brands", cell).drop("_k")


AWKWARD_SCHEMA = "id bigint, text string, day timestamp_ntz"


def awkward_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with edge blanks, quotes, commas and line breaks; pure days."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.col("p_name")
    text = (
        F.when(_mod("p_partkey", 5), F.concat(F.lit("  "), name, F.lit(" ")))
        .when(_mod("p_partkey", 4), F.concat(F.lit('say "'), name, F.lit('", twice')))
        .when(_mod("p_partkey", 3), F.concat(name, F.lit("\nsecond line")))
        .when(_mod("p_partkey", 7), F.lit(None))
        .otherwise(name)
    )
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).cast("timestamp_ntz")
    return part.select(F.col("p_partkey").alias("id"), text.alias("text"), day.alias("day"))


def typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, volume and date as text, some cells a null token."""
    kw = keywords(spark, sf_dir).withColumn("_k", F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint"))
    volume = F.when(F.col("_k") % 4 == 0, F.lit("NA")).when(F.col("_k") % 9 == 0, F.lit("null")).otherwise(F.col("volume").cast("string"))
    day = F.when(F.col("_k") % 6 == 0, F.lit("NaN")).otherwise(F.col("date").cast("string"))
    return kw.select("keyword", volume.alias("volume"), day.alias("date"))
