"""The keyword-to-topic join over tables that are dealt once.

Keywords and map are written as bucketed tables on one key, a text of the
(category, sub-category) pair in which nulls equal nulls, and a salt.  A report
then joins bucket to bucket: neither side is shuffled again.  Pairs with very
many keywords are split when the tables are written: their keywords are salted
and their map rows repeated once per salt, so that a bucket does not grow with
the hottest pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.labels import mapped_label
from trendlens.operators.joins import DEFAULT_SALTS, HEAVY_ROWS, heavy_pairs
from trendlens.sources.writers import materialize

PAIR, SALT = "_pair", "_salt"


def pair_key(level1: str, level2: str) -> Column:
    """One text for each pair: the length of the first tells the two apart, and
    a null has none."""
    one = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.concat(one(level1), F.lit("/"), one(level2))


def _write(df: DataFrame, table: str, path: str, buckets: int) -> None:
    dealt = df.repartition(buckets, PAIR, SALT)  # as bucketing deals: one file a bucket
    dealt.write.bucketBy(buckets, PAIR, SALT).sortBy(PAIR, SALT).option("path", path).saveAsTable(table)


def write_bucketed(
    keywords: DataFrame,
    tmap: DataFrame,
    tables: tuple[str, str],
    path: str,
    buckets: int,
    salts: int = DEFAULT_SALTS,
    heavy_rows: int = HEAVY_ROWS,
    level1: str = "level1",
    level2: str = "level2",
) -> None:
    """Saves both sides as tables of ``buckets`` buckets below ``path``."""
    heavy = materialize(heavy_pairs(keywords, level1, level2, salts, heavy_rows), "heavy_pairs")  # 4 x salts rows at most
    hot = heavy.select(pair_key("_a", "_b").alias("_hot"))
    scalars = [F.col(f.name) for f in keywords.schema.fields if isinstance(f.dataType, T.AtomicType)]

    def marked(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn(PAIR, pair_key(a, b)).join(F.broadcast(hot), F.col(PAIR) == F.col("_hot"), "left")

    is_hot = F.col("_hot").isNotNull()
    salt = F.pmod(F.xxhash64(*scalars, F.spark_partition_id()), F.lit(salts)).cast("int")
    left = marked(keywords, level1, level2).withColumn(SALT, F.when(is_hot, salt).otherwise(0)).drop("_hot")
    _write(left, tables[0], f"{path}/keywords", buckets)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(tmap.select("topic", "category", "sub_category"), "category", "sub_category")
    _write(right.withColumn(SALT, F.explode(copies)).drop("_hot"), tables[1], f"{path}/map", buckets)


def attach_topics_bucketed(spark: SparkSession, tables: tuple[str, str], level1: str = "level1", level2: str = "level2") -> DataFrame:
    """:func:`trendlens.operators.joins.attach_topics` of the two tables."""
    k, m = spark.table(tables[0]), spark.table(tables[1]).withColumnRenamed("topic", "_map_topic")
    rest = [c for c in k.columns if c not in (PAIR, SALT, "topic")]
    joined = k.drop("topic").join(m.hint("merge"), [PAIR, SALT], "left")
    label = mapped_label(F.col("_map_topic"), F.col(level1), F.col(level2)).alias("topic")
    return joined.select(*rest, label, "category", "sub_category")
