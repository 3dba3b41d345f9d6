"""Category map and keyword-to-topic join.

The map holds *several* topics per (category, sub_category) pair, so the left
join fans a keyword out to one row per topic of its pair; the reports count
those copies, as the dashboard did ("volume attributed in full to each topic").
Keys match null to null (``<=>``), which Spark plans as an ordinary hash or
sort-merge join on null-aware keys, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.labels import fallback_label, mapped_label
from trendlens.operators.filters import MAP_EXCLUDED_TOPIC, drop_value_keep_null

# Estimated bytes above which a frame is never broadcast, even when asked to
# "auto".
DEFAULT_BROADCAST_MAX_BYTES = 32 << 20
# Buckets a heavy (category, sub_category) pair is split into: a pair holding a
# third of all rows still spreads over this many tasks.
DEFAULT_SALTS = 32
# A pair is heavy from this many rows, and never more than 4 x salts of them are.
HEAVY_ROWS = 10_000


def topic_map(
    facts: DataFrame,
    topic: str = "topic",
    category: str = "category",
    sub_category: str = "sub_category",
) -> DataFrame:
    """Distinct (topic, category, sub_category) less topic ``all``.

    The filter sits below the distinct, so it reaches the scan; the distinct is a
    partial + final aggregate, so hot pairs collapse map-side.
    """
    m = facts.select(
        F.col(topic).alias("topic"),
        F.col(category).alias("category"),
        F.col(sub_category).alias("sub_category"),
    )
    return drop_value_keep_null(m, "topic", MAP_EXCLUDED_TOPIC).distinct()


def write_and_measure(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` under ``spark.checkpoint.dir``, read it back; the estimated
    bytes of its rows in memory (16 for each value, plus the texts)."""
    from trendlens.sources.writers import materialize

    written = materialize(df, "broadcast_candidate")
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    return written, int(written.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all shuffle partitions, before a broadcast join that turns
    each into many.  Such a join runs in the tasks of its input, and a table of
    short rows is one or a few splits, however many rows come out of it."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)


def attach_topics(
    keywords: DataFrame,
    tmap: DataFrame | None,
    level1: str = "level1",
    level2: str = "level2",
) -> DataFrame:
    """Give every keyword row its topic label (D1 + B5, or B6 without a map).

    Output: the keyword columns (any old ``topic`` dropped), then ``topic``,
    ``category``, ``sub_category`` from the map (null when nothing matched).
    The join strategy is Spark's (size statistics, AQE) unless the map carries
    a broadcast hint.
    """
    kw = keywords.drop("topic") if "topic" in keywords.columns else keywords
    if tmap is None:
        return kw.withColumn("topic", fallback_label(level1, level2))
    m = tmap.select(
        F.col("topic").alias("_map_topic"),
        F.col("category"),
        F.col("sub_category"),
    )
    cond = F.col(f"k.{level1}").eqNullSafe(F.col("m.category")) & F.col(f"k.{level2}").eqNullSafe(
        F.col("m.sub_category")
    )
    joined = kw.alias("k").join(m.alias("m"), cond, "left")
    return joined.select(
        *[F.col(f"k.{c}") for c in kw.columns],
        mapped_label(F.col("m._map_topic"), F.col(f"k.{level1}"), F.col(f"k.{level2}")).alias("topic"),
        F.col("m.category"),
        F.col("m.sub_category"),
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    pairs: list[tuple[str, str]],
    how: str,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Null-safe equi-join on ``pairs`` (left column, right column) with every
    key split into ``salts`` buckets.

    Left rows get a salt from a hash of their scalar columns and their input
    partition's index (stable when a task is retried); right rows are repeated
    once per salt.  Each left row meets each matching right row exactly once,
    so the result equals the unsalted join, and a key holding a third of the
    left rows is spread over ``salts`` tasks.  Left columns come out as
    ``l.<name>``, right columns as ``r.<name>``.
    """
    if salts < 1:
        raise ValueError("salts must be >= 1")
    # maps and the like can't be hashed; scalars tell rows apart well enough
    scalars = [F.col(f.name) for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salt = F.pmod(F.xxhash64(*scalars, F.spark_partition_id()), F.lit(salts))
    l = left.withColumn("_salt", salt.cast("int")).alias("l")
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    cond = F.col("l._salt") == F.col("r._salt")
    for a, b in pairs:
        cond = cond & F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}"))
    return l.join(r, cond, how)


def heavy_pairs(df: DataFrame, left: str, right: str, salts: int = DEFAULT_SALTS, least: int = HEAVY_ROWS) -> DataFrame:
    """Pairs with at least ``least`` rows and at least 1 / (4 ``salts``) of all:
    4 x ``salts`` rows at most, so the result can be broadcast."""
    counts = df.groupBy(F.col(left).alias("_a"), F.col(right).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * (4 * salts) >= F.col("_all")
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("_all", total).filter((F.col("_n") >= least) & share).select("_a", "_b")


def _by_weight(df: DataFrame, heavy: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy pairs, and all others."""
    cond = df[left].eqNullSafe(heavy["_a"]) & df[right].eqNullSafe(heavy["_b"])
    return df.join(F.broadcast(heavy), cond, "left_semi"), df.join(F.broadcast(heavy), cond, "left_anti")


def attach_topics_salted(
    keywords: DataFrame,
    tmap: DataFrame,
    salts: int = DEFAULT_SALTS,
    level1: str = "level1",
    level2: str = "level2",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """:func:`attach_topics` as a shuffle join that splits the heavy pairs.

    Pairs with many keywords are found by a count; only their keywords get a
    salt, and only their map rows are repeated once per salt.  All other pairs
    are joined as they are.  A keyword meets exactly the map rows of its pair,
    once, so the result equals the plain join, while a hot pair is spread over
    ``salts`` tasks.  Meant for maps too large to broadcast.
    """
    from trendlens.sources.writers import materialize

    kw = keywords.drop("topic") if "topic" in keywords.columns else keywords
    heavy = materialize(heavy_pairs(kw, level1, level2, salts, heavy_rows), "heavy_pairs")
    hot, light = _by_weight(kw, heavy, level1, level2)
    m = tmap.select(F.col("topic").alias("_map_topic"), F.col("category"), F.col("sub_category"))
    hot_map, _ = _by_weight(m, heavy, "category", "sub_category")
    joined = salted_join(hot, hot_map, [(level1, "category"), (level2, "sub_category")], "left", salts)
    hot_rows = joined.select(
        *[F.col(f"l.{c}") for c in kw.columns],
        mapped_label(F.col("r._map_topic"), F.col(f"l.{level1}"), F.col(f"l.{level2}")).alias("topic"),
        F.col("r.category"),
        F.col("r.sub_category"),
    )
    return attach_topics(light, tmap, level1, level2).unionByName(hot_rows)


def attach_topics_to_pairs(
    pairs: DataFrame, tmap: DataFrame, salts: int = DEFAULT_SALTS, level1: str = "level1", level2: str = "level2"
) -> DataFrame:
    """:func:`attach_topics` for distinct pairs, with the *map* split.

    Here a hot pair's rows are map rows, the right side of a left join, which
    Spark keeps whole.  So the map is the salted left side of an inner join,
    the pairs (few, distinct) are repeated, and the pairs without map rows come
    from an anti join with the map's distinct pairs.
    """
    m = tmap.select(F.col("topic").alias("_map_topic"), F.col("category"), F.col("sub_category"))
    p = pairs.select(F.col(level1).alias(level1), F.col(level2).alias(level2))
    on = [("category", level1), ("sub_category", level2)]
    met = salted_join(m, p, on, "inner", salts).select(
        F.col(f"r.{level1}"),
        F.col(f"r.{level2}"),
        mapped_label(F.col("l._map_topic"), F.col(f"r.{level1}"), F.col(f"r.{level2}")).alias("topic"),
        F.col("l.category"),
        F.col("l.sub_category"),
    )
    known = m.select("category", "sub_category").distinct().alias("m")
    cond = F.col(f"p.{level1}").eqNullSafe(F.col("m.category")) & F.col(f"p.{level2}").eqNullSafe(F.col("m.sub_category"))
    none = F.lit(None).cast("string")
    unmet = p.alias("p").join(known, cond, "left_anti").select(
        level1, level2, mapped_label(none, F.col(level1), F.col(level2)).alias("topic"), none.alias("category"), none.alias("sub_category")
    )
    return met.unionByName(unmet)


# Keys of a top-N that are broadcast at most.
MAX_BROADCAST_KEYS = 10_000


def rows_of_top(facts: DataFrame, top: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose ``key`` is among the keys of ``top`` (D2), a top-``n``.

    Up to ``MAX_BROADCAST_KEYS`` keys are broadcast, beyond that the join is
    left to Spark.  This replaces the dashboard's collected list + ``isin``.
    """
    keys = top.select(key).distinct()
    return facts.join(F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys, on=key, how="left_semi")
