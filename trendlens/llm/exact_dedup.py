"""Exact dedup by progressive refinement: length, then prefix hash, then full
hash.

Texts are equal when they are identical after every ASCII white-space
character is deleted.  Rows whose normalised length, and then whose (length,
prefix hash), is unique are settled without a look at their full content; the
full hash decides among the rest.  All of it is DataFrame code.

Where every row's hash is asked for (``hash_all``), the content must be read in
full anyway: it is hashed in the same read, and what is refined and shuffled are
ids and hashes, never texts.

Skew: every group count is a partial aggregate, so a group with a third of all
rows costs one row for each map task.  The two joins have the unique group
table, written before, on one side: Spark broadcasts it where its written size
allows, else adaptive execution splits a hot partition of the other side.

Very long texts are one value each: a task holds one of them, its normalised
form and its hash at a time.

Defined results: null texts count as empty, and empty texts are equal to each
other and to texts of white space only.  Of equal texts the row with the most
code points stays, then the one with the smallest id; a null id loses against
every other.  Rows that repeat id, text and number of code points of the row
that stays share its verdict.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.llm._common import SPACE_CLASS, table, text_of
from trendlens.sources.writers import materialize

PREFIX_CHARS = 64


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE_CLASS + "+", "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    hash_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    ``text_sha256`` is null for rows that were settled before their full
    content was hashed, unless ``hash_all``.
    """
    return _verdicts(docs, id_col, text_col, prefix_chars, hash_all).drop("n_points")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int = PREFIX_CHARS, hash_all: bool = False) -> DataFrame:
    """The columns of ``exact_dedup`` and the text's number of code points."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text_of(text_col)).alias("n_points"),
        normalised(text_col).alias("body"),
    ).select("*", F.length("body").alias("body_len"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"))

    # Where every row's hash is wanted, it is taken in the one read of the texts, and
    # only ids and hashes are refined; else the texts of open groups are hashed.
    full = F.sha2("body", 256)
    thin = ["doc_id", "n_points", "body_len", "prefix"]
    if hash_all:
        rows = materialize(rows.select(*thin, full.alias("text_sha256")), "hashes")
    # length and prefix hash come from the same read, so that one count refines by both
    by_prefix = rows.groupBy("body_len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    # written: a join of two shuffled sides, of which a hot key's partition can be split
    by_prefix = materialize(by_prefix.select("body_len", "prefix", F.lit(True).alias("open")), "open-prefixes")
    joined = rows.join(by_prefix, ["body_len", "prefix"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    sha = F.col("text_sha256") if hash_all else F.when(F.col("open"), full)
    hashed = materialize(joined.select("doc_id", "n_points", "body_len", "open", sha.alias("text_sha256")), "hashed")  # no texts; read twice below
    groups = (
        hashed.where("open")
        .groupBy("body_len", "text_sha256")
        .agg(
            F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id")).alias("best"),
            F.count("*").alias("group_size"),
        )
        .where("group_size > 1")
        .select(
            F.col("body_len").alias("g_len"),
            F.col("text_sha256").alias("g_sha"),
            F.col("best.doc_id").alias("best_id"),
            F.col("best.p").alias("best_p"),
            "group_size",
        )
    )
    groups = materialize(groups, "copies")
    joined = hashed.join(groups, (F.col("open") & (F.col("body_len") == F.col("g_len")) & (F.col("text_sha256") == F.col("g_sha"))), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (-F.col("n_points") == F.col("best_p")))).alias("kept"),
        "text_sha256",
        "n_points",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that
    share a verdict, one.

    The verdicts hold no text.  The texts are dealt once, by id, number of code
    points and full hash, which serves both the join with the dropped rows and
    the choice among repeated ones.
    """
    key, place = _own(docs, "_key"), _own(docs, "_place")

    def keyed(doc_id: Column, n_points: Column, sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), n_points.cast("string"), sha)

    gone = _verdicts(docs, id_col, text_col, hash_all=True).where("not kept").select(keyed(F.col("doc_id"), F.col("n_points"), F.col("text_sha256")).alias(key))
    gone = gone.distinct()
    rows = docs.withColumn(key, keyed(F.col(id_col).cast("long"), F.length(text_of(text_col)), F.sha2(normalised(text_col), 256)))
    same = W.partitionBy(key).orderBy(F.lit(0))
    stay = rows.join(gone, key, "left_anti").withColumn(place, F.row_number().over(same))
    return stay.where(F.col(place) == 1).select(*docs.columns)


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         arg_min(doc_id, {'p': -points, 'd': doc_id}) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
