"""Substring search over an index of trigrams.

The index holds the distinct texts of a column, dealt into folders by a hash,
and for every three consecutive characters (lower-cased) the hashes of the texts
that hold them, ordered by trigram.  A search looks up the term's trigrams
(a pushed filter that skips the other row groups), keeps the texts that have all
of them, and reads only those texts' folders; there ``contains`` decides, so the
result is that of a scan.  Terms of under three characters scan the distinct
texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.functions.text import matches

GRAM = 3
#: Folders of texts: how finely a search can skip them.
FOLDERS = 256


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    column: str

    def _texts(self) -> DataFrame:
        return self.spark.read.schema("id bigint, text string, folder int").parquet(f"{self.path}/texts")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, id bigint").parquet(f"{self.path}/postings")

    def candidates(self, term: str) -> DataFrame:
        """``id`` of the texts that have all trigrams of the term."""
        low = term.lower()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        found = self._postings().where(F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return found.where(F.col("n") == len(grams)).select("id")

    def texts(self, term: str) -> DataFrame:
        """The distinct texts that contain ``term``, any case, in a column of the
        indexed one's name."""
        rows = self._texts()
        if len(term.lower()) >= GRAM:
            ids = self.candidates(term)
            folders = [r["folder"] for r in ids.select(_folder("id")).distinct().collect()]  # FOLDERS at most
            rows = rows.where(F.col("folder").isin(folders)).join(ids, "id", "left_semi")
        return rows.where(matches("text", term)).select(F.col("text").alias(self.column))

    def rows(self, df: DataFrame, term: str) -> DataFrame:
        """The rows of ``df`` whose text contains ``term``; ``df`` must hold no
        texts that were not there when the index was built."""
        return df.join(self.texts(term), self.column, "left_semi").select(*df.columns)


def _folder(column: str):
    return F.pmod(F.col(column), F.lit(FOLDERS)).cast("int").alias("folder")


def build_text_index(df: DataFrame, column: str, path: str) -> TextIndex:
    """Writes the index of the column's distinct texts below ``path``."""
    spark = df.sparkSession
    texts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("text")).distinct()
    texts = texts.select(F.xxhash64("text").alias("id"), "text").withColumn("folder", _folder("id"))
    texts.repartition("folder").write.partitionBy("folder").parquet(f"{path}/texts")
    low = F.lower("text")
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))
    index = TextIndex(spark, path, column)
    # two texts of one hash, should there be any, count as one text with both's trigrams: both are verified
    postings = index._texts().select(F.explode(grams).alias("gram"), "id").distinct()
    # a trigram of very many texts is a range of ids in several files
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    return index
