"""From raw documents to encoded training data, stage by stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and returns the columns of ``docs``; the last returns the encoding.  Its
output is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from trendlens.sources.writers import materialize

#: Near duplicates: word 5-grams, similarity of 0.8 or more.
NEAR = jaccard_join.Rule(n=5, percent=80)


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` with a number of each row, which ids that repeat or are null are
    not.  It is written once, so that every later read meets the same numbers."""
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    verdict = _own(docs, "quality_verdict")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_quality(docs, labels, verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, stays;
    a null id comes last.  Rows that share an id are separate documents."""
    key = _own(docs, "row_key")
    rows = _numbered(docs, key, "near-rows")
    groups = jaccard_join.near_duplicates(rows, NEAR, key).select(F.col("doc_id").alias(key), "component_id")
    members = materialize(groups.join(rows.select(key, F.col("doc_id").cast("long").alias("id")), key), "near-members")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", key))
    stays = members.groupBy("component_id").agg(first[key].alias("stays"), F.count("*").alias("n")).where("n > 1")
    gone = members.join(stays, "component_id").where(F.col(key) != F.col("stays")).select(key)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the mix as often as its taken words fill it; what is
    left over is rounded along a seeded order of the documents, so that the
    sources' words stay near their targets.  Rows that share an id are decided
    each."""
    key, copies = _own(docs, "row_key"), _own(docs, "mix_copies")
    rows = _numbered(docs, key, "mix-rows")
    decided = mixing.mix(rows, row_col=key).where("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(copies))
    joined = rows.join(decided, key)
    return joined.withColumn(key, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` and the digests of ids and decoded bytes."""
    encoded = bpe.encode_documents(docs, bpe.production_tokenizer(spark))
    return bpe.digests(encoded, "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL has no hashed log-likelihood ratio, no components and no BPE; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
