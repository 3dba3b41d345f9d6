"""Hard-negative mining with Kronecker-packed inner products.

Vectors of integers are scored by their exact inner product.  Every anchor's
``positives`` best rows of its own label are its positives; for each of them the
best ``negatives`` rows of other labels whose score lies between ``low`` and
``high`` percent of the positive's are its hard negatives.

Kronecker packing: the components of several candidates, biased so that none is
negative, are put into separated fields of one wide integer.  One multiplication
by an anchor's component multiplies all of them; the sum over the components
holds all inner products, each in its own field, since a field is wide enough
for the largest possible sum (its width follows from the table's largest
component).  Unpacking takes the fields apart and the bias off.  Words of at
most 52 bits are exact as doubles, so that a whole block is one matrix product;
wider ones are Python integers.

Plan: anchors are a stated query set, scored against all rows in blocks.  Rows
are dealt into blocks of about ``ROWS`` candidates and ``ANCHORS`` anchors by a
hash, and a task holds one block of each, in slices of ``SLICE`` anchors.  Each
pair of blocks returns the best few of its rows for each anchor, and a window
limited to the first few merges them.  The first pass finds the positives, the
second the negatives.  A label with a third of all rows is spread over all
blocks.

Defined results: rows with a null label or id, or a vector that is null, empty
or has null or non-finite components take no part; nor do vectors of another
length than that of the smallest id.  Integer components are cut at +-2**23.
Scores come highest first; ties by smaller id.  Rows that repeat an id are rows
of their own (an anchor's copy may be its positive).  A positive without
negatives gives no row.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.llm import _vectors
from trendlens.llm._common import table
from trendlens.sources.writers import materialize

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
#: Candidates and anchors of a pair of blocks, about; anchors scored at once.
ROWS = 8192
ANCHORS = 8192
SLICE = 64
#: Bits of an integer that a double holds exactly, one kept free.
EXACT_BITS = 52
#: Fields of a wide integer where one field alone is beyond a double.
WIDE_FIELDS = 8


@dataclass(frozen=True)
class Packing:
    """Fields of ``width`` bits for inner products of vectors of ``length``
    components between -largest and largest."""

    length: int
    largest: int

    @property
    def width(self) -> int:
        return (2 * self.length * self.largest * self.largest).bit_length() + 1

    @property
    def fields(self) -> int:
        return EXACT_BITS // self.width or WIDE_FIELDS

    @property
    def dtype(self) -> type:
        return np.float64 if self.width <= EXACT_BITS else object

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """A matrix of words, component by group of ``fields`` candidates."""
        n, fields = len(vectors), self.fields
        padded = np.zeros((-(-n // fields) * fields, self.length), dtype=object if self.dtype is object else np.int64)
        padded[:n] = vectors + self.largest
        words = padded[0::fields].copy()
        for k in range(1, fields):
            words += padded[k::fields] << (self.width * k)
        return words.T.astype(self.dtype)

    def scores(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Inner products of every anchor with the first ``n`` packed candidates."""
        product = anchors.astype(self.dtype) @ words
        if self.dtype is not object:
            product = product.astype(np.int64)
        out = np.zeros((len(anchors), words.shape[1] * self.fields), dtype=product.dtype)
        half = 1 << (self.width - 1)
        for k in range(self.fields):
            field = ((product + half) & (2 * half - 1)) - half  # fields are signed: anchors are
            out[:, k :: self.fields] = field
            product = (product - field) >> self.width
        return (out[:, :n] - self.largest * anchors.sum(axis=1)[:, None]).astype(np.int64)

    def keys(self, scores: np.ndarray) -> np.ndarray:
        """Numbers that order a row by score, ties by place: larger is better."""
        n = scores.shape[1]
        if self.length * self.largest * self.largest * max(n, 1) >= 1 << 62:
            scores = scores.astype(object)
        return scores * n + np.arange(n - 1, -1, -1)


def _columns(side: pa.Table, length: int) -> dict[str, np.ndarray]:
    out = {k: side[k].to_numpy() for k in ("row", "vec_id", "label")}
    return out | {"v": _vectors.matrix(side["v"], length)}


def _by_id(side: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((side["row"], side["vec_id"]))
    return {k: v[order] for k, v in side.items()}


_BEST = "anchor_row long, anchor_id long, nth int, row long, vec_id long, score long"


def _best_table(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(6)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_row", "anchor_id", "nth", "row", "vec_id", "score"]
    return pa.table([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, types, strict=True)], names=names)


def best_positives(anchors: pa.Table, rows: pa.Table, packing: Packing, most: int) -> pa.Table:
    """The best rows of its own label of every anchor within a pair of blocks."""
    if not anchors.num_rows or not rows.num_rows:
        return _best_table([])
    a, c = _columns(anchors, packing.length), _by_id(_columns(rows, packing.length))
    parts = []
    for label in np.unique(a["label"]):
        mine, there = np.flatnonzero(a["label"] == label), np.flatnonzero(c["label"] == label)
        words = packing.pack(c["v"][there])
        for at in range(0, len(mine) if len(there) else 0, SLICE):
            some = mine[at : at + SLICE]
            score = packing.scores(a["v"][some], words, len(there))
            order = np.argsort(packing.keys(score), axis=1)[:, ::-1][:, : most + 1]
            who, place = np.repeat(some, order.shape[1]), order.ravel()
            found = there[place]
            value = np.take_along_axis(score, order, axis=1).ravel()
            other = c["row"][found] != a["row"][who]
            who, found, value = who[other], found[other], value[other]
            parts.append((a["row"][who], a["vec_id"][who], np.zeros(len(who)), c["row"][found], c["vec_id"][found], value))
    return _best_table(parts)


def best_negatives(anchors: pa.Table, rows: pa.Table, packing: Packing, most: int, low: int, high: int) -> pa.Table:
    """The best rows of other labels in every positive's range of scores, within
    a pair of blocks; ``nth`` is the positive's number."""
    if not anchors.num_rows or not rows.num_rows:
        return _best_table([])
    a, c = _columns(anchors, packing.length), _by_id(_columns(rows, packing.length))
    positives = anchors["positive_scores"].to_pylist()
    n = len(c["row"])
    words, parts = packing.pack(c["v"]), []
    for at in range(0, len(positives), SLICE):
        score = packing.scores(a["v"][at : at + SLICE], words, n)
        keys = packing.keys(score)
        order = np.argsort(keys, axis=1)
        for k, (ranked, places) in enumerate(zip(np.take_along_axis(keys, order, axis=1), order, strict=True), at):
            differ = c["label"][places] != a["label"][k]
            ranked, places = ranked[differ], places[differ]
            for nth, positive in enumerate(positives[k]):
                # negative * 100 lies in [low * positive, high * positive]
                first = np.searchsorted(ranked, -(-low * positive // 100) * n, "left")
                last = np.searchsorted(ranked, (high * positive // 100 + 1) * n, "left")
                found = places[max(first, last - most) : last]
                one = np.ones(len(found), np.int64)
                parts.append((a["row"][k] * one, a["vec_id"][k] * one, nth * one, c["row"][found], c["vec_id"][found], score[k - at, found]))
    return _best_table(parts)


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides dealt over all pairs of blocks, ready to be grouped together."""
    across, down = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of its own: both sides come from one table
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("down", deal(down, 1)).withColumn("across", every(across))
    right = rows.withColumn("across", deal(across, 2)).withColumn("down", every(down))
    return left.groupBy("across", "down").cogroup(right.groupBy("across", "down"))


def _first(found: DataFrame, keys: list[str], most: int, place: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn(place, F.row_number().over(order)).where(F.col(place) <= most)


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the anchors, the rows for which ``is_anchor`` holds."""
    label = (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")
    chosen = F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    rows = _vectors.integer_vectors(df, id_col, vec_col, label, chosen).where("vec_id is not null and label is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    of_length = rows.groupBy(F.size("v").alias("length")).agg(
        F.min("vec_id").alias("first"),
        F.count("*").alias("n"),
        F.count_if("anchor").alias("n_anchors"),
        F.max(F.array_max(F.transform("v", F.abs))).alias("largest"),
    )
    shape = of_length.orderBy("first", "length").first()
    if shape is None or not shape["n_anchors"]:
        nothing = "vec_id AS anchor_id, vec_id AS positive_id, 1 AS rank, vec_id AS negative_id, vec_id AS positive_score, vec_id AS negative_score"
        return rows.limit(0).selectExpr(*nothing.split(", "))
    packing = Packing(shape["length"], max(shape["largest"], 1))
    rows = rows.where(F.size("v") == shape["length"])
    vectors, anchors = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    sized = (shape["n"], shape["n_anchors"])
    found = _blocks(vectors, anchors, *sized).applyInArrow(lambda a, c: best_positives(a, c, packing, positives), _BEST)
    best = materialize(_first(found, ["anchor_row"], positives, "place").drop("nth"), "positives")
    # an anchor's positives in their order: a list of ``positives`` at most
    listed = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    listed = listed.select(F.col("anchor_row").alias("row"), F.col("p.score").alias("positive_scores"))
    found = _blocks(vectors, anchors.join(listed, "row"), *sized).applyInArrow(
        lambda a, c: best_negatives(a, c, packing, negatives, low, high), _BEST
    )
    ranked = _first(found, ["anchor_row", "nth"], negatives, "rank")
    of = best.select("anchor_row", (F.col("place") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, ["anchor_row", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=moved)


SQL = r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
