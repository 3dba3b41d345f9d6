"""Product codes of vectors by Lloyd rounds over cover trees.

A vector of integers is cut into ``parts`` equal pieces; each piece becomes the
index of the nearest entry of its position's codebook.  Codebooks start as the
pieces of the vectors of the smallest ids and are moved by Lloyd rounds to the
floor of the mean of what they were assigned.

Cover trees: a task cuts its rows into blocks and builds, per block, one tree
for each position, level by level: every node's points are covered by children
of half the radius, the first of which keeps the node's centre.  Points stand
in tree order, so a node is a range, and running sums over that order give the
sum of any subtree by one subtraction.  The trees are written once and read by
all rounds.

A round walks the trees from the roots.  With a node's radius r, and d1 and d2
the centre's distances to the nearest and second nearest entry, all points of
the node have that nearest entry if d1 + r < d2 - r: the whole subtree is
assigned at once and adds its sum.  Only nodes that this leaves open descend,
and points of open leaves are compared exactly.  Nodes of radius 0 are copies of
one point, for which the exact comparison (ties to the lower index) decides.

Plan: vectors are never shuffled.  A round sends, for each task, one sum for
each component of an entry; codebooks (``entries`` x the vector's length) are
what goes through the driver and is broadcast.

Defined results: rows whose vector is null, empty, or has null or non-finite
components are dropped; so are vectors of another length than that of the
smallest kept id, and all if this length is not a multiple of ``parts``.
Integer components are cut at +-2**23.  Fewer kept rows than ``entries`` give
that many entries.  Rows that repeat an id are vectors of their own; of a
repeated id the smaller vector comes first as an entry, and a null id comes last.
Null labels are one label.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import _vectors
from trendlens.llm._common import table
from trendlens.sources.writers import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors of a block: one tree for each position.
BLOCK = 2048
#: Nodes of so few points are leaves.
LEAF = 4
#: Relative room for the rounding of distances: nodes nearer to a tie descend.
ROOM = 1e-9
CHUNK = 4096
_PIECES = {"points": np.int32, "row": np.int32, "position": np.int32, "start": np.int32, "end": np.int32, "radius": np.float64, "child": np.int32, "n_children": np.int32}
BLOCK_SCHEMA = "vec_id array<long>, label array<long>, " + ", ".join(f"`{k}` binary" for k in _PIECES)


@dataclass
class Trees:
    """The cover trees of a block.  ``points`` stand in tree order, ``row`` says
    whose piece each is; a node is a range of them, begins with its centre, and
    its children are consecutive nodes (none: a leaf)."""

    points: np.ndarray
    row: np.ndarray
    position: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    n_children: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of count[0] numbers, then those of start[1] ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _covered(points: np.ndarray, node: np.ndarray, reach: float) -> np.ndarray:
    """Child number of each point: of every node's points not yet covered the
    first is a centre and covers those within ``reach``.  All nodes at once."""
    child = np.full(len(points), -1)
    left, k = np.arange(len(points)), 0
    while len(left):
        first = np.r_[True, node[left][1:] != node[left][:-1]]
        centre = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
        near = _squares(points[left], points[centre]) <= reach * reach
        child[left[near]] = k
        left, k = left[~near], k + 1
    return child


def cover_trees(vectors: np.ndarray, parts: int) -> Trees:
    """The trees of all positions of a block of vectors, level by level; the
    roots are the first ``parts`` nodes."""
    n, width = len(vectors), vectors.shape[1] // parts
    points = vectors.reshape(n, parts, width).transpose(1, 0, 2).reshape(n * parts, width).astype(np.int64)
    row = np.tile(np.arange(n), parts)
    position, start = np.arange(parts), np.arange(parts) * n
    end = start + n
    radius, child, n_children = np.zeros(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    fresh, open_, reach = np.arange(parts), np.zeros(0, np.int64), None
    while True:
        sizes = end[fresh] - start[fresh]
        square = _squares(points[_ranges(start[fresh], sizes)], points[np.repeat(start[fresh], sizes)])
        radius[fresh] = np.sqrt(np.maximum.reduceat(square, np.cumsum(sizes) - sizes).astype(float)) if len(fresh) else 0
        open_ = np.concatenate([open_, fresh])
        open_ = open_[(radius[open_] > 0) & (end[open_] - start[open_] > LEAF)]
        if not len(open_):
            return Trees(points, row, position, start, end, radius, child, n_children)
        reach = (2.0 ** np.ceil(np.log2(radius[open_].max())) if reach is None else reach) / 2
        wide = radius[open_] > reach
        split, open_ = open_[wide], open_[~wide]
        sizes = end[split] - start[split]
        at, node = _ranges(start[split], sizes), np.repeat(np.arange(len(split)), sizes)
        number = _covered(points[at], node, reach)
        order = np.lexsort((number, node))  # stable: a centre stays before the points it covers
        points[at], row[at] = points[at][order], row[at][order]
        node, number = node[order], number[order]
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (number[1:] != number[:-1])]) if len(at) else np.zeros(0, np.int64)
        fresh = len(start) + np.arange(len(first))
        which, offset, count = np.unique(node[first], return_index=True, return_counts=True)
        child[split[which]], n_children[split[which]] = fresh[offset], count
        position = np.concatenate([position, position[split[node[first]]]])
        start, end = np.concatenate([start, at[first]]), np.concatenate([end, at[first] + np.diff(np.r_[first, len(at)])])
        none = np.zeros(len(first), np.int64)
        radius, child, n_children = np.concatenate([radius, none]), np.concatenate([child, none]), np.concatenate([n_children, none])


def _distances(points: np.ndarray, position: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances to all entries of the position's codebook, exact."""
    out = np.zeros((len(points), books.shape[1]), np.int64)
    for p in np.unique(position):
        mine = np.flatnonzero(position == p)
        out[mine] = (points[mine] ** 2).sum(axis=1)[:, None] - 2 * (points[mine] @ books[p].T) + (books[p] ** 2).sum(axis=1)
    return out


def _nearest(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, and the distances to it and to the second nearest."""
    rows = np.arange(len(square))
    entry = square.argmin(axis=1)
    low = np.sqrt(square[rows, entry].astype(float))
    if square.shape[1] == 1:
        return entry, low, np.full(len(square), np.inf)
    square[rows, entry] = np.iinfo(np.int64).max
    return entry, low, np.sqrt(square.min(axis=1).astype(float))


def assign(trees: Trees, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, entry, start, end) of ranges of points in tree order, each
    point in one of them: whole subtrees, and single points of open leaves."""
    frontier = np.arange(len(books))
    while len(frontier):
        below = []
        for at in range(0, len(frontier), CHUNK):
            nodes = frontier[at : at + CHUNK]
            entry, low, high = _nearest(_distances(trees.points[trees.start[nodes]], trees.position[nodes], books))
            r = trees.radius[nodes]
            settled = (r == 0) | (low + r < high - r - ROOM * (low + r + 1))
            done, left = nodes[settled], nodes[~settled]
            yield trees.position[done], entry[settled], trees.start[done], trees.end[done]
            inner = left[trees.n_children[left] > 0]
            below.append(_ranges(trees.child[inner], trees.n_children[inner]))
            leaves = left[trees.n_children[left] == 0]
            count = trees.end[leaves] - trees.start[leaves]
            points, where = _ranges(trees.start[leaves], count), np.repeat(trees.position[leaves], count)
            yield where, _distances(trees.points[points], where, books).argmin(axis=1), points, points + 1
        frontier = np.concatenate(below)


# --- on Spark ---------------------------------------------------------------------


def tree_blocks(vectors: DataFrame, width: int, parts: int, block: int = BLOCK) -> DataFrame:
    """One row for each block of rows of ``vectors`` (vec_id, label, v)."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        trees = cover_trees(_vectors.matrix(rows["v"], width), parts)
        columns = {k: [rows[k].to_pylist()] for k in ("vec_id", "label")}
        columns |= {k: [getattr(trees, k).astype(kind).tobytes()] for k, kind in _PIECES.items()}
        types = [pa.list_(pa.int64())] * 2 + [pa.binary()] * len(_PIECES)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= block:
                rows = pa.Table.from_batches(held)
                yield made(rows.slice(0, block))
                held, n = rows.slice(block).to_batches(), n - block
        if n:
            yield made(pa.Table.from_batches(held))

    return vectors.select("vec_id", "label", "v").mapInArrow(run, BLOCK_SCHEMA)


def _read(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, Trees]]:
    for k in range(batch.num_rows):
        pieces = {c: np.frombuffer(batch[c][k].as_buffer(), kind) for c, kind in _PIECES.items()}
        pieces["points"] = pieces["points"].reshape(len(pieces["row"]), -1)
        yield k, Trees(**{c: v.astype(np.float64 if c == "radius" else np.int64) for c, v in pieces.items()})


def _sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, at, total, n``: sum and number of the pieces of each entry."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, n = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, trees in _read(batch, len(books)):
                running = np.concatenate([np.zeros((1, books.shape[2]), np.int64), np.cumsum(trees.points, axis=0)])
                for part, entry, start, end in assign(trees, books):
                    np.add.at(total, (part, entry), running[end] - running[start])
                    np.add.at(n, (part, entry), end - start)
        part, entry = np.nonzero(n)
        width = books.shape[2]
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "at", "total", "n"])

    rows = blocks.mapInArrow(run, "part long, entry long, `at` long, total long, n long")
    return rows.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry without pieces stays."""
    moved = books.copy()
    sums = _sums(blocks, books).toPandas()  # a row for each component of the codebooks at most
    moved[sums["part"], sums["entry"], sums["at"]] = sums["total"].to_numpy() // sums["n"].to_numpy()
    return moved


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts = len(books)
        for batch in batches:
            for k, trees in _read(batch, parts):
                n = len(trees.points) // parts
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for part, entry, start, end in assign(trees, books):
                    count = end - start
                    at, part, entry = _ranges(start, count), np.repeat(part, count), np.repeat(entry, count)
                    codes[trees.row[at], part] = entry
                    np.add.at(error, trees.row[at], _squares(trees.points[at], books[part, entry]))
                columns = [batch["vec_id"][k].values, batch["label"][k].values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def first_entries(vectors: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The starting codebooks, parts x entries x components, from the vectors of
    the smallest ids; at most ``entries`` rows reach the driver."""
    smallest = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    rows = np.array([r["v"] for r in smallest], dtype=np.int64)
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every kept row, and the codebooks
    (parts x entries x components)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = _vectors.integer_vectors(df, id_col, vec_col, F.col(label_col).cast("long").alias("label"))
    width = _vectors.common_length(vectors) or 0
    if not width or width % parts:
        return vectors.limit(0).selectExpr("vec_id", "label", "'' AS code", "0L AS error"), np.zeros((parts, 0, 0), np.int64)
    vectors = vectors.where(F.size("v") == width)
    books = first_entries(vectors, entries, parts)
    blocks = materialize(tree_blocks(vectors, width, parts), "cover-trees")
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    return encode(blocks, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "codes")
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")  # joined by its written size
    own = sums.select(F.col("label").alias("of"), "label_error")
    joined = codes.join(own, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


SQL = r"""
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
  FROM kept, (SELECT unnest(range(16)) AS p)),
entry0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM piece) WHERE e < 64),
{rounds}
final AS MATERIALIZED (
  SELECT vec_id, label, p, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT vec_id, label, a.p, e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM piece a JOIN entry2 b ON a.p = b.p)
  GROUP BY vec_id, label, p),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM final GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM entry2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""

_ROUND = r"""
own{k} AS (
  SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT vec_id, a.p, e, a.x, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM piece a JOIN entry{k} b ON a.p = b.p)
  GROUP BY vec_id, p),
mean{k} AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT p, best.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM own{k}, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)
  GROUP BY p, e),
entry{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, o.x) AS x FROM entry{k} o LEFT JOIN mean{k} m USING (p, e)),"""

SQL = SQL.format(rounds="".join(_ROUND.format(k=k, n=k + 1) for k in range(ROUNDS)))
