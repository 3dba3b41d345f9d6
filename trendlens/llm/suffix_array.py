"""Suffix-array dedup: bytes of long strings that occur in an earlier document.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a
document with a smaller id.  In place of prefix doubling by Spark sorts (the
README says why), round 1 (see ``_repeats``) deals the hashes of 16-byte
anchors, which lie anywhere inside their windows, and discards those of a
single document.  Round 2 deals the bytes of the remaining runs by anchor.  The
receiving task names its windows: the name of 32 bytes is that of the pair
(name of 16 at i, name of 16 at i + 16), the name of 50 bytes that of the pair
(name of 32 at i, name of 32 at i + 18); windows whose name of 32 is unique are
dropped.  Names are 64-bit hashes, equal for equal strings.

Defined results: null texts count as empty; texts shorter than the width lose
nothing; rows of one id never remove each other's strings; a null id comes
after all others.  Further columns are ignored.  Empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.llm._common import id_and_text, table
from trendlens.llm._repeats import Block, Kind, Symbols, _groups, _ranges, remove_repeats

WIDTH = 50
GRAM = 16
U = np.uint64
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def byte_symbols(texts: list[bytes]) -> Symbols:
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    at = np.arange(len(buf) + 1)
    return Symbols(_seq.byte_values(buf), offsets, buf, at[:-1], at[1:])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _seq.mix(_seq.mix(a + U(0x632BE59BD9B4E019)) * U(3) + b)


def smaller_id(ranks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each position whether its rank also occurs under a smaller id."""
    order = np.argsort(ranks)
    first = _groups(ranks[order])
    least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
    out = np.empty(len(ranks), bool)
    out[order] = np.repeat(least, np.diff(np.r_[first, len(ranks)])) < ids[order]
    return out


def repeated_ranks(ranks: np.ndarray) -> np.ndarray:
    """Positions whose rank is not unique."""
    if not len(ranks):
        return np.zeros(0, np.int64)
    order = np.argsort(ranks)
    same = np.r_[False, ranks[order][1:] == ranks[order][:-1]]
    return np.sort(order[same | np.r_[same[1:], False]])


def _doubled(buf: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 32 and the 50 bytes from every window's start."""
    low = bounds[0, 0]
    rank16 = _seq.gram_hash(_seq.prefix_sums(_seq.byte_values(buf[low : bounds[1, -1]])), 16)
    position = _ranges(bounds[0] - low, windows)
    rank32 = _pair(rank16[position], rank16[position + 16])
    return rank32, _pair(rank32, _pair(rank16[position + 18], rank16[position + 34]))


def resolve_bytes(buf: np.ndarray, bounds: np.ndarray, windows: np.ndarray, ids: np.ndarray, piece_bytes: int = 1 << 19) -> np.ndarray:
    piece = bounds[0] // piece_bytes
    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(windows)]
    ranks = [_doubled(buf, bounds[:, a:b], windows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rank32, rank50 = (np.concatenate([r[i] for r in ranks]) for i in (0, 1))
    del ranks
    alive = repeated_ranks(rank32)
    out = np.zeros(len(rank32), bool)
    out[alive] = smaller_id(rank50[alive], np.repeat(ids, windows)[alive])
    return out


BYTES = Kind(WIDTH, GRAM, byte_symbols, resolve_bytes)


def maximal_spans(covered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and end (within the document) of its removed runs."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[offsets] = True  # runs end where documents do
    start = np.flatnonzero(covered & (edge[:-1] | ~np.r_[False, covered[:-1]]))
    end = np.flatnonzero(covered & (edge[1:] | ~np.r_[covered[1:], False])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start - offsets[doc], end - offsets[doc]


def _cut(block: Block, s: Symbols, covered: np.ndarray) -> pa.Table:
    doc, start, end = maximal_spans(covered, s.offsets)
    bounds = np.searchsorted(doc, np.arange(len(block.ids) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
    kept = s.buf[~covered]
    kept_at = np.r_[0, np.cumsum(~covered)][s.offsets].astype(np.int64)
    binary = pa.Array.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(kept_at.tobytes()), pa.py_buffer(kept)])
    return pa.table(
        {
            "doc_id": pa.array(block.ids, pa.int64()),
            "n_bytes": pa.array(block.lengths),
            "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
            "kept": binary.cast(pa.binary()),
        }
    )


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans`` (the maximal removed byte ranges), ``kept``
    (the remaining bytes), one row per row of ``docs``."""
    return remove_repeats(id_and_text(docs, id_col, text_col), BYTES, _cut, SCHEMA)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Bytes as pairs of hexadecimal digits.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS string FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT string, min(doc_id) AS first FROM k GROUP BY string),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN m USING (string) WHERE first < doc_id),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS DISTINCT FROM j - 1) AS n_spans
      FROM (SELECT *, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM c) GROUP BY doc_id),
x AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS byte FROM (SELECT *, unnest(range(0, length(h) // 2)) AS j FROM d)),
r AS (SELECT x.doc_id, string_agg(byte, '' ORDER BY x.j) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
"""
