"""Substring dedup: words of long passages that occur in an earlier document.

A word goes if a window of ``WIDTH`` consecutive words that covers it also
starts in a document with a smaller id.  In place of suffix trees (the README
says why), windows are dealt by the four words of their sampled anchor (see
``_repeats``), which lies anywhere inside them, or, where that anchor has very
many runs, by all thirteen words.  An anchor of a single document is dropped
before any content is shipped.  Within a group one hash runs over the words of
every window, all windows at once; those that are alone at a depth of
``LEVELS`` are dropped.  Windows of equal hash at ``WIDTH`` words are the
repeats; those under more than the smallest id are removed.  No nodes or edges
are built, and nothing beyond ``WIDTH`` words is looked at.

Defined results: null texts have no words; texts of fewer words than the width
lose nothing; rows of one id never remove each other's words; a null id comes
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
from trendlens.llm._repeats import Block, Kind, Symbols, _ranges, remove_repeats
from trendlens.llm.suffix_array import repeated_ranks, smaller_id

WIDTH = 13
GRAM = 4
#: Depths in words at which windows that are alone are dropped.
LEVELS = (4, 8, 13)
U = np.uint64
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def word_symbols(texts: list[bytes]) -> Symbols:
    """Words, and a buffer in which each is followed by one space."""
    words = _seq.Words(texts)
    size = words.end - words.start + 1
    buf = words.buf[np.minimum(_ranges(words.start, size), len(words.buf) - 1)].copy()
    end = np.cumsum(size)
    buf[end - 1] = 32
    return Symbols(words.hashes(), words.offsets, buf, end - size, end)


def resolve_words(buf: np.ndarray, bounds: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(buf == 32)  # a space ends each word
    begin = np.r_[0, edge[:-1] + 1] if len(edge) else edge
    step = 1 << 17
    parts = [np.zeros(0, np.uint64)]
    for a in range(0, len(edge), step):
        b = min(a + step, len(edge))
        low = begin[a]
        sums = _seq.prefix_sums(_seq.byte_values(buf[low : edge[b - 1] + 1]))
        parts.append(_seq.range_hash(sums, begin[a:b] - low, edge[a:b] - low))
    word = np.concatenate(parts)
    first_word = np.searchsorted(edge, bounds[0])  # of each run
    suffix, owner = _ranges(first_word, windows), np.repeat(ids, windows)
    out = np.zeros(len(suffix), bool)
    node = np.zeros(len(suffix), np.uint64)
    alive = np.arange(len(suffix))
    depth = 0
    for level in LEVELS:
        for d in range(depth, level):  # the words up to the next depth
            node = _seq.mix(node * U(3) + word[suffix + d] + U(d + 1))
        depth = level
        if level < WIDTH:
            inner = repeated_ranks(node)
            node, suffix, alive = node[inner], suffix[inner], alive[inner]
    out[alive] = smaller_id(node, owner[alive])
    return out


WORDS = Kind(WIDTH, GRAM, word_symbols, resolve_words)


def _cut(block: Block, s: Symbols, covered: np.ndarray) -> pa.Table:
    n = np.diff(s.offsets)
    removed = np.diff(np.r_[0, np.cumsum(covered)][s.offsets])
    size = np.where(covered, 0, s.byte_end - s.byte_start)
    kept = s.buf[_ranges(s.byte_start, size)]
    at = np.r_[0, np.cumsum(size)][s.offsets]
    # without the space after each text's last word
    last = at[1:][at[1:] > at[:-1]] - 1
    kept = np.delete(kept, last)
    at = (at - np.r_[0, np.cumsum(at[1:] > at[:-1])]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(block.ids), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept)])
    return pa.table(
        {"doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(n), "n_removed": pa.array(removed), "kept": text.cast(pa.string())}
    )


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the remaining words, joined by one
    space), one row per row of ``docs``."""
    return remove_repeats(id_and_text(docs, id_col, text_col), WORDS, _cut, SCHEMA)


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT passage, min(doc_id) AS first FROM k GROUP BY passage),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (passage) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(c.j) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j
GROUP BY d.doc_id, len(w)
"""
