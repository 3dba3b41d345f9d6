"""Quality rules and a hashed n-gram log-likelihood ratio.

The base rules count, per document: code points in words, symbol characters,
repeated lines, and words in 5-word windows that occur twice or more; a
document with too few words or too much repetition fails.

The method: word 1-grams and 2-grams are hashed into ``buckets`` cells.  One
multinomial over the cells is learned from trusted documents (labelled as good;
a sample of at most ``TRUSTED_DOCS``), one from all documents; the former is drawn to the latter by
``smoothing`` counts a cell, so that words too rare to have met a label speak
for neither.  A document's score is the mean over its n-grams of
ln(p_trusted / p_raw); documents below ``threshold`` are rejected.
The mean is length-normalised, and the threshold is a fixed number, so every
document is decided alike in any corpus size.

Cost: two reads of the texts and no shuffle of them.  What is shuffled are the
cell counts; what is broadcast are ``buckets`` ratios and the sample's ids.  The
words of a whole Arrow batch are found, hashed and counted in numpy.

Defined results: null or empty texts have no words, fail the base rules and
score 0.  Without trusted documents the ratio is 0 everywhere, so only the
base rules decide.  Null ids match no label.  Rows that repeat an id are
scored each; repeated label rows count once, and contradicting ones as not
trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.llm._common import id_and_text, table, text_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BUCKETS = 1 << 16
SMOOTHING = 5.0
THRESHOLD = -0.25
#: The trusted sample is bounded; raw counts cover all documents.
TRUSTED_DOCS = 50_000
SCORE = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
    "base_failed:boolean,llr:double,kept:boolean>"
)


def _cells(words: _seq.Words, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all 1-grams and 2-grams, and the text number of each."""
    pair = words.text[1:] == words.text[:-1]
    two = _seq.mix(hashes[:-1] * _seq.U(3) + hashes[1:])[pair] if len(hashes) > 1 else np.zeros(0, np.uint64)
    cells = np.concatenate([hashes, two]) % _seq.U(buckets)
    return cells.astype(np.int64), np.concatenate([words.text, words.text[1:][pair] if len(hashes) > 1 else words.text[:0]])


def _count_cells(batches: Iterator[pa.RecordBatch], good_ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Cell counts of one task: raw and trusted."""
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        good_row = np.isin(batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False), good_ids) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        for at, texts in _seq.slices(batch["text"]):
            words = _seq.Words(_seq.as_bytes(texts))
            cells, text = _cells(words, words.hashes(), buckets)
            raw += np.bincount(cells, minlength=buckets)
            good += np.bincount(cells[good_row[at + text]], minlength=buckets)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["cell", "raw", "good"])


def cell_counts(docs: DataFrame, good_ids: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``cell, raw, good``: counts over all documents and over the trusted."""
    shared = docs.sparkSession.sparkContext.broadcast(good_ids)
    counted = docs.mapInArrow(_seq.released(lambda it: _count_cells(it, shared.value, buckets)), "cell long, raw long, good long")
    return counted.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """ln(p_trusted / p_raw) of every cell; at most ``buckets`` rows reach the
    driver."""
    raw, good = np.zeros(buckets), np.zeros(buckets)
    rows = counts.toArrow()
    cell = rows["cell"].to_numpy()
    raw[cell], good[cell] = rows["raw"].to_numpy(), rows["good"].to_numpy()
    if not good.sum():
        return np.zeros(buckets)
    return np.log((good + smoothing) / (raw * good.sum() / raw.sum() + smoothing))


def repeated_words(words: _seq.Words, hashes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Number of words of every text that lie in a window of ``width`` words
    found twice or more in the text."""
    n_texts, n = len(words.offsets) - 1, len(hashes) - width + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    first = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    grams = _seq.gram_hash(_seq.prefix_sums(hashes), width)[first]
    keys = _seq.mix(grams + words.text[first].astype(np.uint64) * _seq.U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = np.r_[False, keys[order][1:] == keys[order][:-1]]
    twice = first[order[same | np.r_[same[1:], False]]]
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(words.text[covered], minlength=n_texts)


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def score_texts(texts: list[bytes], ratios: np.ndarray, threshold: float) -> pa.StructArray:
    words = _seq.Words(texts)
    hashes, n_texts = words.hashes(), len(texts)
    cells, text = _cells(words, hashes, len(ratios))
    n_grams = np.bincount(text, minlength=n_texts)
    llr = np.bincount(text, weights=ratios[cells], minlength=n_texts) / np.maximum(n_grams, 1)
    starts = words.text_start[:-1]
    # bytes that begin a code point and are not white space
    points = (words.buf & 0xC0 != 0x80) & ~_seq.IS_SPACE[words.buf]
    symbol = np.isin(words.buf, np.frombuffer(SYMBOLS, np.uint8))
    count = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if n_texts else np.zeros(0, np.int64)
    n_words, n_repeat = np.diff(words.offsets), repeated_words(words, hashes)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    columns = {
        "n_words": n_words,
        "word_chars": count(points),
        "n_symbols": count(symbol),
        "n_dup_lines": np.fromiter((_repeated_lines(t) for t in texts), np.int64, n_texts),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "llr": llr,
        "kept": ~failed & (llr >= threshold),
    }
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def quality_column(text: Column, ratios: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """All figures and the verdict as one struct, of any text column."""
    shared = SparkSession.active().sparkContext.broadcast(ratios)  # 8 bytes for each cell

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [score_texts(_seq.as_bytes(texts), shared.value, threshold) for _, texts in _seq.slices(batch)]
            yield pa.concat_arrays(parts) if parts else score_texts([], shared.value, threshold)

    @F.arrow_udf(SCORE)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _seq.released(scored)(batches)

    return score(text)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> np.ndarray:
    """Ids that are labelled as good quality and not toxic, and never otherwise;
    of more than ``most``, those of the smallest hashes."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    ids = ids.agg(F.min(F.coalesce(good, F.lit(False))).alias("trusted")).where("trusted")
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").toPandas()
    return np.sort(some["doc_id"].to_numpy(dtype=np.int64))


def with_quality(
    docs: DataFrame, labels: DataFrame, name: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with all their columns and the struct ``name``."""
    ratios = log_ratios(cell_counts(id_and_text(docs, id_col, text_col), trusted_ids(labels)))
    return docs.withColumn(name, quality_column(text_of(text_col), ratios, threshold))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    return with_quality(docs, table(spark, sf_dir, "labels"), "q").select("doc_id", "q.*")
