"""LM scoring by subword lattice likelihood.

The model is a unigram distribution over the pieces of an existing vocabulary
and one end piece.  A text's probability is the sum over all segmentations of
its words (each with the vocabulary's word-start mark) into pieces, times the
end piece.  Pieces never cross words, so the sum is a product over words, and a
word's factor comes from a log-space forward recursion over its characters.  A
character without a piece of its own is spelled by the vocabulary's byte pieces.

The vocabulary file of this kind that is at hand stores merge ranks in place of
log-probabilities, so the pieces' scores are counted here: the vocabulary's own
segmentation of the training documents' words, smoothed.

Spark counts the words of all training documents; the table of distinct words
grows with the input and stays distributed.  Each distinct word is scored once.
Documents look up the ``HEAD_WORDS`` most frequent words in a broadcast table
of fixed size (hashes and numbers, so long words are no matter); all other words of a document are joined with the word table,
pre-aggregated per document.  The key is a 64-bit hash of the word.

Defined results: null or empty texts consist of the end token.  A null id hashes
like an empty text.  Rows that repeat an id are scored, and learned from, each.
Without training documents all counts are 0 and all pieces alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.llm._common import table, text_of
from trendlens.sources.writers import materialize

HEAD_WORDS = 100_000
TASK_WORDS = 200_000  # distinct words that a counting task holds
SMOOTHING = 0.5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
START = "▁"


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.translate(_LOWER) for t in texts]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return _seq.Words(words).hashes() if words else np.zeros(0, np.uint64)


# --- the vocabulary --------------------------------------------------------------


@dataclass(frozen=True)
class Pieces:
    """Probabilities of a vocabulary's pieces: natural logarithms by text, of
    the 256 bytes, and of the end."""

    text: dict[str, float]
    byte: list[float]
    end: float

    @property
    def longest(self) -> int:
        return max(map(len, self.text), default=1)


def _log_sum(terms: list[float]) -> float:
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


def word_log10(word: str, pieces: Pieces, longest: int) -> float:
    """Marginal log10 probability of a word over all its segmentations."""
    marked, text = START + word, pieces.text
    forward = [0.0]
    for end in range(1, len(marked) + 1):
        terms = []
        for begin in range(max(0, end - longest), end):
            p = text.get(marked[begin:end])
            if p is not None:
                terms.append(forward[begin] + p)
        if marked[end - 1] not in text:
            terms.append(forward[end - 1] + sum(pieces.byte[b] for b in marked[end - 1].encode()))
        forward.append(terms[0] if len(terms) == 1 else _log_sum(terms))
    return forward[-1] / math.log(10)


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _count_pieces(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    processor = _processor(model)
    counts = np.zeros(processor.get_piece_size(), np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 5000):
            part = batch.slice(a, 5000)
            encoded = processor.encode(part["word"].to_pylist(), num_threads=1)
            ids = np.fromiter((i for ids in encoded for i in ids), np.int64)
            times = np.repeat(part["count"].to_numpy(), [len(ids) for ids in encoded])
            counts += np.bincount(ids, weights=times, minlength=len(counts)).astype(np.int64)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "count"])


def train_pieces(words: DataFrame, n_ends: int, model_path: str, smoothing: float = SMOOTHING) -> Pieces:
    """Scores of the vocabulary's pieces from the training words.  What reaches
    the driver is one count for each piece."""
    with open(model_path, "rb") as f:
        model = f.read()
    shared = words.sparkSession.sparkContext.broadcast(model)
    counted = words.where("count > 0").mapInArrow(lambda it: _count_pieces(it, shared.value), "piece long, count long")
    found = counted.groupBy("piece").agg(F.sum("count").alias("count")).toPandas()
    processor = _processor(model)
    n = processor.get_piece_size()
    counts = np.zeros(n)
    counts[found["piece"]] = found["count"]
    usable = [i for i in range(n) if not (processor.is_unknown(i) or processor.is_control(i) or processor.is_unused(i))]
    total = counts[usable].sum() + n_ends + smoothing * (len(usable) + 1)
    log_p = np.log((counts + smoothing) / total)
    byte = [log_p[processor.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
    text = {processor.id_to_piece(i): float(log_p[i]) for i in usable if not processor.is_byte(i)}
    return Pieces(text, [float(b) for b in byte], math.log((n_ends + smoothing) / total))


# --- words -------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one task with their number in training documents; a word that
    stands in held-out documents alone has 0."""
    train: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(train)
        out = pa.RecordBatch.from_arrays(
            [pa.array(hashes_of(words).view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(train.values(), pa.int64())],
            names=["hash", "word", "count"],
        )
        train.clear()
        return out

    for batch in batches:
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        for at, texts in _seq.slices(batch["text"]):
            for i, text in enumerate(lowered(_seq.as_bytes(texts))):
                words = text.split()
                if held[at + i]:
                    train.update(dict.fromkeys(words, 0))
                else:
                    train.update(words)
            if len(train) > TASK_WORDS:
                yield rows()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """``hash, word, count`` of all distinct words of ``text``, counted where not
    ``held_out``."""
    counted = docs.select("text", "held_out").mapInArrow(_count_words, "hash long, word string, count long")
    return counted.groupBy("hash").agg(F.first("word").alias("word"), F.sum("count").alias("count"))


def with_marginals(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with the lattice's log10 probability of each."""
    shared = words.sparkSession.sparkContext.broadcast((pieces.text, pieces.byte, pieces.end))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*shared.value)
        longest = own.longest
        for batch in batches:
            marginal = [word_log10(w, own, longest) for w in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["hash"], batch["word"], batch["count"], pa.array(marginal, pa.float64())], names=["hash", "word", "count", "marginal"])

    return words.mapInArrow(score, "hash long, word string, count long, marginal double")


# --- documents ----------------------------------------------------------------------

_DOC = "n_words long, n_known long, base double, marginal double, tail array<long>, times array<long>"


def _look_up(texts: list[bytes], head: tuple[np.ndarray, ...]) -> pa.StructArray:
    """Sums over the head words of every text; its other words and their numbers."""
    head_hash, known, base, marginal = head
    words = _seq.Words(lowered(texts))
    h, n = words.hashes(), len(texts)
    at = np.minimum(np.searchsorted(head_hash, h), max(len(head_hash) - 1, 0))
    found = head_hash[at] == h if len(head_hash) else np.zeros(len(h), bool)
    text = words.text[found]
    sums = [np.bincount(text, weights=x[at[found]], minlength=n) for x in (known, base, marginal)]
    rest, rest_text = h[~found], words.text[~found]
    order = np.lexsort((rest, rest_text))
    rest, rest_text = rest[order], rest_text[order]
    first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_text[1:] != rest_text[:-1])]) if len(rest) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(rest)])
    bounds = pa.array(np.searchsorted(rest_text[first], np.arange(n + 1)).astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(words.offsets)),
            pa.array(sums[0].astype(np.int64)),
            pa.array(sums[1]),
            pa.array(sums[2]),
            pa.ListArray.from_arrays(bounds, pa.array(rest[first].view(np.int64))),
            pa.ListArray.from_arrays(bounds, pa.array(times)),
        ],
        ["n_words", "n_known", "base", "marginal", "tail", "times"],
    )


def look_up(text: Column, head: tuple[np.ndarray, ...]) -> Column:
    shared = SparkSession.active().sparkContext.broadcast(head)

    @F.arrow_udf(f"struct<{_DOC.replace(' ', ':').replace(',:', ',')}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_look_up(_seq.as_bytes(texts), shared.value) for _, texts in _seq.slices(batch)]
            yield pa.concat_arrays(parts) if parts else _look_up([], shared.value)

    return found(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def frequent(words: DataFrame, most: int) -> DataFrame:
    """Frequent words, ``most`` at most: all those above a level of counts.  The
    levels (a few hundred) are counted first, so nothing is sorted as a whole."""
    levels = words.withColumn("level", F.floor(F.log2(F.col("count") + 1) * 16))
    lowest, room = None, most
    for r in sorted(levels.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        room -= r["n"]
        if room < 0:
            break
        lowest = r["level"]
    return levels.where(F.lit(False) if lowest is None else F.col("level") >= lowest)


def score_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    n_ends = rows.where("not held_out").count()
    counts = materialize(word_counts(rows), "words")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    n_tokens, n_types = total["n"] + n_ends, total["v"] + (n_ends > 0)
    unit = n_tokens + 0.5 * (n_types + 1)
    pieces = train_pieces(counts, n_ends, model_path)
    words = materialize(with_marginals(counts, pieces), "marginals")

    top = frequent(words, head_words).select("hash", "count", "marginal").toPandas()  # three numbers a word, however long
    top = top.iloc[np.argsort(top["hash"].to_numpy(np.int64).view(np.uint64))]
    count = top["count"].to_numpy(np.int64)
    head = (top["hash"].to_numpy(np.int64).view(np.uint64), (count > 0).astype(np.float64), np.log10((count + 0.5) / unit), top["marginal"].to_numpy(np.float64))

    looked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", look_up(F.col("text"), head).alias("x"))
    looked = materialize(looked.select("row", "doc_id", "held_out", "x.*"), "looked")
    tail = looked.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.times").alias("times"))
    base = F.log10((F.col("count") + 0.5) / F.lit(unit))
    rest = (
        tail.join(words.select("hash", "count", "marginal"), "hash")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("r_known"),
            F.sum(F.col("times") * base).alias("r_base"),
            F.sum(F.col("times") * F.col("marginal")).alias("r_marginal"),
        )
    )
    zero = F.lit(0.0)
    end_base = math.log10((n_ends + 0.5) / unit)
    return looked.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("r_known", F.lit(0)) + int(n_ends > 0)).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero) + F.lit(end_base)).alias("base_score"),
        (F.col("marginal") + F.coalesce("r_marginal", zero) + F.lit(pieces.end / math.log(10))).alias("score"),
    )


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
