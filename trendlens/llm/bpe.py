"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by the vocabulary's pattern; each piece is a word.  The distinct
words of a task's documents are encoded once: starting from single bytes, the
adjacent pair with the lowest rank (the leftmost of equals) is merged until no
pair has a rank.  Many words of one length are folded together in numpy, one
merge for each word a round; very long words use a heap.  Decoding
concatenates the binary pieces of the ids.

This replaces the fold by Spark higher-order functions, which gave the same
ids but took too long (figures: README).  Documents stay where they were read:
nothing is shuffled.  What is broadcast is the vocabulary, a fixed size.  A
task keeps the ids of about ``cache_words`` words at most, and of fewer where
they take more than ``CACHE_BYTES``; the words of one text are all that is held
beside the distinct ones.

Defined results: null or empty texts have no ids and decode to no bytes.  Any
Unicode text decodes to its UTF-8 bytes.  Special-token strings are text.
Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.llm._common import id_and_text, table

CACHE_WORDS = 300_000
#: Memory of the cached words, about: a task has it beside all that the executor holds.
CACHE_BYTES = 16 << 20
#: Besides its text, a cached word has an entry in a dictionary, its number and the end of its ids.
WORD_BYTES = 100
LONG = 64
DECODE_ROWS = 100
#: Text whose new words are folded together: each fold has a fixed cost for every length of word.
FOLD_BYTES = 1 << 19
NO_RANK = np.int64(1 << 60)


class Vocabulary:
    """Ranks as arrays: the pieces' bytes, and for every pair of ids whose
    concatenation has a rank, that rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.ranks = ranks
        pieces = [b""] * self.size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def rank_of(self, left: int, right: int) -> int | None:
        """The rank of one pair."""
        key = left * self.size + right
        at = int(self.pair_keys.searchsorted(key))
        return int(self.pair_ranks[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length."""
        n, width = len(words), len(words[0])
        parts = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(n, width)]
        out: list[list[int]] = [[]] * n
        row = np.arange(n)
        ranks = self.rank(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((n, 0), np.int64)
        while len(row):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            lowest = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), NO_RANK)
            done = lowest == NO_RANK
            if done.any():
                for r, ids in zip(row[done].tolist(), parts[done].tolist(), strict=True):
                    out[r] = ids
                more = ~done
                row, parts, ranks, best, lowest = row[more], parts[more], ranks[more], best[more], lowest[more]
                if not len(row):
                    break
            # every row loses one part: what stands right of the pair moves left
            at, k = np.arange(len(row)), parts.shape[1]
            take = np.arange(k - 1) + (np.arange(k - 1) > best[:, None])
            parts = parts[at[:, None], take]
            parts[at, best] = lowest
            if k - 1 < 2:
                ranks = ranks[:, :0]
                continue
            take = np.arange(k - 2) + (np.arange(k - 2) >= best[:, None])
            ranks = ranks[at[:, None], take]
            left, right = best > 0, best < k - 2
            ranks[at[left], best[left] - 1] = self.rank(parts[at[left], best[left] - 1], lowest[left])
            ranks[at[right], best[right]] = self.rank(lowest[right], parts[at[right], best[right] + 1])
        return out

    def fold_long(self, word: bytes) -> list[int]:
        """Ids of one word through a heap of its pairs."""
        parts = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        ids, n = parts.tolist(), len(word)
        after, before, rank_of = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of
        heap = [(r, i, i + 1) for i, r in enumerate(self.rank(parts[:-1], parts[1:]).tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or j >= n or rank_of(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(rank, ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i], i))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        encoded = [w.encode() for w in words]
        for k, word in enumerate(encoded):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = [whole]
            elif len(word) > LONG:
                out[k] = self.fold_long(word)
            else:
                by_length.setdefault(len(word), []).append(k)
        for at in by_length.values():
            for k, ids in zip(at, self.fold([encoded[k] for k in at]), strict=True):
                out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' bytes one after the other, and the end of each piece."""
        pieces = pa.Array.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(self.bounds), pa.py_buffer(self.bytes)])
        _, bounds, data = pieces.take(pa.array(ids)).buffers()
        ends = np.frombuffer(bounds, np.int64, len(ids) + 1)[1:]
        return np.frombuffer(data, np.uint8, ends[-1]) if len(ids) else np.zeros(0, np.uint8), ends


def word_pattern(pattern: str):
    """The pattern, compiled; its white space is the Unicode property, which a
    Python pattern's ``\\s`` exceeds by four control characters."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Places(dict):
    """Words and their numbers, in the order in which they were first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts, with a cache of the words met so far.  It is emptied before
    the next texts once it has ``cache_words`` words or takes about
    ``cache_bytes`` of memory."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        self.vocabulary, self.words_of = vocabulary, word_pattern(pattern).findall
        self.cache_words, self.cache_bytes = cache_words, cache_bytes
        self.clear()

    def clear(self) -> None:
        self.place, self.held = Places(), 0
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int32)

    def places(self, text: str) -> np.ndarray:
        words = self.words_of(text)
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def learn(self, fresh: list[str]) -> None:
        ids = self.vocabulary.encode_words(fresh)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.held += sum(map(getsizeof, fresh)) + WORD_BYTES * len(fresh)

    def encode(self, texts: list[str | None]) -> pa.Array:
        if len(self.place) >= self.cache_words or self.held + self.flat.nbytes >= self.cache_bytes:
            self.clear()
        known = len(self.place)
        at = [self.places(t or "") for t in texts]
        self.learn(list(islice(self.place, known, None)))
        edges = np.concatenate([[0], np.cumsum([len(a) for a in at], dtype=np.int64)])
        words = pa.ListArray.from_arrays(pa.array(self.bounds), pa.array(self.flat))
        taken = words.take(pa.array(np.concatenate([np.zeros(0, np.int32), *at])))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[edges]), taken.values)


def encode_batches(batches: Iterator[pa.Array], vocabulary: Vocabulary, pattern: str, cache_words: int) -> Iterator[pa.Array]:
    encoder = Encoder(vocabulary, pattern, cache_words)
    for batch in batches:
        parts = [encoder.encode(texts.to_pylist()) for _, texts in _seq.slices(batch, FOLD_BYTES)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode_lists(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    data, ends = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    made = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
    return made.cast(pa.binary())


def decode_batches(batches: Iterator[pa.Array], vocabulary: Vocabulary) -> Iterator[pa.Array]:
    for batch in batches:
        step = DECODE_ROWS
        parts = [decode_lists(batch.slice(a, step), vocabulary) for a in range(0, len(batch), step)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


class Tokenizer:
    """Encoding and decoding as Column functions.  ``path`` is a file of base64
    pieces and ranks, read once on the driver."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        # plain arrays and dictionaries, so that executors can read them without this package
        self._state = spark.sparkContext.broadcast(vars(Vocabulary.read(path)))
        self._pattern, self._cache_words = pattern, cache_words

    def encode(self, text: Column) -> Column:
        shared, pattern, cache_words = self._state, self._pattern, self._cache_words

        @F.arrow_udf("array<int>")
        def bpe_encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from encode_batches(texts, Vocabulary.of(shared.value), pattern, cache_words)

        return bpe_encode(text)

    def both_ways(self):
        """A function of batches of doc_id and text, for ``mapInArrow``."""
        shared, pattern, cache_words = self._state, self._pattern, self._cache_words

        @_seq.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary.of(shared.value)
            encoder = Encoder(vocabulary, pattern, cache_words)
            for batch in batches:
                for at, texts in _seq.slices(batch["text"], FOLD_BYTES):
                    ids = encoder.encode(texts.to_pylist())
                    columns = [batch["doc_id"].slice(at, len(texts)), ids, decode_lists(ids, vocabulary)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

        return run

    def decode(self, ids: Column) -> Column:
        shared = self._state

        @F.arrow_udf("binary")
        def bpe_decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from decode_batches(lists, Vocabulary.of(shared.value))

        return bpe_decode(ids)


def production_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``, one row per row of ``docs``: the ids, and the
    bytes decoded from them, by one Python worker a task."""
    return id_and_text(docs, id_col, text_col).mapInArrow(tokenizer.both_ways(), "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), production_tokenizer(spark)))
