"""Strings of a fixed width that also start in a document with a smaller id:
the exchange shared by suffix-array and suffix-tree dedup.

A width of 50 bytes (or 13 words) is too much to ship for every position of a
corpus, so positions are sampled first.  Every window of ``width`` symbols
names one anchor: the smallest hash among its grams of ``gram`` symbols.  Equal
windows name equal anchors, and neighbouring windows mostly share one, so a
text falls into runs of windows, one run for each anchor.

1. ``blocks``: documents are packed, some megabytes to a row, and written once
   to the shared folder.  All later rounds read these rows, so a lost executor
   or a repeated task meets the same blocks again.
2. Round 1 deals every block's distinct anchor names by range of the name.
   Names of a single document are discarded; they can't start a repeat.
3. Round 2 deals the runs of the remaining anchors, distinct within a block,
   by anchor, with their content.  The receiving task ranks the windows of its
   runs (``Kind.resolve``) and answers which of them start in a smaller id too.
4. The answers return to their blocks, which mark the covered symbols.

Every exchange is a Spark shuffle of packed binary rows.  Skew: within a block
equal runs are sent once, so a passage of a third of all documents costs one
row for each block; an anchor of very many different runs (``hot_runs``) is dealt
by the windows' own hashes instead, so that it falls into many groups.  Buckets
grow in number with the blocks, not in size.

Names are 64-bit hashes; round 1 uses 48 bits of them, where a collision only
lets a candidate pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm import _seq
from trendlens.sources.writers import materialize

BLOCK_BYTES = 1 << 20
BLOCKS_PER_BUCKET = 8
#: A bucket's runs are ranked in so many slices, so that the windows of one
#: slice only are in memory.
SLICES = 32
#: An anchor whose runs of distinct content number more than this, counted block
#: by block, is dealt by its windows; so the runs of one anchor fit one slice.
HOT_RUNS = 50_000
LAST_ID = np.iinfo(np.int64).max  # a null id comes after all others
U = np.uint64


@dataclass(frozen=True)
class Symbols:
    """The symbols of a block: their values, the bounds of each document in
    symbols, and the byte bounds of each symbol in ``buf``."""

    values: np.ndarray
    offsets: np.ndarray
    buf: np.ndarray
    byte_start: np.ndarray
    byte_end: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What the rounds need to know of the symbols.  ``resolve`` gets a buffer,
    the byte bounds, window counts and document ids of runs, and returns for
    each window, run after run, whether it starts under a smaller id too."""

    width: int
    gram: int
    symbols: Callable[[list[bytes]], Symbols]
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _ints(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


# --- blocks -------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def packed() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        row = ((task << 32) + made, ids, lengths.tobytes(), _zip(b"".join(texts)))
        return _batch([row], ["block", "ids", "lengths", "text"], [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text) + 64
            if held >= BLOCK_BYTES:
                yield packed()
                ids, texts, held, made = [], [], 0, made + 1
    if ids:
        yield packed()


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` packed into rows of about ``BLOCK_BYTES`` of text,
    written once.  A document is never split."""
    return materialize(docs.mapInArrow(_pack, "block long, ids array<long>, lengths binary, text binary"), "blocks")


class Block:
    def __init__(self, ids, lengths: bytes, text: bytes):
        self.ids = ids
        self.order = np.array([LAST_ID if i is None else i for i in ids], dtype=np.int64)
        self.lengths = _ints(lengths)
        raw, ends = _unzip(text), np.cumsum(self.lengths)
        self.texts = [raw[e - n : e] for e, n in zip(ends.tolist(), self.lengths.tolist(), strict=True)]


def _blocks_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for i in range(table.num_rows):
        yield table["block"][i].as_py(), Block(table["ids"][i].as_py(), table["lengths"][i].as_py(), table["text"][i].as_py())


# --- runs ---------------------------------------------------------------------


@dataclass
class Runs:
    """Windows that share an anchor: first window, number of windows, hash of
    the anchor's gram, document number."""

    start: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.start[at], self.size[at], self.anchor[at], self.doc[at])


def anchor_runs(s: Symbols, kind: Kind, chunk: int = 1 << 16) -> Runs:
    n, width = len(s.values), kind.width
    ends = np.repeat(s.offsets[1:], np.diff(s.offsets))
    starts, sizes, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, n - width + 1, chunk):
        grams = _seq.gram_hash(_seq.prefix_sums(s.values[at : at + chunk + width - 1]), kind.gram)
        chosen = _seq.sliding_argmin(grams, width - kind.gram + 1)
        inside = np.arange(at, at + len(chosen)) + width <= ends[at : at + len(chosen)]
        first = np.flatnonzero(inside & np.r_[True, (chosen[1:] != chosen[:-1]) | ~inside[:-1]])
        counted = np.r_[0, np.cumsum(inside)]
        starts.append(first + at)
        sizes.append(np.diff(np.r_[counted[first], counted[-1]]))
        # anchors are the smallest hashes of their windows: mixed anew, so that
        # ranges of the name hold equal shares
        anchors.append(_seq.mix(grams[chosen[first]] + U(0xA0761D6478BD642F)))
    start = np.concatenate(starts)
    doc = np.searchsorted(s.offsets, start, side="right") - 1
    return Runs(start, np.concatenate(sizes), np.concatenate(anchors), doc)


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    return ((names >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


# --- round 1: which anchors stand in more than one document ---------------------

_NAME_BITS = U((1 << 64) - (1 << 16))


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted names, their six upper bytes plane by plane."""
    return _zip(names.view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes())


def _unpack_names(data: bytes) -> np.ndarray:
    planes = _ints(_unzip(data), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return out.reshape(-1).view(np.uint64)


def _contents(s: Symbols, kind: Kind, runs: Runs) -> np.ndarray:
    """Hash of each run's content."""
    return _seq.range_hash(_seq.prefix_sums(s.values), runs.start, runs.start + runs.size + kind.width - 1)


def _names(runs: Runs, content: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, sorted; for every run the place of its name; for each
    name whether documents of different ids hold it, and how many contents."""
    short = runs.anchor & _NAME_BITS
    order = np.lexsort((content, short))
    first = _groups(short[order])
    ids, content = block.order[runs.doc[order]], content[order]
    differ, fresh = np.r_[False, ids[1:] != ids[:-1]], np.r_[True, content[1:] != content[:-1]]
    differ[first], fresh[first] = False, True
    several = np.add.reduceat(differ, first) > 0 if len(first) else np.zeros(0, bool)
    contents = np.add.reduceat(fresh.astype(np.uint32), first) if len(first) else np.zeros(0, np.uint32)
    place = np.empty(len(short), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(short)]))
    return short[order][first], place, several, contents.astype(np.uint32)


_NAME_FIELDS = {"bucket": pa.int64(), "block": pa.int64(), "names": pa.binary(), "several": pa.binary(), "contents": pa.binary()}


def _send_names(batches: Iterator[pa.RecordBatch], kind: Kind, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, block in _blocks_of(batch):
            s = kind.symbols(block.texts)
            runs = anchor_runs(s, kind)
            names, _, several, contents = _names(runs, _contents(s, kind, runs), block)
            bucket = _bucket(names, n_buckets)
            first = _groups(bucket)
            rows = [
                (int(bucket[a]), number, _pack_names(names[a:b]), np.packbits(several[a:b]).tobytes(), _zip(contents[a:b].tobytes()))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(names)], strict=True)
            ]
            yield _batch(rows, list(_NAME_FIELDS), list(_NAME_FIELDS.values()))


def _judge_names(table: pa.Table, hot_runs: int) -> pa.Table:
    """0: one document only, 1: repeated, 2: repeated, in very many runs."""
    parts = [_unpack_names(x) for x in table["names"].to_pylist()]
    several = [np.unpackbits(_ints(x, np.uint8), count=len(p)) for x, p in zip(table["several"].to_pylist(), parts, strict=True)]
    contents = np.concatenate([_ints(_unzip(x), np.uint32) for x in table["contents"].to_pylist()])
    _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    more = np.bincount(place, weights=np.concatenate(several), minlength=len(n)) > 0
    hot = np.bincount(place, weights=contents, minlength=len(n)) > hot_runs
    verdict = np.where((n > 1) | more, 1 + hot, 0).astype(np.uint8)[place]
    cuts = np.cumsum([0, *map(len, parts)])
    answers = [verdict[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table["block"], "round": pa.array([1] * len(parts), pa.int32()), "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})


# --- round 2: which windows start under a smaller id ------------------------------


@dataclass
class Sent:
    """What a block sends in round 2: all remaining runs, and those of distinct
    content (``lead``, in the order of buckets) that speak for the others."""

    runs: Runs
    leader: np.ndarray  # for each run, the place of its leader in ``lead``
    lead: np.ndarray
    slice: np.ndarray  # of each leader: bucket * SLICES + slice in the bucket


def _remaining(s: Symbols, kind: Kind, block: Block, verdicts: np.ndarray, n_buckets: int) -> Sent:
    runs = anchor_runs(s, kind)
    _, place, _, _ = _names(runs, _contents(s, kind, runs), block)
    verdict = verdicts[place]
    plain, hot = runs.take(verdict == 1), runs.take(verdict == 2)
    # the windows of a hot anchor go their own ways
    each = Runs(_ranges(hot.start, hot.size), np.ones(int(hot.size.sum()), np.int64), np.repeat(hot.anchor, hot.size), np.repeat(hot.doc, hot.size))
    runs = Runs(*(np.concatenate([getattr(plain, f), getattr(each, f)]) for f in ("start", "size", "anchor", "doc")))
    content = _contents(s, kind, runs)
    key = np.where(np.arange(len(content)) < len(plain.start), runs.anchor, content)
    ids = block.order[runs.doc]
    order = np.lexsort((ids, content, key))
    mark = np.r_[True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])] if len(order) else np.zeros(0, bool)
    leader = np.empty(len(order), np.int64)
    leader[order] = np.cumsum(mark) - 1
    lead = order[mark]  # sorted by key, so by bucket
    return Sent(runs, leader, lead, _bucket(key[lead], n_buckets * SLICES))


def _verdicts(answers: pa.Table, round_: int, kind) -> np.ndarray:
    rows = sorted((b, a) for r, b, a in zip(*(answers[c].to_pylist() for c in ("round", "bucket", "answer")), strict=True) if r == round_)
    return np.concatenate([np.zeros(0, kind), *(_ints(a, kind) for _, a in rows)])


_RUN_FIELDS = {"bucket": pa.int64(), "block": pa.int64(), "content": pa.binary(), "length": pa.binary(), "windows": pa.binary(), "ids": pa.binary(), "slices": pa.binary()}


def _send_runs(left: pa.Table, answers: pa.Table, kind: Kind, n_buckets: int) -> pa.Table:
    rows = []
    for number, block in _blocks_of(left):
        s = kind.symbols(block.texts)
        sent = _remaining(s, kind, block, _verdicts(answers, 1, np.uint8), n_buckets)
        lead = sent.runs.take(sent.lead)
        begin, end = s.byte_start[lead.start], s.byte_end[lead.start + lead.size + kind.width - 2]
        ids = block.order[lead.doc]
        bucket = sent.slice // SLICES
        first = _groups(bucket)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lead.start)], strict=True):
            size = end[a:b] - begin[a:b]
            content = s.buf[_ranges(begin[a:b], size)].tobytes()
            counts = np.bincount(sent.slice[a:b] % SLICES, minlength=SLICES).astype(np.int32)
            arrays = (size.astype(np.int32), lead.size[a:b].astype(np.uint8), ids[a:b], counts)
            rows.append((int(bucket[a]), number, _zip(content), *(x.tobytes() for x in arrays)))
    return pa.Table.from_batches([_batch(rows, list(_RUN_FIELDS), list(_RUN_FIELDS.values()))])


def _judge_runs(table: pa.Table, kind: Kind) -> pa.Table:
    """For each run a number whose bit i says that window i is repeated."""
    rows = []
    for content, length, windows, ids, counts in zip(*(table[c].to_pylist() for c in ("content", "length", "windows", "ids", "slices")), strict=True):
        size = _ints(length, np.int32).astype(np.int64)
        cuts = np.r_[0, np.cumsum(_ints(counts, np.int32))]
        rows.append((_ints(_unzip(content), np.uint8), np.r_[0, np.cumsum(size)], _ints(windows, np.uint8).astype(np.int64), _ints(ids), cuts))
    answers = [np.zeros(len(r[2]), np.uint64) for r in rows]
    for i in range(SLICES):
        parts = [(k, int(r[4][i]), int(r[4][i + 1])) for k, r in enumerate(rows) if r[4][i] < r[4][i + 1]]
        if not parts:
            continue
        buf = np.concatenate([rows[k][0][rows[k][1][a] : rows[k][1][b]] for k, a, b in parts])
        length = np.concatenate([np.diff(rows[k][1][a : b + 1]) for k, a, b in parts])
        windows = np.concatenate([rows[k][2][a:b] for k, a, b in parts])
        end = np.cumsum(length)
        repeated = kind.resolve(buf, np.stack([end - length, end]), windows, np.concatenate([rows[k][3][a:b] for k, a, b in parts]))
        place = _ranges(np.zeros(len(windows), np.int64), windows).astype(np.uint64)
        masks = np.add.reduceat(np.where(repeated, U(1) << place, U(0)), np.cumsum(windows) - windows)
        at = 0
        for k, a, b in parts:
            answers[k][a:b] = masks[at : at + b - a]
            at += b - a
    packed = [a.tobytes() for a in answers]
    return pa.table({"block": table["block"], "round": pa.array([2] * len(packed), pa.int32()), "bucket": table["bucket"], "answer": pa.array(packed, pa.binary())})


def _covered(s: Symbols, kind: Kind, block: Block, answers: pa.Table, n_buckets: int) -> np.ndarray:
    """For each symbol whether a repeated window covers it."""
    sent = _remaining(s, kind, block, _verdicts(answers, 1, np.uint8), n_buckets)
    masks = _verdicts(answers, 2, np.uint64)[sent.leader]
    ids, lead_ids = block.order[sent.runs.doc], block.order[sent.runs.doc[sent.lead]][sent.leader]
    whole = ids > lead_ids  # the same run stands under a smaller id in this block
    windows = _ranges(sent.runs.start, sent.runs.size)
    bit = _ranges(np.zeros(len(sent.runs.size), np.int64), sent.runs.size).astype(np.uint64)
    repeated = np.repeat(whole, sent.runs.size) | (np.repeat(masks, sent.runs.size) >> bit & U(1)).astype(bool)
    edges = np.zeros(len(s.values) + 1, np.int64)
    np.add.at(edges, windows[repeated], 1)
    np.add.at(edges, windows[repeated] + kind.width, -1)
    return np.cumsum(edges[:-1]) > 0


# --- all rounds -----------------------------------------------------------------


def remove_repeats(
    docs: DataFrame, kind: Kind, finish: Callable[[Block, Symbols, np.ndarray], pa.Table], schema: str, hot_runs: int = HOT_RUNS
) -> DataFrame:
    """``finish`` makes a block's result rows from the covered symbols.  ``docs``
    has ``doc_id`` and ``text``."""
    packed = blocks(docs)
    n_buckets = max(1, packed.count() // BLOCKS_PER_BUCKET)
    binary = ", ".join(f"{c} {'long' if t == pa.int64() else 'binary'}" for c, t in _RUN_FIELDS.items())
    answer = "block long, round int, bucket long, answer binary"

    names = packed.mapInArrow(lambda it: _send_names(it, kind, n_buckets), "bucket long, block long, names binary, several binary, contents binary")
    first = names.groupBy("bucket").applyInArrow(lambda t: _judge_names(t, hot_runs), answer)
    first = materialize(first, "anchors")  # a few bytes for each anchor; read by both joins below
    runs = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(lambda a, b: _send_runs(a, b, kind, n_buckets), binary)
    second = runs.groupBy("bucket").applyInArrow(lambda t: _judge_runs(t, kind), answer)

    def done(left: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for _, block in _blocks_of(left):
            s = kind.symbols(block.texts)
            out.append(finish(block, s, _covered(s, kind, block, answers, n_buckets)))
        return pa.concat_tables(out)

    answers = first.unionByName(second)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(done, schema)
