"""Numpy helpers for sequences of symbols (bytes or words) inside tasks: word
bounds and hashes of many texts at once, hashes of k consecutive symbols, and
window minimizers.

Hashes are 64-bit: a prefix sum of random symbol values times powers of an odd
number, whose difference over a range, scaled back, depends on the range's
content alone; a final mix spreads it over all bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_ODD_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: The ASCII white-space bytes.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _ODD_INV if inverse else _ODD, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`range_hash` takes its differences."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(len(values), False), dtype=np.uint64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [start, end), end > start or equal."""
    inv = _power(len(sums), True)
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from every position on; len - k + 1 of them."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((sums[k:] - sums[:-k]) * _power(n, True) + U(k))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def slices(texts: pa.Array, most_bytes: int = 1 << 18, most_texts: int = 1000) -> Iterator[tuple[int, pa.Array]]:
    """The array in pieces of about ``most_bytes`` of text (one text at least)
    and of ``most_texts`` at most, with the place of each: what is computed for
    the texts of a batch need not fit at once."""
    if not len(texts):
        return
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // most_bytes
    edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    cuts = [*np.union1d(edges, np.arange(0, len(texts), most_texts)).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, texts.slice(a, b - a)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, after which a reused Python worker gives back what the task has
    freed: the allocators would keep it, beside the next stage's memory."""

    def task(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Words:
    """The words of many texts: text number, bounds in ``buf`` and hash of each,
    and ``offsets`` such that text i has words offsets[i] to offsets[i + 1]."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)]) if len(texts) else np.zeros(1, dtype=np.int64)
        space = IS_SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # the buffer ends with a space
        self.offsets = np.searchsorted(self.start, self.text_start)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.joined = joined

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_sums(byte_values(self.buf)), self.start, self.end)


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest key (the first of equals) of every window of w
    keys.  The low 24 bits of a key make room for its position."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = U((1 << 24) - 1)
    m = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return (m[:n] & low).astype(np.int64)
