"""Vectorised word, line and shingle hashes over blocks of Arrow strings.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Those are ASCII, so working on UTF-8
bytes splits exactly where working on characters would.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def returns_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives freed memory back to the system when a task ends: its worker lives on, idle or with another task."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_FOLDED = _LOWER.copy()
_FOLDED[48:58] = _BYTE[48]
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n + 1 powers of the base and of its inverse modulo 2**64. Those of a block are kept, those of a longer text are not."""
    if len(_powers[0]) <= n:
        more = []
        for b in (_BASE, _INVERSE):
            p = np.full(max(n, BLOCK_BYTES) + 1, b, np.uint64)
            p[0] = 1
            more.append(np.cumprod(p, dtype=np.uint64))
        if n > BLOCK_BYTES:
            return more[0], more[1]
        _powers[:] = more
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Some texts, back to back. ``bounds`` has one more entry than there are texts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words before each text. ``space``: which bytes part words."""
        word = ~space[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.bounds] = True
        before = np.empty_like(word)
        if len(word):
            before[0], before[1:] = False, word[:-1]
        after = np.zeros_like(word)
        after[:-1] = word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _LOWER) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        p, inverse = powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * p[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a column into blocks of about ``limit`` bytes; a longer text is a block of its own."""
    data, bounds = strings(column)
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Block(at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def shingles(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of a block, and the bounds of each text's.

    A text of one to four words has one shingle: its whole sequence.
    """
    n = np.diff(before)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(before[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    size = np.minimum(np.repeat(n, count), SHINGLE)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    out = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(SHINGLE):
        out += np.where(k < size, padded[first + k] * _PLACE[k], np.uint64(0))
    return mix(out), bounds


def shingle_sets(block: Block) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, before = block.words()
    values, bounds = shingles(block.hashes(starts, ends), before)
    for i in range(len(block)):
        part = np.sort(values[bounds[i] : bounds[i + 1]])
        yield part if len(part) < 2 else part[np.concatenate([[True], part[1:] != part[:-1]])]


def signature(values: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        x = np.array([np.bitwise_xor.reduce(mix(values + np.uint64(17))) + values.sum(dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(values))], np.uint64)
    return int(mix(x).view(np.int64)[0])


_AS_IS = np.arange(256, dtype=np.uint8)
LOWERED = _AS_IS.copy()
LOWERED[65:91] += 32


def joined(block: Block, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, table: np.ndarray = _AS_IS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some words of a block, a space after each but those that are the ``last`` of a text, and where each word begins there."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + ~last)])
    out = np.full(begin[-1], 32, np.uint8)
    passed = np.cumsum(size) - size
    at = np.arange(size.sum())
    out[at + np.repeat(begin[:-1] - passed, size)] = table[block.data[at + np.repeat(starts - passed, size)]]
    return out, begin[:-1]
