"""Packing by vector bin packing: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

One sequence is open at a time. Of the waiting examples that fit its residual capacity in all three dimensions, the one
with the highest dot product of its sizes and that residual goes in. When none fits, and
cutting is allowed, an example is cut to fill the hole; else the sequence is closed and padded. Examples longer than a sequence
fill whole ones first.

Each task packs what it reads, with a bounded number of examples waiting, so nothing is shuffled and no
state is shared; a repeated task gives the same rows. Sequence ids are the task's number in the upper bits and a
counter in the lower.

A null text is empty: its one token is the end. Repeated rows and null ids are documents of their own. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import returns_memory

TOKENS = 2048
#: Segments of a sequence of instruction data; documents have no such limit, as each piece has a token at least.
SEGMENTS = 256
END = 1
#: Examples that wait for a place in one task.
WAITING = 4096
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MASKED = f"{PIECES}, learned long"
#: Texts of these characters only are encoded by the faster library, which has the same vocabulary and splits them alike.
_PLAIN = re.compile("[^\u0000-ɏ‐-‧‰-⁞]|<\\|endoftext\\|>")


class Encoder:
    """Token ids as ``tokenizers`` gives them, without special tokens added."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = vocabulary

    @functools.cached_property
    def full(self):
        """Loaded for the first text that needs it."""
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """One of a worker's process, whatever the number of its tasks."""
    return Encoder(vocabulary)


@dataclass
class Example:
    """What is left of a document: its ids from ``start`` on. ``learned``: which of all its ids bear loss, or None for all."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    learned: np.ndarray | None = None

    def size(self) -> tuple[int, int, int]:
        n = len(self.ids) - self.start
        return n, 1, n if self.learned is None else int(self.learned[self.start :].sum())


class Packer:
    """Packs examples into sequences, one after the other; ``done`` gathers pieces as PIECES has them."""

    def __init__(self, first_id: int, limits: tuple[int, int, int] = (TOKENS, TOKENS, TOKENS), cut: bool = True):
        self.limits, self.cut, self.sequence = np.array(limits, float), cut, first_id
        self.items: list[Example | None] = [None] * WAITING
        self.sizes = np.zeros((WAITING, 3))
        self.empty = list(range(WAITING))[::-1]
        self.done: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.room, self.offset = self.limits.copy(), 0

    def _close(self) -> None:
        if self.offset:
            self.sequence += 1
            self._open()

    def _put(self, x: Example, n: int) -> None:
        ids = x.ids[x.start : x.start + n]
        learned = n if x.learned is None else int(x.learned[x.start : x.start + n].sum())
        self.done.append((x.doc_id, x.start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(x.ids), self.sequence, self.offset, learned))
        self.offset += n
        self.room -= (n, 1, learned)
        x.start += n

    def add(self, x: Example) -> None:
        if self.cut:
            while x.size()[0] >= self.limits[0] and x.size()[2] == x.size()[0] and not self.offset:
                self._put(x, int(self.limits[0]))
                self._close()
        else:
            while x.size()[0] > self.limits[0] or x.size()[2] > self.limits[2]:  # fits no sequence: its head takes one alone
                n = int(self.limits[0])
                if x.learned is not None:
                    n = min(n, int(np.searchsorted(np.cumsum(x.learned[x.start :]), self.limits[2], "right")))
                self._put(x, n)
                self._close()
        if not x.size()[0]:
            return
        if not self.empty:
            self.fill()
        k = self.empty.pop()
        self.items[k], self.sizes[k] = x, x.size()

    def _take(self, k: int, n: int) -> None:
        x = self.items[k]
        self._put(x, n)
        if x.start == len(x.ids):
            self.items[k], self.sizes[k] = None, 0
            self.empty.append(k)
        else:
            self.sizes[k] = x.size()

    def fill(self) -> None:
        """Fills one sequence from what waits."""
        while True:
            fits = (self.sizes[:, 0] > 0) & (self.sizes <= self.room).all(axis=1)
            value = np.where(fits, (self.sizes / self.limits) @ (self.room / self.limits), -1.0)
            k = int(np.argmax(value))
            if value[k] < 0:
                break
            self._take(k, int(self.sizes[k, 0]))
        if self.cut and self.room.min() > 0 and self.sizes[:, 0].any():
            k = int(np.argmax(self.sizes[:, 0]))
            x, hole = self.items[k], int(self.room[0])
            if x.learned is not None:
                hole = min(hole, int(np.searchsorted(np.cumsum(x.learned[x.start :]), self.room[2], "right")))
            if hole:
                self._take(k, hole)
        self._close()

    def finish(self) -> None:
        while len(self.empty) < WAITING:
            self.fill()


def _pieces(vocabulary: str):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                packer.add(Example(doc_id.as_py(), np.append(encode(text.as_py() or ""), np.uint32(END)), 0))
                if len(packer.done) > 20_000:
                    yield _batch(packer.done)
                    packer.done = []
        packer.finish()
        yield _batch(packer.done)

    return run


def _batch(rows: list[tuple], schema: str = PIECES) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True))[: len(names)] if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """PIECES of each row of ``docs`` (doc_id, text): full sequences of TOKENS ids but the last of each task."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary), PIECES)


def _masked(limits: tuple[int, int, int]):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, limits, cut=False)
        for batch in batches:
            for doc_id, ids, learned in zip(batch["doc_id"], batch["ids"], batch["learned"], strict=True):
                ids, mask = np.array(ids.as_py() or [], np.uint32), None
                if learned.is_valid:
                    mask = np.zeros(len(ids), bool)
                    told = np.array([x is True for x in learned.as_py()], bool)[: len(ids)]
                    mask[: len(told)] = told
                packer.add(Example(doc_id.as_py(), ids, 0, mask))
                if len(packer.done) > 20_000:
                    yield _batch(packer.done, MASKED)
                    packer.done = []
        packer.finish()
        yield _batch(packer.done, MASKED)

    return run


def pack_masked(examples: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> DataFrame:
    """MASKED pieces of each row of ``examples`` (doc_id, ids array, learned array: which ids bear loss), under limits on tokens, segments and loss-bearing tokens.

    An example that fits a sequence stays whole. One that fits none is cut: full heads take sequences of their own, the rest is packed
    like others. A null mask is one of all ids, a short one has no loss after its end. No ids, no rows.
    """
    if min(limits) < 1:
        raise ValueError(f"limits {limits}: each must be 1 or more")
    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"), F.col("learned").cast("array<boolean>").alias("learned")
    return examples.select(*columns).mapInArrow(_masked(limits), MASKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
