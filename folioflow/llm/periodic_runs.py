"""Periodic runs of words, found by a suffix automaton whose sets of end positions are merged small to large.

A run is a stretch of words of smallest period q, at least MIN_LENGTH words and EXPONENT times q long, that no neighbouring word extends. The
states of the automaton are visited by falling length, and each state's ordered end positions go into those of its suffix link, the smaller set into the
larger. A position that comes to stand beside one of another branch shares exactly ``length of the state`` words with it
to the left, so a distance of no more than that length makes a square. It is extended by these words to the left; to the
right it isn't, since the last two places of a run, one period apart, are neighbours too, and only their seed is kept. If several seeds
have one stretch, the least distance is its period.

Before that, words that can be in no run are set aside: within a run every two-word window has an equal one within q words, so stretches of windows with one
nearby (a quarter of the stretch) are all that an automaton needs to read. This leaves out no run.

A null or empty text has no words and no runs. Repeated rows are rows like others, ties among runs do not arise (a stretch has one period), other columns stay as
they are, an empty table gives no rows. A very long text is one row: its automaton takes some 600 bytes a word of its periodic stretches.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import _BYTE, Block, blocks, joined, mix, returns_memory
from .workspace import unused

MIN_LENGTH, EXPONENT = 6, 4
_PIECE = 2048


class EndPositions:
    """An ordered set of places, in sorted pieces so that insertion stays cheap in large sets."""

    __slots__ = ("firsts", "pieces", "size")

    def __init__(self, place: int):
        self.firsts, self.pieces, self.size = [place], [[place]], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Puts in a new place; its neighbours."""
        k = max(0, bisect(self.firsts, place) - 1)
        piece = self.pieces[k]
        j = bisect(piece, place)
        before = piece[j - 1] if j else (self.pieces[k - 1][-1] if k else None)
        after = piece[j] if j < len(piece) else (self.pieces[k + 1][0] if k + 1 < len(self.pieces) else None)
        piece.insert(j, place)
        self.size += 1
        if not j:
            self.firsts[k] = place
        if len(piece) > _PIECE:
            half = len(piece) // 2
            self.pieces[k : k + 1] = [piece[:half], piece[half:]]
            self.firsts.insert(k + 1, piece[half])
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[EndPositions | None]]:
    """Lengths, suffix links and own end positions of the states of a suffix automaton; state 0 is the empty word."""
    edges, length, link, ends = [{}], [0], [-1], [None]
    last = 0
    for place, word in enumerate(words):
        new, state = len(edges), last
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(EndPositions(place))
        while state >= 0 and word not in edges[state]:
            edges[state][word] = new
            state = link[state]
        if state >= 0:
            to = edges[state][word]
            if length[to] != length[state] + 1:
                split = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[state] + 1)
                link.append(link[to])
                ends.append(None)
                link[to] = split
                while state >= 0 and edges[state].get(word) == to:
                    edges[state][word] = split
                    state = link[state]
                to = split
            link[new] = to
        last = new
    return length, link, ends


def runs_of(words: list[int], least: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, found = len(words), {}
    length, link, ends = automaton(words)
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        to = link[state]
        if to <= 0:
            ends[state] = None  # positions meet at the empty word with nothing shared
            continue
        large, small, shared = ends[to], ends[state], length[to]
        ends[state] = None
        if large is None:
            ends[to] = small
            continue
        if len(large) < len(small):
            large, small = small, large
        ends[to] = large
        brought = None
        for place in small:
            before, after = large.add(place)
            for x, y in ((before, place), (place, after)):
                if x is None or y is None or x == brought:
                    continue  # two places of one branch were neighbours before
                period = y - x
                size = shared + period
                if size >= exponent * period and size >= least and (y + 1 == n or words[y + 1] != words[y + 1 - period]):
                    key = (y - size + 1, size)
                    found[key] = min(period, found.get(key, period))
            brought = place
    return sorted((start, size, period) for (start, size), period in found.items())


def stretches(words: np.ndarray, before: np.ndarray, least: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of all stretches that may hold runs, of word hashes and the number of words before each text."""
    none = np.zeros(0, np.int64)
    if len(words) < least:
        return none, none
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(text[1:] == text[:-1])
    keys = mix(words[at] + words[at + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(text[at].astype(np.uint64)) * np.uint64(5))
    order = np.argsort(keys, kind="stable")
    same, gap = keys[order[1:]] == keys[order[:-1]], at[order[1:]] - at[order[:-1]]
    near = np.full(len(at), len(words))
    near[order[1:]] = np.where(same, gap, len(words))
    near[order[:-1]] = np.minimum(near[order[:-1]], np.where(same, gap, len(words)))
    chosen = near < len(words)
    at, near = at[chosen], near[chosen]
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1)]))
        size = np.diff(np.append(first, len(at)))
        # a text's last word begins no window, so stretches end with their texts
        most = np.repeat(size, size)
        keep = (most + 1 >= least) & (exponent * near <= most + 1)
        if keep.all():
            return at[first], at[first] + size + 1
        at, near = at[keep], near[keep]
    return none, none


def _block(block: Block) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    """Numbers of words, runs, and the texts without what runs repeat, words joined by one space."""
    starts, ends, before = block.words()
    words = block.hashes(starts, ends, _BYTE)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
    kept = np.ones(len(starts), bool)
    for a, b in zip(*stretches(words, before), strict=True):
        text = int(np.searchsorted(before, a, "right")) - 1
        for start, size, period in runs_of(np.unique(words[a:b], return_inverse=True)[1].tolist()):
            kept[a + start + period : a + start + size] = False
            runs[text].append((int(a - before[text]) + start, size, period))
    before = np.concatenate([[0], np.cumsum(kept)])[before]
    starts, ends = starts[kept], ends[kept]
    last = np.zeros(len(starts), bool)
    last[before[1:][np.diff(before) > 0] - 1] = True
    data, begin = joined(block, starts, ends, last)
    bounds = np.append(begin, len(data))[before]
    return before, runs, pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@returns_memory
def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch["text"]):
            _, runs, collapsed = _block(block)
            flat = [r for x in runs for r in x]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
            parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
            yield pa.record_batch([batch["row"].slice(block.first, len(block)), lists, collapsed], ["row", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text (and runs or collapsed, if it has them), with ``runs`` (start, length, period of each, by start and period) and ``collapsed``: the text with the first period of each run only, words joined by one space."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "runs", "collapsed")]
    row = unused(kept, "row")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias(unused(kept, "_"))).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    out = packed.mapInArrow(_found, schema).withColumnRenamed("row", row)
    return out.select(*(F.col(f"`{row}`.`{c}`").alias(c) for c in kept), "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end in one document of ten, chosen with place and period by its id; others, also those of null ids, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    end = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), end), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
