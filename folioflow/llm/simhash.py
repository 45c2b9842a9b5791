"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit for each bit of the XXH64 (seed 42) of a text's four-word shingles: one where over half of the shingles, repeats
included, have a one. Fingerprints link at BUDGET or fewer differing bits. Distinct fingerprints only are joined, so copies cost nothing.

Of five blocks of bits, two fingerprints within the budget have at least one alike. So there are five tries, each over the fingerprints turned so that
another block comes first, and two nodes that differ within the first block need not meet. What shares a first block is a node at that depth, a
row of 8 bytes and a bit; a task walks down all of its nodes at once: pairs of nodes are split by their next bit, differing bits are added up, and pairs over
the budget go. Pairs of few leaves are compared whole. A node of over NODE_MOST leaves is cut into deeper ones, whose pairs within the
budget are cells of their own, so no task holds more than two such nodes. A task gives out the least fingerprint that each of its own reaches,
never all pairs.

A null text is an empty one: no shingles, fingerprint zero, linked like any other. One of fewer than four words has one shingle, its whole
sequence. A null id is reached like others, but the least id of a component is one that isn't null, if there is one. Repeated rows stay repeated and have one
fingerprint; ties do not arise. Other columns are ignored, an empty table gives no rows, a very long text is hashed whole, some shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, least_members
from .textblocks import LOWERED, Block, blocks, joined, returns_memory
from .workspace import Workspace

SHINGLE, SEED = 4, 42
BUDGET = 4
#: Widths of the blocks of a fingerprint, BUDGET + 1 of them.
WIDTHS = (13, 13, 13, 13, 12)
TURNS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
#: A node of more leaves is cut by STEP more bits.
NODE_MOST, STEP = 1 << 15, 4
#: Rows that a task walks down at once, pairs of nodes that it splits at once, and pairs of leaves that a pair of nodes may stand for when they are compared whole.
ROWS, PAIRS, LEAVES = 1 << 17, 1 << 16, 32
_HASHED = 1 << 16


def prints(block: Block) -> np.ndarray:
    """The fingerprint of each text of a block, as uint64."""
    starts, ends, before = block.words()
    n = np.diff(before)
    last = np.zeros(len(starts), bool)
    last[before[1:][n > 0] - 1] = True
    data, begin = joined(block, starts, ends, last, LOWERED)
    close = begin + (ends - starts)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    ones = np.zeros((len(block), 64), np.int64)
    for at in range(0, int(bounds[-1]), _HASHED):
        k = np.arange(at, min(at + _HASHED, int(bounds[-1])))
        text = np.searchsorted(bounds, k, "right") - 1
        first = before[text] + k - bounds[text]
        a, b = begin[first], close[first + np.minimum(n[text], SHINGLE) - 1]
        raw, base = data[a[0] : b.max()].tobytes(), int(a[0])
        h = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip((a - base).tolist(), (b - base).tolist(), strict=True)), np.uint64, len(k))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        ones[text[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@returns_memory
def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch["text"]):
            yield pa.record_batch([batch["doc_id"].slice(block.first, len(block)), pa.array(prints(block).view(np.int64))], ["doc_id", "f"])


def trie_pairs(v: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``v`` whose values differ in ``budget`` bits at most, from pairs of nodes at a depth.

    A node is a range of places with sorted distinct values; ``x`` and ``y`` are the bounds of the first and second nodes. A node paired with
    itself stands for all pairs within it.
    """
    zeros_upto: dict[int, np.ndarray] = {}
    start = (*x, *y, np.zeros(len(x[0]), np.int8))
    stack = [(depth, tuple(np.asarray(c) for c in start))]
    while stack:
        depth, now = stack.pop()
        if len(now[0]) > PAIRS:
            stack += [(depth, tuple(c[PAIRS:] for c in now)), (depth, tuple(c[:PAIRS] for c in now))]
            continue
        a, b, c, d, off = now
        few = ((b - a) * (d - c) <= LEAVES) | (depth == 64)
        if few.any():
            times = ((b - a) * (d - c))[few]
            own = np.repeat(np.flatnonzero(few), times)
            k = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            wide = (d - c)[own]
            i, j = a[own] + k // wide, c[own] + k % wide
            near = (np.bitwise_count(v[i] ^ v[j]) <= budget) & ((a[own] != c[own]) | (i < j))
            if near.any():
                yield i[near], j[near]
        a, b, c, d, off = (z[~few] for z in now)
        if not len(a):
            continue
        if depth not in zeros_upto:
            zeros_upto[depth] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1) == 0, dtype=np.int32)])
        z = zeros_upto[depth]
        p, q = a + z[b] - z[a], c + z[d] - z[c]  # where ones begin
        one = a != c
        parts = [(a, p, c, q, off), (p, b, q, d, off), (a, p, q, d, off + 1), (p[one], b[one], c[one], q[one], off[one] + 1)]
        nxt = tuple(np.concatenate(z) for z in zip(*parts, strict=True))
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)
        if keep.any():
            stack.append((depth + 1, tuple(z[keep] for z in nxt)))


def _contracted(cell: np.ndarray, side: np.ndarray, turn: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows of whole cells, sorted: (fingerprint, least fingerprint that it reaches among them)."""
    turns = np.array(TURNS, np.uint64)[turn]
    f = np.where(turns == 0, v, (v >> turns) | (v << ((np.uint64(64) - turns) % np.uint64(64)))).view(np.int64)
    new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
    first = np.flatnonzero(new)
    close = np.append(first[1:], len(cell))
    two = np.flatnonzero(side[first] == 1)
    x = (np.where(side[first] == 1, np.roll(first, 1), first), np.where(side[first] == 1, np.roll(close, 1), close))
    keep = np.ones(len(first), bool)
    keep[two - 1] = False  # a cell of two nodes is one pair of them
    mine, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, n = [(mine, least)], 0
    for i, j in trie_pairs(v, (x[0][keep], x[1][keep]), (first[keep], close[keep]), WIDTHS[-1]):
        held.append((f[i], f[j]))
        n += len(i)
        if n > 1 << 20:
            held, n = [least_members(*(np.concatenate(z) for z in zip(*held, strict=True)))], 0
    mine, least = least_members(*(np.concatenate(z) for z in zip(*held, strict=True)))
    other = mine != least
    return pa.record_batch([pa.array(mine[other]), pa.array(least[other])], ["a", "b"])


@returns_memory
def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, side and value; cells stay whole."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        held.append((batch["cell"].to_numpy(), batch["side"].to_numpy(), batch["turn"].to_numpy(), batch["v"].to_numpy().view(np.uint64)))
        n += len(batch)
        if n >= ROWS:
            rows = tuple(np.concatenate(z) for z in zip(*held, strict=True))
            cut = int(np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[-1])
            if cut:
                yield _contracted(*(z[:cut] for z in rows))
            held, n = [tuple(z[cut:] for z in rows)], n - cut
    if n:
        yield _contracted(*(np.concatenate(z) for z in zip(*held, strict=True)))


def _turned(f: Column, by: int) -> Column:
    return f if by == 0 else F.shiftleft(f, by).bitwiseOR(F.shiftrightunsigned(f, 64 - by))


def _cut(rows: DataFrame, work: Workspace) -> DataFrame:
    """cell, side, turn, v of nodes that are too large (turn, head, v): each pair of their smaller nodes that is within the budget is a cell."""
    depth, k = WIDTHS[-1], 0
    key = ["turn", "head", "depth", "node"]
    rows = rows.withColumns({"depth": F.lit(depth), "node": F.shiftrightunsigned("v", 64 - depth)})
    done = None
    while True:
        rows = work.save(rows, f"deeper-{k}")
        big = rows.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") > NODE_MOST)
        small = rows.join(big, key, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        if depth + STEP > 64 or big.isEmpty():
            break
        depth, k = depth + STEP, k + 1
        rows = rows.join(big, key, "left_semi").select("turn", "head", "v", F.lit(depth).alias("depth"), F.shiftrightunsigned("v", 64 - depth).alias("node"))
    done = work.save(done, "nodes")
    nodes = done.select(*key).distinct()
    up = lambda n, d: F.expr(f"shiftrightunsigned({n}.node, {n}.depth - {d})")
    least = "least(x.depth, y.depth)"
    near = F.bit_count(up("x", least).bitwiseXOR(up("y", least))) <= BUDGET
    order = F.expr("x.depth < y.depth or x.depth = y.depth and x.node <= y.node")
    pairs = nodes.alias("x").join(nodes.alias("y"), (F.col("x.turn") == F.col("y.turn")) & (F.col("x.head") == F.col("y.head"))).where(order & near)
    cell = F.xxhash64("x.turn", "x.head", "x.depth", "x.node", "y.depth", "y.node").alias("cell")
    same = F.expr("x.depth = y.depth and x.node = y.node")
    side = lambda n, s: F.struct(*(F.col(f"{n}.{c}").alias(c) for c in key), F.lit(s).alias("side"))
    sides = pairs.select(cell, F.explode(F.when(same, F.array(side("x", 0))).otherwise(F.array(side("x", 0), side("y", 1)))).alias("s")).select("cell", "s.*")
    return done.join(sides, key).select("cell", "side", "turn", "v")


def near_links(distinct: DataFrame, work: Workspace) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (f long) within the budget."""
    f = F.col("f")
    turns = F.array(*(F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(_turned(f, by), 64 - width).alias("head"), _turned(f, by).alias("v")) for k, (by, width) in enumerate(zip(TURNS, WIDTHS, strict=True))))
    rows = distinct.select(F.explode(turns).alias("r")).select("r.*")
    # at most 5 * 2**13 nodes
    big = work.save(rows.groupBy("turn", "head").agg(F.count("*").alias("k")).where(F.col("k") > NODE_MOST).drop("k"), "large-nodes")
    small = rows
    cells = None
    if not big.isEmpty():
        small = rows.join(F.broadcast(big), ["turn", "head"], "left_anti")
        cells = _cut(rows.join(F.broadcast(big), ["turn", "head"], "left_semi").select("turn", "head", "v"), work)
    small = small.select(F.xxhash64("turn", "head").alias("cell"), F.lit(0).alias("side"), "turn", "v")
    cells = small if cells is None else small.unionByName(cells)
    return cells.repartition("cell").sortWithinPartitions("cell", "side", "v").mapInArrow(_walked, "a long, b long")


def near_groups(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of its group) for each row of ``docs`` (doc_id, text)."""
    work = work or Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_printed, "doc_id long, f long")
    rows = work.save(rows, "prints")
    distinct = work.save(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    stars = components(near_links(distinct.select("f"), work), work, "stars")
    linked = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "f")
    linked = linked.join(distinct.select("f", "least"), "f")
    linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("f", "component_id")
    alone = distinct.where("copies > 1").join(linked, "f", "left_anti").select("f", F.col("least").alias("component_id"))
    told = work.save(linked.unionByName(alone), "told")
    return rows.join(told, "f", "left").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
