"""Exact links of shingle sets that meet in lists: candidate clusters first, then every pair of a cluster inside tasks.

A list is the sets that share a key. Sets of a list are candidates of one another; candidates are chained, not paired, so
the number of rows is that of the lists' entries. The chains' components are clusters, and linked sets are always in one cluster. The texts
of a cluster come to one cell, where matrix products count what any two of its sets share. A cluster too
large for one cell is cut into blocks, and each pair of blocks that meet in a list is a cell. So every link is
verified, none is written out as a row of its own, and no task holds more than two blocks.

Where the numbers of links are not wanted, a cell compares one set with all others until one group holds most of them; from then on only the sets
outside it are compared, with all that they are not joined to yet. Components are the same.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, least_members
from .textblocks import blocks, returns_memory, shingle_sets
from .workspace import Lookup, Workspace

#: A cell holds about so many sets and shingles, or two blocks of so many.
CELL_SETS, CELL_SHINGLES = 512, 1 << 18
#: Keys of over this share of a cell's sets are counted by matrix products, the others pair by pair.
HEAVY = 1 / 8
_SMALL_CELL = 64
#: Where links are not counted: sets that are compared with all others first, and how many outside of the largest group are compared one by one.
PIVOTS, OUTSIDE = 4, 48
#: Where links are not counted: how many times as much a cell holds, since it compares fewer pairs, and the share of sets outside of the largest groups from which blocks meet as if links were counted.
WIDER, MANY_OUTSIDE = 4, 1 / 4


def same_text(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of some sorted sets share."""
    k = len(sets)
    if k == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, n], [n, 0]])
    own = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(values := np.concatenate(sets), kind="stable")
    values, own = values[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(first, len(values)))
    each = np.repeat(times, times)
    out = np.zeros((k, k), np.float32)
    heavy = (each > 1) & ((k <= _SMALL_CELL) | (each >= HEAVY * k))
    columns = np.cumsum(np.concatenate([[0], np.diff(np.repeat(np.arange(len(times)), times)[heavy]) > 0])) if heavy.any() else np.zeros(0, np.int64)
    rows, wide = own[heavy], max(1, (1 << 21) // k)
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, wide):
        part = slice(*np.searchsorted(columns, [at, at + wide]))
        table = np.zeros((k, min(wide, int(columns[-1]) + 1 - at)), np.float32)
        table[rows[part], columns[part] - at] = 1
        out += table @ table.T
    light = (each > 1) & ~heavy
    if light.any():
        rows, lists = own[light], np.repeat(np.arange(len(times)), times)[light]
        codes = np.zeros(k * k, np.float32)
        for d in range(1, int(each[light].max())):
            pair = np.flatnonzero(lists[d:] == lists[:-d])
            if not len(pair):
                break
            at, times = np.unique(rows[pair] * k + rows[pair + d], return_counts=True)
            codes[at] += times
        out += (table := codes.reshape(k, k)) + table.T
    np.fill_diagonal(out, 0)
    return out.astype(np.int32)


def _linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return 175 * shared >= 75 * (n + m)


def joined_sets(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray | None:
    """The least place that each set reaches by links (between the two sides only, if there are two), or None if too many groups are left to compare one by one."""
    k = len(sets)
    n = np.array([len(s) for s in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    own, bounds = np.repeat(np.arange(k), n), np.concatenate([[0], np.cumsum(n)])
    apart = bool(side.any()) and not side.all()
    group, seen, mark = np.arange(k), np.zeros(k, bool), np.zeros(int(values.max(initial=-1)) + 1, bool)

    def compare(i: int) -> None:
        nonlocal group
        mine = values[bounds[i] : bounds[i + 1]]
        mark[mine] = True
        near = _linked(np.bincount(own[mark[values]], minlength=k), n, n[i])
        mark[mine] = False
        seen[i] = True
        if apart:
            near &= side != side[i]
        met = np.unique(group[near])
        if len(met):
            least = min(int(met[0]), int(group[i]))
            group = np.where(np.isin(group, met) | (group == group[i]), least, group)

    for _ in range(PIVOTS):
        sizes = np.bincount(group, minlength=k)
        rest = np.flatnonzero(~seen & (group != np.argmax(sizes))) if seen.any() else np.flatnonzero(~seen)
        if len(rest):
            compare(int(rest[0]))
    # any two groups that may still link have a set outside of the largest one
    rest = np.flatnonzero((group != np.argmax(np.bincount(group, minlength=k))) & ~seen)
    if len(rest) > OUTSIDE:
        return None
    for i in rest.tolist():
        compare(i)
    return group


def _cell(names: list[int], sets: list[np.ndarray], copies: list[int], sides: list[int], whole: bool, counted: bool = True) -> pa.RecordBatch | None:
    """name, component (least name that it reaches in the cell), links (documents of other sets that it links to, 0 if not ``counted``) of sets that link."""
    if len(sets) < 2:
        return None
    side, name = np.array(sides), np.array(names, np.int64)
    group = joined_sets(sets, side) if not counted and len(sets) > 2 else None
    if group is not None:
        other = np.flatnonzero(group != np.arange(len(sets)))
        a, b = group[other], other
    else:
        n = np.array([len(s) for s in sets])
        linked = _linked(shared_counts(sets), n[:, None], n[None, :])
        if side.any() and not side.all():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(np.triu(linked))
    if not len(a):
        return None
    vertices, least = least_members(name[a], name[b])
    links = dict(zip(names, (linked @ np.array(copies, np.int64)).tolist(), strict=True)) if counted else {}
    return pa.record_batch([pa.array(vertices), pa.array(least), pa.array([links.get(v, 0) for v in vertices.tolist()], pa.int64()), pa.array(np.full(len(vertices), whole))], ["name", "component", "links", "whole"])


def _cells(counted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and name. A name that comes again in a cell is one that a repeated row brought."""
    at, held, ready, rows = None, ([], [], [], []), [], 0
    for batch in batches:
        cells, names, copies, sides, whole = (batch[c].to_pylist() for c in ("cell", "name", "copies", "side", "whole"))
        for block in blocks(batch["text"]):
            for i, s in enumerate(shingle_sets(block), block.first):
                if at is not None and cells[i] != at[0]:
                    if (found := _cell(*held, at[1], counted)) is not None:
                        ready.append(found)
                        rows += len(found)
                    held = ([], [], [], [])
                    if rows > 10_000:
                        yield from ready
                        ready, rows = [], 0
                at = (cells[i], whole[i])
                if not held[0] or held[0][-1] != names[i]:
                    for x, v in zip(held, (names[i], s, copies[i], sides[i]), strict=True):
                        x.append(v)
    if at is not None and (found := _cell(*held, at[1], counted)) is not None:
        ready.append(found)
    yield from ready


def names_of(meta: DataFrame, work: Workspace) -> DataFrame:
    """For each set's name: n, its first document (least id, nulls last, then text hash; ``times``: equal rows), least id, and copies (all its documents)."""
    rows = meta.where("name is not null").groupBy("name", "doc_id", "same").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "times"))
    return work.save(rows.groupBy("name").agg(F.first("n").alias("n"), first.alias("first"), F.min("doc_id").alias("least_id"), F.sum("times").alias("copies")), "names")


def _texts(docs: DataFrame, wanted: DataFrame, work: Workspace) -> DataFrame:
    """``wanted`` (same, doc_id and others) with the text of its document; only texts that may be wanted are shuffled."""
    hashed = docs.select("doc_id", "text", same_text(F.col("text")).alias("same"))
    near, _ = Lookup(wanted.select("same")).split(hashed, F.col("same"))
    near, wanted = near.alias("d"), wanted.alias("w")
    return near.join(wanted, (F.col("d.same") == F.col("w.same")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.*", "d.text")


def _dealt(large: DataFrame, entries: DataFrame) -> DataFrame:
    """name, cluster, parts and block of the sets of ``large`` (with their cluster's number of blocks, parts): sets with one least key share a block unless they are too many."""
    least = entries.groupBy("name").agg(F.min("key").alias("least"))
    rows = large.select("name", "cluster", "parts", "n").join(least, "name", "left")
    groups = rows.groupBy("cluster", "least").agg(F.sum("n").alias("group_n"), F.count("*").alias("group_sets"))
    hot = (F.col("group_n") > CELL_SHINGLES // 2) | (F.col("group_sets") > CELL_SETS // 2)
    rows, groups = rows.alias("r"), groups.alias("g")
    rows = rows.join(groups, (F.col("r.cluster") == F.col("g.cluster")) & F.col("r.least").eqNullSafe(F.col("g.least")))
    return rows.select("name", "r.cluster", "parts", F.pmod(F.when(hot, F.xxhash64("name")).otherwise(F.xxhash64("r.least", F.lit(1))), "parts").alias("block"))


def _blocked(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """name, cell and side for each cell that a set is in; ``rows`` as _dealt gives them."""
    # pairs of blocks that meet in a list, or all pairs where that is fewer rows
    met = entries.join(rows, "name").select("cluster", "key", "block").distinct()
    cost = met.groupBy("cluster", "key").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.sum(F.col("k") * F.col("k")).alias("meetings"))
    told = rows.select("cluster", "parts").distinct().join(cost, "cluster", "left").withColumn("all", F.coalesce(F.col("meetings") >= F.col("parts") * F.col("parts"), F.lit(False)))
    every = told.where("all").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), "parts").select("cluster", "i", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)).alias("j"))
    few = met.join(told.where("not all").select("cluster"), "cluster")
    some = few.alias("x").join(few.alias("y"), ["cluster", "key"]).where("x.block < y.block").select("cluster", F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct()
    own = rows.join(told.where("not all").select("cluster"), "cluster").select("cluster", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
    pairs = every.unionByName(some).unionByName(own)
    sides = pairs.select("cluster", F.col("i").alias("block"), F.lit(0).alias("side"), "i", "j").unionByName(pairs.where("i < j").select("cluster", F.col("j").alias("block"), F.lit(1).alias("side"), "i", "j"))
    return rows.join(sides, ["cluster", "block"]).select("name", F.xxhash64("cluster", "i", "j").alias("cell"), "side")


def _rooted(parts: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component as a node too."""
    return parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())


def link_sets(docs: DataFrame, names: DataFrame, candidates: DataFrame, lists: Callable[[DataFrame], DataFrame], work: Workspace, counted: bool = True) -> DataFrame:
    """name, component (least name of its group) and links (documents of other sets linked to it) of all sets that link to another one.

    Without ``counted`` links are 0 and sets that are joined already are not compared.
    ``candidates``: chains (a, b) of names that join all sets of a list. ``lists``: (key, name) entries of all lists of some documents.
    """
    clusters = _rooted(components(candidates, work, "clusters")).toDF("name", "cluster")
    told = names.join(clusters, "name").select("name", "cluster", "n", "copies", "first.doc_id", "first.same")
    told = work.save(told, "candidates")
    work.tidy()
    sizes = told.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    most_sets, most_shingles = (CELL_SETS, CELL_SHINGLES) if counted else (WIDER * CELL_SETS, WIDER * CELL_SHINGLES)
    parts = F.greatest(F.ceil(F.col("sets") / most_sets), F.ceil(F.col("shingles") / most_shingles)).cast("long")
    large = work.save(sizes.where((F.col("sets") > most_sets) | (F.col("shingles") > most_shingles) & (F.col("sets") > 1)).select("cluster", parts.alias("parts")), "large-clusters")
    columns = ["cell", "name", "copies", "side", "whole", "text"]
    some = not large.isEmpty()
    small = told.join(large, "cluster", "left_anti") if some else told
    cells = _texts(docs, small, work).select(F.col("cluster").alias("cell"), "name", "copies", F.lit(0).alias("side"), F.lit(True).alias("whole"), "text")
    ordered = lambda df: df.select(*columns).repartition("cell").sortWithinPartitions("cell", "name").mapInArrow(returns_memory(functools.partial(_cells, counted)), "name long, component long, links long, whole boolean")
    if not some:
        return work.save(ordered(cells), "linked").drop("whole")
    rest = work.save(_texts(docs, told.join(large, "cluster"), work).dropDuplicates(["name"]), "large-texts")
    entries = work.save(lists(rest.select("doc_id", "text")).distinct(), "large-lists")
    dealt = work.save(_dealt(rest.drop("text"), entries), "dealt")
    work.tidy()
    texts = rest.select("name", "copies", "text")
    in_cells = lambda df: texts.join(df, "name").select("cell", "name", "copies", "side", F.lit(False).alias("whole"), "text")
    if counted:
        blocked = work.save(_blocked(dealt, entries), "blocked")
        work.tidy()
        found = work.save(ordered(cells.unionByName(in_cells(blocked))), "linked")
        parts = found.where("not whole")
    else:
        found = work.save(ordered(cells), "linked")
        parts = _joined_blocks(rest, dealt, entries, lambda df, name: work.save(ordered(in_cells(df)), name), work)
    parted = _rooted(components(parts.select(F.col("name").alias("a"), F.col("component").alias("b")), work, "parted")).toDF("name", "component")
    links = parts.groupBy("name").agg(F.sum("links").alias("links"))
    linked = work.save(parted.join(links, "name"), "linked-large")
    work.drop("large-texts", "large-lists", "dealt", "blocked", "own-blocks", "outside", "across")
    work.tidy()
    return found.where("whole").drop("whole").unionByName(linked)


def _joined_blocks(rest: DataFrame, dealt: DataFrame, entries: DataFrame, run: Callable[[DataFrame, str], DataFrame], work: Workspace) -> DataFrame:
    """Links enough for the components of large clusters, without comparing all pairs of their blocks.

    First each block is a cell, with one set of its cluster in all of them, so that a group whose sets are like that one hangs together at once. Any link that is still missing has an end
    outside of the largest group of its cluster: those sets then meet the blocks with which they share a list. Where they are many, all blocks that share a list meet.
    """
    pivots = rest.groupBy("cluster").agg(F.min("name").alias("name"), F.first("parts").alias("parts"))
    pivots = pivots.select("name", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    own = dealt.select("name", "cluster", "block").unionByName(pivots).select("name", F.xxhash64("cluster", "block").alias("cell"), F.lit(0).alias("side")).distinct()
    found = run(own, "own-blocks")
    stars = _rooted(components(found.select(F.col("name").alias("a"), F.col("component").alias("b")), work, "own-parted")).toDF("name", "group")
    told = dealt.join(stars, "name", "left").withColumn("group", F.coalesce("group", "name"))
    sizes = told.groupBy("cluster", "group").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("k", "group"))["group"].alias("largest"))
    outside = told.join(largest, "cluster").where("group <> largest").join(rest.select("name", "n"), "name").select("name", "cluster", "n")
    sizes = outside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / (WIDER * CELL_SETS)), F.ceil(F.sum("n") / (WIDER * CELL_SHINGLES))).alias("pieces"))
    outside = work.save(outside.join(sizes, "cluster").select("name", "cluster", F.pmod(F.xxhash64("name", F.lit(2)), "pieces").alias("piece")), "outside")
    work.tidy()
    n = outside.count()
    if not n:
        return found
    if n > MANY_OUTSIDE * dealt.count():
        return found.unionByName(run(_blocked(dealt, entries), "across"))
    mine = entries.join(outside, "name").select("cluster", "key", "piece").distinct()
    theirs = entries.join(dealt, "name").select("cluster", "key", "block").distinct()
    met = mine.join(theirs, ["cluster", "key"]).select("cluster", "piece", "block").distinct()
    cells = met.join(outside, ["cluster", "piece"]).select("name", "cluster", "piece", "block").unionByName(met.join(dealt.select("name", "cluster", "block"), ["cluster", "block"]).select("name", "cluster", "piece", "block"))
    cells = cells.select("name", F.xxhash64("cluster", "piece", "block", F.lit(3)).alias("cell"), F.lit(0).alias("side")).distinct()
    return found.unionByName(run(cells, "across"))


def chained(entries: DataFrame, compatible: Column) -> DataFrame:
    """Links of each entry (key, name, n) to the one before it in its list by size, where ``compatible`` holds of n and m (the one before)."""
    order = Window.partitionBy("key").orderBy("n", "name")
    rows = entries.withColumns({"other": F.lag("name").over(order), "m": F.lag("n").over(order)})
    return rows.where(compatible & (F.col("other") != F.col("name"))).select(F.col("name").alias("a"), F.col("other").alias("b"))
