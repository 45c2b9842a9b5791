"""N-gram Jaccard join: size-aware heavy-light set join (after Deng, Tao and Li, 2018).

Two texts link when the Jaccard similarity of their five-word shingle sets is 0.75 or more.

* Equal sets are one node; its name is a hash of the set.
* Small sets (below a size chosen by cost) are joined by enumerating fixed-size subsets: for
  every overlap c that a pair of small sizes needs, a set emits its c-subsets. Two sets that
  share one link exactly when their sizes allow an overlap of c to be enough, and that
  is monotone in the sizes, so linking each subset's members to its smallest member
  keeps all components without naming all pairs.
* Large sets scan inverted lists. Each set enters only the lists of its prefix, under a global
  order that puts shingles of many documents last, rare ones before common ones: a linked pair shares at least one.
  Short lists count what each pair shares and keep pairs that share enough. Long lists are not enumerated: their members are chained by size,
  and chains break where sizes can't link. Lists of shingles known to be in many documents are cut into parts by their
  length. ``linkage`` then verifies all pairs of what hangs together inside tasks.
  So components and numbers of links are exact, with no cap on lists or partners.

Nulls and texts without words have an empty set and link with nothing. A null id is kept as a row
of its own. Repeated rows stay repeated, and link with one another. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, expm1

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import least_members
from .linkage import link_sets, names_of, same_text
from .textblocks import blocks, mix, returns_memory, shingle_sets, signature
from .workspace import Classes, Workspace, unused

#: At most this many frequent shingles are known to all tasks (8 bytes each); the count from which one is frequent rises with the corpus.
FREQUENT_LIMIT = 1 << 20
FREQUENT_FROM = 32
#: Shingles are counted in parts of a task of about so many of them (8 bytes each, some copies), however short its batches are.
COUNTED = 1 << 21
#: Sizes among which the boundary between small and large sets is chosen.
BOUNDARY_MAX = 24
#: Lists of frequent shingles are cut into parts of about so many sets.
LIST_ROWS = 4096
#: Of lists of up to LONG sets all pairs are looked at; longer ones are chained.
LONG = 64
#: A task works on so many entries of lists at a time (some 200 bytes each).
CHUNK = 1 << 18


def overlap(n: int, m: int) -> int:
    """The least intersection size with which sets of n and m elements link: 175 c >= 75 (n + m)."""
    return -(-3 * (n + m) // 7)


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The overlaps that a small set of n elements may need with another small set."""
    return sorted({overlap(n, m) for m in range(-(-3 * n // 4), min(4 * n // 3, boundary - 1) + 1) if m and overlap(n, m) <= min(n, m)})


def boundary_by_cost(sizes: dict[int, int], list_length: float) -> int:
    """The boundary of least work, from the counts of the small sizes and the mean inverted list."""

    def cost(b: int) -> float:
        subsets = sum(k * comb(n, c) for n, k in sizes.items() if n < b for c in subset_sizes(n, b))
        scans = sum(k * ((n - (3 * n + 3) // 4 + 1) * (1 + list_length) + n) for n, k in sizes.items() if 4 * n >= 3 * b)
        return subsets + scans

    return min(range(1, BOUNDARY_MAX + 1), key=cost)


@returns_memory
def _sets_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: id, text hash, set size, set name. kind 1: shingle, its documents in a part of the task where two or more. kind 2: one for each such part."""

    def counted(values: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(values)
        values.clear()
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(at, len(keys)))
        at, times = at[times > 1], times[times > 1]
        kinds = np.append(np.ones(len(at), np.int32), np.int32(2))
        return pa.record_batch([pa.array(kinds), pa.array(np.append(keys[at].view(np.int64), 0)), pa.nulls(len(kinds), pa.int64()), pa.array(np.append(times, 1).astype(np.int64)), pa.nulls(len(kinds), pa.int64())], _META)

    held, total, seen = [], 0, set()
    for batch in batches:
        sizes, names = [], []
        for block in blocks(batch["text"]):
            for s in shingle_sets(block):
                sizes.append(len(s))
                names.append(signature(s) if len(s) else None)
                if len(s) and names[-1] not in seen:
                    seen.add(names[-1])
                    held.append(s)
                    total += len(s) + 16  # the name and the array itself
            if total >= COUNTED:
                yield counted(held)
                total, seen = 0, set()
        yield pa.record_batch([pa.array(np.zeros(len(sizes), np.int32)), batch["doc_id"], batch["same"], pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], _META)
    if held:
        yield counted(held)


def frequent_from(parts: int) -> int:
    """What is counted of a shingle that FREQUENT_FROM documents have, dealt over so many parts: those that are alone in their part are not."""
    each = FREQUENT_FROM / max(1, parts)
    return max(2, round(FREQUENT_FROM * -expm1(-each)))


_META = ["kind", "id", "same", "n", "name"]


class _Order:
    """The global order: shingles outside the frequent ones first, by hash, then those by their count and hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        at = np.argsort(frequent.view(np.uint64), kind="stable")
        self.frequent, self.counts = frequent.view(np.uint64)[at], counts[at]
        self.hint = np.zeros(1 << 22, bool)
        self.hint[(self.frequent >> np.uint64(42)).astype(np.int64)] = True

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in this order, and the counts of its frequent shingles, which are the last of it."""
        late = self.hint[(s >> np.uint64(42)).astype(np.int64)]
        if not late.any():
            return s, self.counts[:0]
        at = np.flatnonzero(late)
        k = np.minimum(np.searchsorted(self.frequent, s[at]), len(self.frequent) - 1)
        late[at] = self.frequent[k] == s[at]
        counts = self.counts[k[self.frequent[k] == s[at]]]
        order = np.argsort(counts, kind="stable")
        return np.concatenate([s[~late], s[late][order]]), counts[order]


def _prefixes(order, boundary: int):
    """Entries (key, name, at) of sets that may link with a large one; at: the set's size and the key's place in it. ``home``: the key of a list that is cut into parts, each under a key of its own."""
    least = -(-3 * boundary // 4)

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for block in blocks(batch["text"]):
                keys, names, ats, homes, cut = [], [], [], [], []
                for s in shingle_sets(block):
                    n = len(s)
                    if n < max(least, 1):
                        continue
                    name = signature(s)
                    if name in seen:
                        continue
                    seen.add(name)
                    s, counts = order.value.sort(s)
                    p = prefix(n)
                    parts = np.zeros(p, np.uint64)
                    light = min(p, n - len(counts))
                    parts[light:] = counts[: p - light] // LIST_ROWS
                    key = s[:p]
                    if parts.any():
                        part = np.uint64(name & 0xFFFFFFFFFFFFFFFF) % (parts + np.uint64(1)) + np.uint64(1)
                        key = np.where(parts > 0, mix(key + part * np.uint64(0x9E3779B97F4A7C15)), key)
                    keys.append(key)
                    homes.append(s[:p])
                    names.append(np.full(p, name, np.int64))
                    ats.append((n << 32) + np.arange(p))
                    cut.append(parts > 0)
                if keys:
                    home = pa.array(np.concatenate(homes).view(np.int64), mask=~np.concatenate(cut))
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(ats)), home], ["key", "name", "at", "home"])

    return run


_ENTRIES = "key long, name long, at long, home long"


def prefix(n):
    """How many of a set's n elements, in the global order, enter lists: two sets that link share one of these."""
    return n - (3 * n + 3) // 4 + 1


def _need(n, m):
    return -(-3 * (n + m) // 7)


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes of bands that are not neighbours can't link."""
    return np.floor(np.log(n) / np.log(4 / 3)).astype(np.int32)


#: What lists give. PAIR: a, b, their sizes n and m, whether the key is within the places where two such sets must share one (k).
#: LOOSE: k entries of a that stand in long lists. CHAIN: a and b are in one list. PART: in list a, the first of band n in a part is b.
PAIR, LOOSE, CHAIN, PART = range(4)
_LISTED = "kind int, a long, b long, n int, m int, k int"


def _rows(kind: int, a, b=None, n=None, m=None, k=None) -> pa.RecordBatch:
    size = len(a)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x).cast(t)
    return pa.record_batch([pa.array(np.full(size, kind, np.int32)), column(a, pa.int64()), column(b, pa.int64()), column(n, pa.int32()), column(m, pa.int32()), column(k, pa.int32())], ["kind", "a", "b", "n", "m", "k"])


def _short(key, name, n, pos) -> Iterator[pa.RecordBatch]:
    """All pairs of lists of LONG entries at most, sorted by key."""
    for d in range(1, LONG):
        x = np.flatnonzero(key[d:] == key[:-d])
        if not len(x):
            return
        x = x[(4 * n[x] >= 3 * n[x + d]) & (4 * n[x + d] >= 3 * n[x])]
        y = x + d
        need = _need(n[x], n[y])
        meet = (pos[x] <= n[x] - need) & (pos[y] <= n[y] - need)
        swap = name[x] > name[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        for at in range(0, len(x), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield _rows(PAIR, name[x[part]], name[y[part]], n[x[part]], n[y[part]], meet[part])


def _long(key, name, n, pos) -> tuple[np.ndarray, np.ndarray]:
    """Chains of whole lists, whatever their length.

    A key at a place over n - need(n, n) can only be the first that a set shares with a smaller one, of a size up to a bound. Sets with earlier places are
    chained by size; the others follow the largest of these that their bound allows, since smaller ones that they may link to hang together with it.
    """
    hub = pos <= n - _need(n, n)
    v = np.where(hub, n, np.minimum(n, 7 * (n - pos) // 3 - n))
    order = np.lexsort((~hub, v, key))
    key, name, n, hub = key[order], name[order], n[order], hub[order]
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(hub, np.arange(len(key)), -1))[:-1]])
    at = np.flatnonzero(before >= 0)
    to = before[at]
    ok = (key[at] == key[to]) & (4 * n[to] >= 3 * n[at])
    return name[at[ok]], name[to[ok]]


def _parts(home, key, name, n) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Chains of parts of lists by size, and the first of each band."""
    order = np.lexsort((name, n, key))
    home, key, name, n = home[order], key[order], name[order], n[order]
    follows = (key[1:] == key[:-1]) & (4 * n[:-1] >= 3 * n[1:])
    band = _band(n)
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])])
    return name[1:][follows], name[:-1][follows], _rows(PART, home[first], name[first], band[first])


@returns_memory
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_LISTED rows of entries sorted by key."""

    def work(key, name, at, home, cut) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((name, key))
        key, name, at, home, cut = (x[order] for x in (key, name, at, home, cut))
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name, at, home, cut = (x[once] for x in (key, name, at, home, cut))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        size = np.repeat(size, size)
        n, pos = at >> 32, at & 0xFFFFFFFF
        short = ~cut & (size > 1) & (size <= LONG)
        yield from _short(key[short], name[short], n[short], pos[short])
        long = ~cut & (size > LONG)
        loose, k = np.unique(name[long | cut], return_counts=True)
        yield _rows(LOOSE, loose, k=k)
        a, b = _long(key[long], name[long], n[long], pos[long]) if long.any() else (name[:0], name[:0])
        if cut.any():
            more, others, parts = _parts(home[cut], key[cut], name[cut], n[cut])
            a, b = np.concatenate([a, more]), np.concatenate([b, others])
            yield parts
        if len(a):
            v, least = least_members(a, b)
            yield _rows(CHAIN, v[v != least], least[v != least])

    held, rows, over = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch["home"].is_valid()
        columns = [batch[c].to_numpy() for c in ("key", "name", "at")]
        held.append([*columns, pc.coalesce(batch["home"], batch["key"]).to_numpy(), cut.to_numpy(zero_copy_only=False)])
        rows += len(columns[0])
        if rows >= CHUNK:
            key, name, at, home, cut = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            if last == 0:  # a list of over CHUNK entries is cut like those known to be long
                over = key[-1]
                last = len(key)
            cut = cut | (key == over) if over is not None else cut
            yield from work(key[:last], name[:last], at[:last], home[:last], cut[:last])
            held, rows = [[x[last:] for x in (key, name, at, home, cut)]], len(key) - last
    if rows:
        key, name, at, home, cut = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from work(key, name, at, home, cut | (key == over) if over is not None else cut)


def _list_links(entries: DataFrame, work: Workspace) -> DataFrame:
    """Candidates (a, b): pairs of short lists that share enough keys, and chains of long lists.

    Two sets share at most as many elements as their prefixes do, plus what follows the prefix that ends first. Keys of short lists are counted for each
    pair; of those of long lists, a pair may share as many as each of its sets has.
    """
    found = work.save(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_listed, _LISTED), "lists")
    work.tidy()
    pairs = found.where(f"kind = {PAIR}").groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"), F.max("k").alias("meet")).where("meet = 1").drop("meet")
    loose = work.save(found.where(f"kind = {LOOSE}").groupBy(F.col("a").alias("name")).agg(F.sum("k").alias("loose")), "loose")
    n, m = F.col("n"), F.col("m")
    least = F.ceil(3 * (n + m) / F.lit(7)) - (F.ceil(3 * F.greatest(n, m) / F.lit(4)) - 1)
    for c in "ab":
        pairs = pairs.join(loose.select(F.col("name").alias(c), F.col("loose").alias(f"loose_{c}")), c, "left")
    pairs = pairs.where(F.col("k") + F.least(F.coalesce("loose_a", F.lit(0)), F.coalesce("loose_b", F.lit(0))) >= least).select("a", "b")
    # the parts of a list hang together by band and by neighbouring bands
    order = Window.partitionBy("a").orderBy("n", "b")
    parts = found.where(f"kind = {PART}").select("a", "b", "n").withColumns({"other": F.lag("b").over(order), "below": F.lag("n").over(order)})
    parts = parts.where("other <> b and n - below <= 1").select(F.col("b").alias("a"), F.col("other").alias("b"))
    return work.save(pairs, "pairs").unionByName(found.where(f"kind = {CHAIN}").select("a", "b")).unionByName(parts)


def _subsets(boundary: int):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                keys, names, sizes, overlaps = [], [], [], []
                for s in shingle_sets(block):
                    if not 0 < len(s) < boundary:
                        continue
                    name, values = signature(s), mix(s).view(np.int64).tolist()
                    for c in subset_sizes(len(s), boundary):
                        for chosen in combinations(values, c):
                            keys.append((sum(chosen) + c * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF)
                            names.append(name)
                            sizes.append(len(s))
                            overlaps.append(c)
                if keys:
                    yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(overlaps, pa.int32())], ["key", "name", "n", "c"])

    return run


def _grouped(docs: DataFrame, work: Workspace, counted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, same, n, name of the set), the names, and name, component, links (0 if not ``counted``) of sets that link to others."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = work.save(docs.withColumn("same", same_text(F.col("text"))).mapInArrow(_sets_and_counts, "kind int, id long, same long, n long, name long"), "sets-and-counts")
    meta = both.where("kind = 0").select(F.col("id").alias("doc_id"), "same", "n", "name")

    summed = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
    told = both.agg(summed(0, "all"), summed(1, "shared"), summed(2, "parts")).first()
    counts = both.where("kind = 1").groupBy(F.col("id").alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= frequent_from(told.parts))
    counts = work.save(counts, "frequent")
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()  # at most 64 rows
    lowest, total = 63, 0
    for row in steps:
        if total + row.k > FREQUENT_LIMIT:
            break
        lowest, total = row.step, total + row.k
    frequent = counts.where(F.floor(F.log2("n")) >= lowest).toArrow()  # at most FREQUENT_LIMIT
    sizes = meta.where(F.col("n").between(1, 2 * BOUNDARY_MAX)).groupBy("n").count().collect()  # at most 2 * BOUNDARY_MAX rows
    boundary = boundary_by_cost({r.n: r["count"] for r in sizes}, told.shared / max(1, told.all - told.shared))

    order = spark.sparkContext.broadcast(_Order(frequent["key"].to_numpy(), frequent["n"].to_numpy()))
    names = names_of(meta, work)

    def lists(some: DataFrame) -> DataFrame:
        large = some.select("doc_id", "text").mapInArrow(_prefixes(order, boundary), _ENTRIES).select(F.coalesce("home", "key").alias("key"), "name")
        return large.unionByName(some.mapInArrow(_subsets(boundary), _SUBSETS).select("key", "name"))

    candidates = _list_links(docs.mapInArrow(_prefixes(order, boundary), _ENTRIES), work).unionByName(work.save(_small_links(docs, boundary), "small-links"))
    work.tidy()
    found = link_sets(docs, names, candidates, lists, work, counted)
    work.drop("lists", "pairs", "loose", "small-links", "frequent", "candidates")
    return meta, names, found


def jaccard_components(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of its group), n_links (other rows that it links to) for each row of ``docs`` (doc_id, text)."""
    work = work or Workspace(docs.sparkSession, "jaccard")
    meta, names, found = _grouped(docs, work)
    linked = found.join(names.select("name", "least_id", "copies"), "name")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(least, "component").select("name", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = names.where("copies > 1").join(found, "name", "left_anti").select("name", F.col("least_id").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    told = work.save(linked.unionByName(alone), "told")
    return meta.join(told, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one of least id (nulls last), then of least text hash.

    Texts without words link with nothing and stay, repeated rows of one once. All columns are kept, whatever their names.
    Only rows that may repeat another one, or that their key alone does not tell to stay or go, are shuffled.
    """
    work = work or Workspace(docs.sparkSession, "jaccard")
    meta, names, found = _grouped(docs, work, counted=False)
    chosen = found.join(names, "name").groupBy("component").agg(F.min("first").alias("first"))
    chosen = chosen.select("first.*").unionByName(names.join(found, "name", "left_anti").select("first.*"))
    chosen = chosen.select("doc_id", "same", "times")
    rows = meta.groupBy("name", "doc_id", "same").agg(F.count("*").alias("times"))
    wordless = rows.where("name is null").select("doc_id", "same", "times")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "same")
    chosen = work.save(chosen.unionByName(wordless).withColumn("key", key), "chosen")
    # 0: stays, 1: goes, 2: one of its rows stays
    kinds = rows.select(key.alias("key")).join(chosen.select("key", "times"), "key", "left").select("key", F.when(F.col("times").isNull(), 1).when(F.col("times") > 1, 2).otherwise(0).alias("kind"))
    classes = Classes(work.save(kinds, "kinds"), 3)
    work.drop("sets-and-counts", "names", "linked", "linked-large", "large-clusters")
    own, kind = unused(docs.columns, "_row_key"), unused(docs.columns, "_row_kind")
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").cast("long").isNull(), same_text(F.col("text"))))
    told = classes.told(marked, F.col(own), kind)
    doubtful = told.where(~F.col(kind).isin(0, 1)).join(chosen.select(F.col("key").alias(own)), own, "left_semi").dropDuplicates([own])
    return told.where(F.col(kind) == 0).select(*docs.columns).unionByName(doubtful.select(*docs.columns))


_SUBSETS = "key long, name long, n int, c int"


def _small_links(docs: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) between small sets: each subset's members with its smallest member."""
    rows = docs.mapInArrow(_subsets(boundary), _SUBSETS).distinct()
    least = rows.groupBy("key", "c").agg(F.min(F.struct("n", "name")).alias("least"))
    return (
        rows.join(least, ["key", "c"]).where("3 * (n + least.n) <= 7 * c and name <> least.name")
        .select(F.least("name", "least.name").alias("a"), F.greatest("name", "least.name").alias("b")).distinct()
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
a AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
e AS MATERIALIZED (SELECT * FROM a WHERE g IN (SELECT g FROM a GROUP BY g HAVING count(*) > 1)),
l AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
), d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(r.c) AS BIGINT) AS component_id, CAST(coalesce(any_value(d.k), 0) AS BIGINT) AS n_links
FROM n JOIN r USING (doc_id) LEFT JOIN d ON d.a = n.doc_id GROUP BY n.doc_id, n.n
"""
