"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay whole. Small groups are summed into a fixed number of bundles by their hash, large
groups are items of their own, and only a group that is larger than a shard's even share of bytes, the law's dimension, is cut,
by the hash of its rows' numbers, since no balanced shard could hold it. The items are so few, whatever the corpus, that one
pass on the driver places them: largest first, each into the shard where the dot product of its sizes and
the shard's residual capacity is highest, of those that have room for its bytes. The pieces of a cut group fill one shard after the other, so it lies in as few as can hold it. Texts are never shuffled.

A null text counts as empty: no bytes, no tokens, one row, and a group with the empty texts. Repeated rows
and null ids are rows like others. A very long text is one item if it weighs enough. Groups of one size are placed in the order of their hashes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

BUNDLES = 2048
PIECE_SHARE = 1 / 512
#: Rows of a block in which slots are counted by one task.
BLOCK_ROWS = 50_000
#: Bytes weigh most: their balance is the law that the shards keep.
WEIGHTS = (4.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int, weights=WEIGHTS, cut: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (rows of sizes, one column per dimension). Items of one number in ``cut``, if it isn't -1, are pieces of one group."""
    share = items / np.maximum(items.sum(axis=0), 1)
    room = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    scale = np.asarray(weights)
    cut = np.full(len(items), -1) if cut is None else cut
    own = np.unique(cut, return_inverse=True)[1]
    whole = np.bincount(own, share[:, 0])[own]
    order = np.lexsort((np.arange(len(items)), -(share * scale).max(axis=1), cut, -np.where(cut < 0, 0, whole)))  # pieces of cut groups first, together
    filling: dict[int, int] = {}
    for i in order:
        # residual capacity seen by a vector of the item's own direction, of the shards that have bytes to spare for it
        fits = room[:, 0] >= share[i, 0]
        s = int(np.argmax(np.where(fits, room @ (scale * (share[i] + 1e-12)), -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        if cut[i] >= 0:
            last = filling.get(cut[i], s)
            s = filling[cut[i]] = last if room[last, 0] >= share[i, 0] / 2 else s
        out[i] = s
        room[s] -= share[i]
    return out


def assign_shards(docs: DataFrame, shards: int, work: Workspace | None = None) -> DataFrame:
    """doc_id, size (bytes and one), text_crc32, tokens, shard, slot for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
        F.size(F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")).cast("long").alias("tokens"),
    )
    rows = work.save(rows, "rows")
    group = ["g", "text_crc32", "size"]
    sums = [F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = rows.groupBy(*group).agg(*sums)
    total = rows.agg(*sums).first()
    if not total.r:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(F.col("s") / F.lit(float(total.s)), F.col("t") / F.lit(float(max(1, total.t))), F.col("r") / F.lit(float(total.r)))
    # at most 3 * BUNDLES groups have over 1 / BUNDLES of a dimension
    large = groups.withColumn("share", share).where(F.col("share") > 1 / BUNDLES).withColumn("pieces", F.when(F.col("s") * shards > F.lit(total.s), F.ceil(F.col("s") / F.lit(PIECE_SHARE * total.s))).otherwise(1).cast("int"))
    large = work.save(large.select(*group, "pieces", F.xxhash64("g", "text_crc32", "size").alias("own")), "large")
    rows = rows.join(F.broadcast(large), group, "left").withColumns({
        "item": F.when(F.col("pieces").isNull(), F.pmod("g", F.lit(BUNDLES))).otherwise(F.col("own")),
        "piece": F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("row"), F.col("pieces"))),
    })
    items = rows.groupBy("item", "piece").agg(*sums).collect()  # at most 4 * BUNDLES and the pieces, 2 / PIECE_SHARE
    items.sort(key=lambda x: (x.item, x.piece))
    pieces = collections.Counter(x.item for x in items if x.piece >= 0)
    numbers = {item: k for k, item in enumerate(sorted(i for i, n in pieces.items() if n > 1))}
    found = place(np.array([(x.s, x.t, x.r) for x in items], float), shards, cut=np.array([numbers.get(x.item, -1) if x.piece >= 0 else -1 for x in items]))
    placed = spark.createDataFrame([(x.item, x.piece, int(s), -(-x.r // BLOCK_ROWS)) for x, s in zip(items, found)], "item long, piece long, shard int, blocks long")
    rows = rows.withColumn("piece", F.col("piece").cast("long")).join(F.broadcast(placed), ["item", "piece"]).withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")))
    block = ["shard", "item", "piece", "block"]
    before = Window.partitionBy("shard").orderBy("item", "piece", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*block).agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("doc_id", "g", "row"))
    return rows.withColumn("inside", inside).join(offsets, block).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
