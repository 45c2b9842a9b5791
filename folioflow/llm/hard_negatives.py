"""Hard negatives by block matrix multiplication in two dimensions (after SUMMA, van de Geijn and Watts, 1997).

Vectors are whole numbers. Rows and anchors are sharded into blocks and their dimensions into chunks; each (row block, anchor block, chunk) is a task's matrix
product, a partial tile of scores. Partial tiles are shuffled and added as int64, and a tile's sum is reduced at once to the best few of each
window, so no score is ever a row of its own. This is done twice: within each label for the positives of the anchors, then over all rows for the
negatives, where the windows are those between the shares of each positive's score. The best of all tiles are ranked at the end.

A row without label or vector, or with a null or non-finite component, takes no part, and neither does one without an id, which could not be named. Repeated rows count once;
of different rows of one id the one of least (label, vector) stands for it. Ties go to the smaller id. A shorter vector counts as one with zeros at the end. An empty
table gives no rows, other columns are ignored. Scores are int64; a hundred times a score holds there for components up to 2**23 in 1,024 dimensions, larger ones wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textblocks import returns_memory
from .workspace import Workspace

#: Rows and anchors of a tile, and dimensions of a chunk.
TILE_ROWS, TILE_ANCHORS, CHUNK = 4096, 256, 32
_EXACT = 1 << 53


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, with zeros after the end of the shorter ones."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.int64)
    own = np.repeat(np.arange(len(size)), size)
    out[own, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
    return out


def product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The int64 product of two matrices of whole numbers, by floating point where that is exact."""
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if 0 <= bound < _EXACT:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def _narrow(tile: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    least, most = tile.min(initial=0), tile.max(initial=0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return tile.astype(kind)
    return tile


_PART = "tile long, width int, scores binary, anchors binary, ids binary, labels binary, own_labels binary, floors binary"


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, cut where one of them changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            x = batch[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[0][k][0] != part[k][0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


@returns_memory
def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, chunk, side and id: one partial tile of each chunk; ids, labels and the positives' scores go with chunk 0."""
    for group in _groups(batches, ("tile", "chunk")):
        group = group.combine_chunks()
        mine = group["is_anchor"].to_numpy()
        if not mine.any() or mine.all():
            continue
        part = group["part"].combine_chunks()
        sides = [part.filter(pa.array(x)) for x in (mine, ~mine)]
        width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in sides)
        tile = _narrow(product(*(_matrix(x, width) for x in sides)))
        first = group["chunk"][0].as_py() == 0
        ids, labels = group["vec_id"].to_numpy(), group["label"].to_numpy()
        floors = pa.Table.from_arrays([group["positives"].filter(pa.array(mine))], ["p"]).combine_chunks()["p"].combine_chunks() if first else None
        told = [ids[mine], ids[~mine], labels[~mine], labels[mine]] if first else [np.zeros(0, np.int64)] * 4
        flat = _matrix(floors, 5 + 1) if first else np.zeros(0, np.int64)
        if first:
            flat[:, 5] = np.diff(floors.offsets.to_numpy())
        yield pa.record_batch(
            [pa.array([group["tile"][0].as_py()]), pa.array([tile.dtype.itemsize], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (tile, *(np.asarray(t, np.int64) for t in told), flat))],
            ["tile", "width", "scores", "anchors", "ids", "labels", "own_labels", "floors"],
        )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sums of partial tiles sorted by tile: scores, anchors, ids, labels, the anchors' own labels and their positives' scores."""
    for group in _groups(batches, ("tile",)):
        total, told = 0, None
        for width, scores, *rest in zip(*(group[c].to_pylist() for c in ("width", "scores", "anchors", "ids", "labels", "own_labels", "floors")), strict=True):
            total = total + np.frombuffer(scores, f"i{width}").astype(np.int64)
            if rest[0]:
                told = [np.frombuffer(x, np.int64) for x in rest]
        anchors, ids, labels, own, floors = told
        yield total.reshape(len(anchors), len(ids)), anchors, ids, labels, own, floors.reshape(len(anchors), 6)


def _best(scores: np.ndarray) -> np.ndarray:
    """The order of each row's scores from the highest; of equal ones the first comes first."""
    return np.argsort(-scores, axis=1, kind="stable")


def _positives(most: int):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scores, anchors, ids, _, _, _ in _tiles(batches):
            order = _best(scores)[:, : most + 1]
            keep = ids[order] != anchors[:, None]
            keep &= np.cumsum(keep, axis=1) <= most
            a, k = np.nonzero(keep)
            at = order[a, k]
            yield pa.record_batch([pa.array(anchors[a]), pa.array(ids[at]), pa.array(scores[a, at])], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(most: int, low: int, high: int):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scores, anchors, ids, labels, own, floors in _tiles(batches):
            order = _best(scores)
            out = []
            for a in range(len(anchors)):
                other = order[a][labels[order[a]] != own[a]]
                s = scores[a, other]
                for p in np.unique(floors[a, : floors[a, 5]]).tolist():
                    first = int(np.searchsorted(-100 * s, -high * p, "left"))
                    k = first + np.flatnonzero(100 * s[first : first + most] >= low * p)
                    out.append(np.stack([np.full(len(k), anchors[a]), np.full(len(k), p), ids[other[k]], s[k]]))
            found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            yield pa.record_batch([pa.array(x) for x in found], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def whole_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (components times ``scale``, rounded down) of the rows that take part, one for each id."""
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(fit).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c)).alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _summed(rows: DataFrame, anchors: DataFrame, within: list[str], sizes: DataFrame, positives: bool) -> DataFrame:
    """Partial tiles, added up where they meet: rows of the frame are partial tiles sorted by tile.

    ``sizes``: for each value of ``within`` the number of row blocks, anchor blocks and chunks. Each row goes to all anchor blocks of its own row block, and each anchor to all row
    blocks, as chunks of its dimensions.
    """
    # a short vector has empty chunks at the end, so all partial tiles of a tile have one shape
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.slice("v", k * CHUNK + 1, CHUNK)))
    one = None if within else sizes.first()
    if one is None and not within:
        return rows.limit(0).selectExpr(*(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in _PART.split(", ")))
    on = lambda df: df.join(sizes, within) if within else df.withColumns({c: F.lit(one[c]) for c in sizes.columns})
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.array().cast("array<long>")
    key = [F.col(c).alias(f"own_{c}") for c in within]
    r = on(rows).select(*key, "vec_id", "label", "v", block("row_blocks", 3).alias("i"), each("anchor_blocks").alias("j"), "chunks", F.lit(False).alias("is_anchor"), none.alias("positives"))
    a = on(anchors).select(*key, "vec_id", "label", "v", block("anchor_blocks", 4).alias("j"), each("row_blocks").alias("i"), "chunks", F.lit(True).alias("is_anchor"), F.col("positives") if positives else none.alias("positives"))
    both = r.unionByName(a).select(F.xxhash64(*(f"own_{c}" for c in within), "i", "j").alias("tile"), "vec_id", "label", "is_anchor", "positives", part.alias("chunk", "part"))
    dealt = both.repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "is_anchor", "vec_id")
    return dealt.mapInArrow(_partial, _PART).repartition("tile").sortWithinPartitions("tile")


def _blocks_of(rows: DataFrame, anchors: DataFrame, within: list[str]) -> DataFrame:
    """row_blocks, anchor_blocks and chunks for each value of ``within``; no row where there are no anchors."""
    n = rows.groupBy(*within).agg(F.ceil(F.count("*") / TILE_ROWS).alias("row_blocks"), F.greatest(F.lit(1), F.ceil(F.max(F.size("v")) / CHUNK).cast("int")).alias("chunks"))
    m = anchors.groupBy(*within).agg(F.ceil(F.count("*") / TILE_ANCHORS).alias("anchor_blocks"))
    return n.withColumn("all", F.lit(0)).join(m.withColumn("all", F.lit(0)), [*within, "all"]).drop("all").where("anchor_blocks > 0")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, work: Workspace | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and v (whole numbers), ids once each; ``anchors`` some of these rows. An anchor's positives are its first other rows of the same label by score. The
    negatives of a positive are the first rows of other labels with scores from ``low`` to ``high`` hundredths of the positive's.
    """
    work = work or Workspace(rows.sparkSession, "negatives")
    sizes = work.save(_blocks_of(rows, anchors, ["label"]), "label-blocks")
    columns = "anchor_id long, positive_id long, positive_score long"
    found = _summed(rows, anchors, ["label"], sizes, False).mapInArrow(_positives(positives), columns)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = work.save(found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives).drop("at"), "positives")

    told = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("positive_score").alias("positives"))  # ``positives`` at most
    sizes = work.save(_blocks_of(rows, anchors, []), "blocks")
    columns = "anchor_id long, positive_score long, negative_id long, negative_score long"
    found = _summed(rows, anchors.join(told, "vec_id"), [], sizes, True).mapInArrow(_negatives(negatives, low, high), columns)
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    work = Workspace(spark, "negatives")
    rows = whole_rows(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    rows = work.save(rows, "rows")
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"), work=work)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""
