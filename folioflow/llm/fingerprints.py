"""Document fingerprints: MinHash over five-word shingles.

PERMUTATIONS functions of a universal family (a h + b modulo 2**64, a odd) are applied to all shingle hashes of a
block at once, and the least value of each text is kept. A fingerprint is one byte of each minimum; the share of equal bytes,
corrected for chance, estimates the Jaccard similarity. For near duplicates, bands of whole minima are
joined in Spark, and all pairs of what shares bands are verified by the Jaccard similarity of their
shingle sets, inside tasks.

Neighbours by descending id are found in one pass: rows are dealt by ranges of the ids, and the first row of each range goes to the range before
too, so that each task streams its sorted rows. Equal ids are ordered by text hash. A null id comes last. A null text
is empty; texts without words have equal fingerprints and no class but their own. Repeated rows stay repeated, other columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import link_sets, names_of, same_text
from .textblocks import SHINGLE, blocks, mix, returns_memory, shingle_sets, shingles, signature
from .workspace import Lookup, Workspace

PERMUTATIONS = 256
#: BANDS bands of BAND_ROWS minima: at a similarity of 0.75 a pair shares none with a chance of 0.4 %, at 0.9 of 2e-6.
BANDS, BAND_ROWS = 10, 3
_BLOCK = 512 << 10
PIECE_ROWS = 500
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def _described(texts: pa.Array, permutations: int) -> tuple[np.ndarray, list[int | None], list[int]]:
    """For each text a row of minima, the name of its shingle set (none without words) and the set's size."""
    out = np.full((len(texts), permutations), np.iinfo(np.uint64).max, np.uint64)
    names: list[int | None] = []
    sizes: list[int] = []
    for block in blocks(texts, _BLOCK):
        starts, ends, before = block.words()
        values, bounds = shingles(block.hashes(starts, ends), before)
        for i in range(len(block)):
            s = np.unique(values[bounds[i] : bounds[i + 1]])
            names.append(signature(s) if len(s) else None)
            sizes.append(len(s))
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            out[block.first + filled] = _least(values, bounds[filled], permutations)
    return out, names, sizes


def _least(values: np.ndarray, cuts: np.ndarray, permutations: int) -> np.ndarray:
    v, rows = np.empty_like(values), np.empty((permutations, len(cuts)), np.uint64)
    for k in range(permutations):
        np.multiply(values, _A[k], out=v)
        v += _B[k]
        np.minimum.reduceat(v, cuts, out=rows[k])
    return rows.T


def minima(texts: pa.Array, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of minima for each text."""
    out = np.full((len(texts), permutations), np.iinfo(np.uint64).max, np.uint64)
    for block in blocks(texts, _BLOCK):
        starts, ends, before = block.words()
        values, bounds = shingles(block.hashes(starts, ends), before)
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            out[block.first + filled] = _least(values, bounds[filled], permutations)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows PIECE_ROWS at a time: a row takes some 10 kB while it is worked on, and batches may have 10,000 of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def digests(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum."""
    return (mix(least) & np.uint64(0xFF)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity, row by row."""
    equal = (a == b).mean(axis=1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


_FOUND = "doc_id long, n_chars long, sha binary, own binary, edited binary, near_edited double, near_next double, name long, class_id long, n_links long"


def _compared(ids: list, texts: list[str], own: np.ndarray, nexts: list[str], next_own: np.ndarray, names: list, classes: list) -> pa.RecordBatch:
    edited = []
    for x, y in zip(texts, nexts, strict=True):
        m = len(x) // 3
        edited.append(x[: len(x) - m] + y[:m])
    sketch = digests(minima(pa.array(edited, pa.large_string())))
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()),
        pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(likeness(own, sketch)), pa.array(likeness(own, next_own)), pa.array(names, pa.int64()),
        pa.array([c and c[0] for c in classes], pa.int64()), pa.array([c and c[1] for c in classes], pa.int64()),
    ]
    return pa.record_batch(columns, [x.split()[0] for x in _FOUND.split(", ")])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The rows with a text, and (class_id, n_links) of each that follows a row without text of its id and text hash, else None."""
    held = None
    for batch in _pieces(batches):
        if "class_id" not in batch.schema.names:
            yield batch, [None] * len(batch)
            continue
        worded, found = batch["text"].is_valid(), []
        for text, *key, class_id, n_links in zip(worded.to_pylist(), *(batch[c].to_pylist() for c in ("doc_id", "same", "class_id", "n_links")), strict=True):
            if not text:
                held = key, (class_id, n_links)
            else:
                found.append(held[1] if held is not None and held[0] == key else None)
        if found:
            yield batch.filter(worded), found


@returns_memory
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the one after it in its range. The last row of a range is a copy of the next range's first."""
    held = None
    for batch, classes in _classed(batches):
        texts, ids, ranges, copies = (batch[c].to_pylist() for c in ("text", "doc_id", "range", "copy"))
        least, names, _ = _described(batch["text"], PERMUTATIONS)
        own = digests(least)
        if held is not None:
            texts, ids, ranges, copies, own, names, classes = [held[0], *texts], [held[1], *ids], [held[2], *ranges], [held[3], *copies], np.concatenate([held[4], own]), [held[5], *names], [held[6], *classes]
        at = np.array([i for i in range(len(ids) - 1) if not copies[i] and ranges[i] == ranges[i + 1]], np.int64)
        if len(at):
            yield _compared([ids[i] for i in at], [texts[i] for i in at], own[at], [texts[i + 1] for i in at], own[at + 1], [names[i] for i in at], [classes[i] for i in at])
        held = (texts[-1], ids[-1], ranges[-1], copies[-1], own[-1:], names[-1], classes[-1])


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with their ``range`` by descending key; the first of each range is also a ``copy`` in the range before. Rows without text go where those of their key go."""
    firsts = rows.where("text is not null").select("key").repartitionByRange(parts, F.col("key").desc()).groupBy(F.spark_partition_id()).agg(F.max("key").alias("key")).collect()  # ``parts`` rows
    firsts = sorted(((r.key.has, r.key.id, r.key.same) for r in firsts), reverse=True)
    if not firsts:
        return rows.select(*rows.columns, F.lit(0).alias("range"), F.lit(False).alias("copy"))
    kind = "array<struct<has:boolean,id:bigint,same:bigint>>"
    listed = lambda x: F.from_json(F.lit(json.dumps([{"has": h, "id": i, "same": s} for h, i, s in x])), kind)
    wide = int(len(firsts) ** 0.5) + 1
    not_after = lambda x: F.size(F.filter(x, lambda b: b >= F.col("key")))
    coarse = not_after(listed(firsts[::wide])) - 1  # a search in two steps
    marked = rows.withColumn("coarse", coarse).withColumn("near", F.slice(listed(firsts), F.col("coarse") * wide + 1, F.lit(wide)))
    marked = marked.withColumn("range", F.col("coarse") * wide + not_after(F.col("near")) - 1)
    first = (F.element_at(listed(firsts), F.col("range") + 1) == F.col("key")) & F.col("text").isNotNull()
    here = F.struct(F.col("range"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(firsts))).alias("range"), F.lit(True).alias("copy"))
    return marked.select(*rows.columns, F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("x")).select(*rows.columns, "x.range", "x.copy")


def fingerprint_neighbours(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, name (of the shingle set) of each row of ``docs`` (doc_id, text).

    With ``classes`` (doc_id, same, class_id, n_links) class_id and n_links too, null where there is none for the row's id and text hash: they come to the rows
    in the same shuffle, so that fingerprints are not shuffled after it. The edited text has its last third replaced by as many first characters of the next document by descending id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("same")))
    told = []
    if classes is not None:
        key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("same"))
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("class_id", "n_links")})
        rows, told = rows.unionByName(classes.select("doc_id", F.lit(None).cast("string").alias("text"), key.alias("key"), "class_id", "n_links")), [F.col("key.same").alias("same"), "class_id", "n_links"]
    ranged = _ranged(rows, parts).repartition(parts, "range").sortWithinPartitions("range", "copy", F.col("key").desc(), F.col("text").isNotNull())
    text = lambda c: F.lower(F.hex(c))
    return ranged.select("doc_id", "text", "range", "copy", *told).mapInArrow(_neighbours, _FOUND).select(
        "doc_id", "n_chars", text("sha").alias("edited_sha256"), text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), "near_edited", "near_next", "name", *(x for x in ("class_id", "n_links") if told)
    )


def _bands(shared):
    """key, name, n of the bands of each text that has words, all in one pass; with ``shared`` those only whose key may be one of it."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            least, names, sizes = _described(batch["text"], BANDS * BAND_ROWS)
            worded = np.array(sizes) > 0
            bands = mix(least[worded].reshape(-1, BANDS, BAND_ROWS) * _A[:BAND_ROWS]).sum(axis=2, dtype=np.uint64)
            keys = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).ravel()
            names = np.repeat(np.array([x for x in names if x is not None], np.int64), BANDS)
            sizes = np.repeat(np.array(sizes, np.int64)[worded], BANDS)
            if shared is not None:
                at = shared.value.has(keys)
                keys, names, sizes = keys[at], names[at], sizes[at]
            yield pa.record_batch([pa.array(keys), pa.array(names), pa.array(sizes)], ["key", "name", "n"])

    return run


@returns_memory
def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(s), signature(s) if len(s) else None) for block in blocks(batch["text"]) for s in shingle_sets(block)]
        yield pa.record_batch([batch["doc_id"], batch["same"], pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["doc_id", "same", "n", "name"])


def _classes(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, same, n, name), and class_id and n_links of names in a class of more than one row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = work.save(docs.withColumn("same", same_text(F.col("text"))).mapInArrow(_names, "doc_id long, same long, n long, name long"), "documents")
    names = names_of(meta, work)

    def entries(some: DataFrame, shared=None) -> DataFrame:
        return some.select("text").mapInArrow(_bands(shared), "key long, name long, n long")

    least = entries(docs).groupBy("key").agg(F.min("name").alias("b"), F.max("name").alias("last")).where("b <> last").select("key", "b")
    least = work.save(least, "shared-bands")
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(least.select("key")))
    candidates = work.save(entries(docs, shared).join(least, "key").where("name <> b").select(F.col("name").alias("a"), "b").distinct(), "chains")
    found = link_sets(docs, names, candidates, lambda some: entries(some, shared).select("key", "name"), work)
    linked = found.join(names.select("name", "least_id", "copies"), "name")
    classes = linked.groupBy("component").agg(F.min("least_id").alias("class_id"))
    linked = linked.join(classes, "component").select("name", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = names.where("copies > 1").join(found, "name", "left_anti").select("name", F.col("least_id").alias("class_id"), (F.col("copies") - 1).alias("n_links"))
    told = work.save(linked.unionByName(alone), "told")
    work.drop("shared-bands", "chains", "candidates")
    return meta, told


def _with_classes(rows: DataFrame, told: DataFrame) -> DataFrame:
    return rows.join(told, "name", "left").withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")}).drop("name")


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, class_id (least id of its class), n_links (other rows linked to it) for each row.

    Linked are texts that share bands, directly or by others, and whose verified Jaccard similarity is 0.75 or more.
    """
    meta, told = _classes(docs, work or Workspace(docs.sparkSession, "bands"))
    return _with_classes(meta, told).select("doc_id", "class_id", "n_links")


def fingerprints(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``fingerprint_neighbours`` with class_id and n_links of ``near_duplicates``."""
    work = work or Workspace(docs.sparkSession, "bands")
    meta, told = _classes(docs, work)
    # rows that repeat id and text have the same class
    classes = work.save(meta.join(told, "name").select("doc_id", "same", "class_id", "n_links").distinct(), "classes")
    return fingerprint_neighbours(docs, classes).drop("name").withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["SHINGLE", "fingerprint_neighbours", "fingerprints", "near_duplicates", "op3_fingerprints"]
