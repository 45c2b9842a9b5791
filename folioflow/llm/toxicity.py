"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents are the positives; all other text is unlabelled. A linear model over the presence of words and word
beginnings is trained in numpy on the class-prior-corrected risk  prior * R+(P) + max(0, R-(U) - prior * R-(P)).

The features are chosen from document counts over all positives and unlabelled documents of the sample. That sample of
labelled rows and of unlabelled documents is bounded (POSITIVES, UNLABELLED), chosen by hash; all documents are scored, whole.

A null text is empty and gets the score of a text without features. A null or missing label is unlabelled. Without positives
every score is 0. A null id belongs to no label. Repeated rows stay repeated, other columns are never read,
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import _LOWER, Block, blocks, mix, powers, returns_memory
from .workspace import Workspace

#: Bounds of the training sample, in documents.
POSITIVES = 16_000
UNLABELLED = 32_000
CANDIDATES = 1 << 18
FEATURES = 2048
#: The least estimated part of a feature's documents that is toxic.
PURITY = 0.4
#: Bytes of a word's beginning that are features beside the whole word.
BEGINNINGS = (5, 6, 7, 8, 10)
EPOCHS = 40
FOLDS = 5

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features of a block, the text that each is of, and the number of words of each text."""
    starts, ends, before = block.words(_NOT_LETTER)
    text = np.repeat(np.arange(len(block)), np.diff(before))
    p, inverse = powers(len(block.data))
    total = np.zeros(len(block.data) + 1, np.uint64)
    np.cumsum(_LOWER[block.data] * p[: len(block.data)], out=total[1:])
    keys, texts = [], []
    for n in (0, *BEGINNINGS):
        use = slice(None) if n == 0 else ends - starts > n
        s, e = starts[use], ends[use] if n == 0 else starts[use] + n
        keys.append(mix((total[e] - total[s]) * inverse[s] + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
        texts.append(text[use])
    return np.concatenate(keys), np.concatenate(texts), np.diff(before)


def _distinct(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    if not len(keys):
        return keys, texts
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])])
    return keys[new], texts[new]


def _counted(known):
    """The documents of each feature in this batch; only of the features in ``known`` if that is given."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch["text"]):
                keys, texts, _ = _features(block)
                if known is not None:
                    _, at = known.value.find(keys)
                    keys, texts = keys[at], texts[at]
                found.append(_distinct(keys, texts)[0])
            keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    return run


class KeyIndex:
    """Finds the places of hashes in a sorted list."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.view(np.uint64))
        self.hint = np.zeros(1 << 22, bool)
        self.hint[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that are there, and which they are."""
        at = np.flatnonzero(self.hint[(keys >> np.uint64(42)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[k] == keys[at]
        return k[same], at[same]


def _rows(index):
    """The chosen features that each text has."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                keys, texts, n = _features(block)
                k, at = index.value.find(keys)
                k, t = _distinct(k.astype(np.int64), texts[at])
                bounds = np.searchsorted(t, np.arange(len(block) + 1)).astype(np.int32)
                yield pa.record_batch([*(batch[c].slice(block.first, len(block)) for c in ("positive", "unlabelled")), pa.ListArray.from_arrays(bounds, k.astype(np.int32)), pa.array(n.astype(np.int32))], ["positive", "unlabelled", "features", "n_words"])

    return run


@dataclass
class Model:
    """A linear model over features, the log of the length and a bias."""

    weights: np.ndarray
    bias: float = 0.0
    per_log_word: float = 0.0

    def logits(self, features: np.ndarray, rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[features], minlength=len(n_words)) + self.bias + self.per_log_word * np.log1p(n_words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slopes(z: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """What a step follows: the gradient of the non-negative risk by each logit.

    The risk is prior * mean(1 - s) of positives and max(0, mean(s) of unlabelled - prior * mean(s) of positives), s the sigmoid. Where the second part is
    below zero it is climbed instead, and nothing else.
    """
    s = _sigmoid(z)  # sigmoid loss, bounded: 1 - s for the positive class, s for the negative
    slope, n, m = s * (1 - s), is_p.sum(), (~is_p).sum()
    part = np.where(is_p, -prior * slope / n, slope / m)
    if s[~is_p].mean() < prior * s[is_p].mean():
        return -part
    return np.where(is_p, -prior * slope / n, 0.0) + part


def train(lists: list[np.ndarray], n_words: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, features: int, prior: float, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Model:
    """Minimises the non-negative risk by Adam steps over batches that hold positives and unlabelled rows in proportion. ``unlabelled`` are rows drawn from all documents, so a row may be both."""
    rng = np.random.default_rng(seed)
    size = np.array([len(x) for x in lists])
    flat, start = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(size)])
    model = Model(np.zeros(features), -1.0)
    p, u = np.flatnonzero(positive), np.flatnonzero(unlabelled)
    if not len(p) or not len(u):
        return model
    steps = max(1, len(u) // 1024)
    m, v, t = np.zeros(features + 2), np.zeros(features + 2), 0
    for _ in range(max(epochs, min(400, 2000 // steps))):
        for pp, uu in zip(np.array_split(rng.permutation(p), steps), np.array_split(rng.permutation(u), steps), strict=True):
            if not len(pp) or not len(uu):
                continue
            chosen = np.concatenate([pp, uu])
            rows = np.repeat(np.arange(len(chosen)), size[chosen])
            columns = flat[np.repeat(start[chosen] - np.concatenate([[0], np.cumsum(size[chosen])[:-1]]), size[chosen]) + np.arange(len(rows))]
            z = model.logits(columns, rows, n_words[chosen])
            is_p = np.arange(len(chosen)) < len(pp)
            g = slopes(z, is_p, prior)
            grad = np.concatenate([np.bincount(columns, g[rows], minlength=features) + decay * model.weights, [g.sum(), (g * np.log1p(n_words[chosen])).sum()]])
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            model.weights -= step[:-2]
            model.bias -= step[-2]
            model.per_log_word -= step[-1]
    return model


def _scored(index, model):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                keys, texts, n = _features(block)
                k, at = index.value.find(keys)
                k, t = _distinct(k.astype(np.int64), texts[at])
                score = _sigmoid(model.value.logits(k, t, n)) if model.value is not None else np.zeros(len(block))
                yield pa.record_batch([batch["row"].slice(block.first, len(block)), pa.array(score)], ["row", "score"])

    return run


@dataclass
class Classifier:
    keys: np.ndarray
    model: Model | None


def fit(docs: DataFrame, labels: DataFrame, work: Workspace | None = None) -> Classifier:
    """Trains on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), leaving out the held-out fold of both."""
    work = work or Workspace(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    told = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n_docs = docs.count()
    if not told.toxic or not n_docs:
        return Classifier(np.zeros(0, np.int64), None)
    prior = min(0.5, max(0.005, told.toxic / told.n))

    def sampled(df: DataFrame, n: int, bound: int, seed: int) -> DataFrame:
        """All rows if they are not over the bound, else the part that a hash picks, so many on average."""
        return df if n <= bound else df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < int(bound / n * (1 << 40)))

    toxic = sampled(labels.where("toxic = 1").select("doc_id").distinct(), told.toxic, POSITIVES, 1).withColumn("positive", F.lit(True))
    # both samples are bounded; only their texts leave the scan. Unlabelled rows are drawn from all documents, positives among them, as the prior is that of all
    marked = docs.join(F.broadcast(toxic), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 40)) < int(min(1.0, UNLABELLED / n_docs) * (1 << 40))
    sample = work.save(marked.withColumn("unlabelled", pick).where("positive or unlabelled").select("text", "positive", "unlabelled"), "sample")

    grouped = sample.where("positive").select("text").mapInArrow(_counted(None), "key long, n long").groupBy("key").agg(F.sum("n").alias("p"))
    sizes = sample.agg(F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0)).alias("p"), F.coalesce(F.sum(F.col("unlabelled").cast("int")), F.lit(0)).alias("u")).first()
    least = max(3, sizes.p // 250)  # of the positives that p is counted in, not of all labels
    common = grouped.where(F.col("p") >= least).orderBy(F.desc("p"), "key").limit(CANDIDATES).toPandas()
    index = docs.sparkSession.sparkContext.broadcast(KeyIndex(common["key"].to_numpy(np.int64)))
    other = sample.where("unlabelled").select("text").mapInArrow(_counted(index), "key long, n long").groupBy("key").agg(F.sum("n").alias("u")).toPandas()
    table = common.merge(other, on="key", how="left").fillna({"u": 0})
    a, b = (table.p + 0.5) / (sizes.p + 1), (table.u + 0.5) / (sizes.u + 1)
    # prior * a / b estimates the part of a feature's documents that is toxic; the best of those with enough of it stay
    table["gain"] = np.where(prior * a > PURITY * b, table.p * np.log(a / b), 0.0)
    keys = table[table.gain > 0].sort_values(["gain", "key"], ascending=[False, True]).head(FEATURES)["key"].to_numpy(np.int64)
    index = docs.sparkSession.sparkContext.broadcast(KeyIndex(keys))
    rows = sample.mapInArrow(_rows(index), "positive boolean, unlabelled boolean, features array<int>, n_words int").toArrow()
    lists = rows["features"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    offsets = offsets - offsets[0]
    model = train([values[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)], rows["n_words"].to_numpy(), rows["positive"].to_numpy(), rows["unlabelled"].to_numpy(), len(keys), prior)
    return Classifier(keys, model)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The columns of ``docs`` but text, and score (which takes the place of one there), for each row. Only text is read for it."""
    context = docs.sparkSession.sparkContext
    index, model = context.broadcast(KeyIndex(classifier.keys)), context.broadcast(classifier.model)
    kept = [c for c in docs.columns if c.lower() not in ("text", "score")]
    row = F.struct(*kept)
    packed = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(_scored(index, model), f"row {packed.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")


def _clean(index, model):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                keys, texts, n = _features(block)
                k, at = index.value.find(keys)
                k, t = _distinct(k.astype(np.int64), texts[at])
                keep = model.value.logits(k, t, n) < 0 if model.value is not None else np.ones(len(block), bool)
                yield batch.slice(block.first, len(block)).filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    context = docs.sparkSession.sparkContext
    index, model = context.broadcast(KeyIndex(classifier.keys)), context.broadcast(classifier.model)
    return docs.mapInArrow(_clean(index, model), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
