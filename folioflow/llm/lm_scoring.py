"""LM scoring: a log-bilinear neural model trained in numpy by noise-contrastive estimation.

The model (after Mnih and Teh, 2012) predicts the next token: the vector of what is expected is the sum of the vectors of
the CONTEXT units before it, each scaled by its place, and outcomes score by dot product and bias. A token is predicted in two steps,
its class and then its unit within the class, so that batched matrix products give log-probabilities normalised over all words
at the cost of some hundred outcomes. Classes are made from a word's form (first and last two lower-cased bytes). Frequent words are units of
their own; how many grows with the training vocabulary. All other words of a class share one unit, within
which a word has its smoothed share of the training tokens. An unknown word counts as one more word of its
class. So probabilities sum to one over all words.

All training tokens are counted and used for training: in ROUNDS rounds over disjoint thirds of the documents, or in one round where all fit
one part. A round's documents are dealt into parts by their hash, about PART_TOKENS tokens in each (more once there are MOST_PARTS parts), and sorted within; every
part trains from the last round's parameters, passing over its documents as often as it takes to make LEAST_STEPS steps in all rounds, once at least and MOST_PASSES times at most. The results are averaged by
tokens as whole numbers, slice by slice in the tasks that they are shuffled to. So scores depend
neither on partitions nor on the order of rows. Counts of frequent words (HEAD at most) are known to all tasks. Other
words are joined with their counts by hash, so no vocabulary is gathered.

A null text is empty: its one token is the end. A null id counts as an empty string for the fold. Repeated rows stay repeated
(and count in training), other columns are ignored, an empty table gives no rows. A very long text is one row of token units, 4 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import Block, blocks, mix, returns_memory
from .workspace import Workspace

FOLDS, HELD = 7, 2
#: Words known to all tasks, by hash and count.
HEAD = 1 << 18
#: One in WORDS_PER_UNIT words of the training vocabulary, the most frequent ones, is a unit of its own, up to MOST_UNITS.
WORDS_PER_UNIT, MOST_UNITS = 8, 4096
CONTEXT, WIDTH = 4, 32
ROUNDS, PART_TOKENS, MOST_PARTS = 3, 1 << 21, 1 << 13
#: Tables that give fewer steps are passed over several times. More passes would learn a small table by heart.
LEAST_STEPS, MOST_PASSES = 2000, 16
#: A part's parameters are added up in so many slices.
SLICES = 64
#: Tokens of a step; noise classes that they share; noise units for each class of the step; AdaGrad's rate.
BATCH, NOISE, CLASS_NOISE, RATE = 2048, 32, 3, 0.1
#: Tokens that are scored at once.
SCORED = 2048
#: Parameters are averaged as whole multiples of this.
GRAIN = 2.0**-24
END = np.uint64(0x0E4D0E4D0E4D0E4D)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, each text's end included, hashes of their forms, and the bounds of the texts."""
    starts, ends, before = block.words()
    n, k = np.diff(before), len(block)
    bounds = before + np.arange(k + 1)
    place = np.arange(len(starts)) + np.repeat(np.arange(k), n)
    out, forms = np.empty(len(starts) + k, np.uint64), np.zeros(len(starts) + k, np.uint64)
    out[place] = block.hashes(starts, ends)
    if len(starts):
        d = np.where((block.data >= 65) & (block.data <= 90), block.data + 32, block.data).astype(np.uint64)
        forms[place] = d[np.maximum(ends - 2, starts)] * np.uint64(65536) + d[ends - 1] * np.uint64(256) + d[starts]
    out[bounds[1:] - 1] = END
    return out, mix(forms), bounds


def _distinct(keys: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, the form of each, and which of them each token has."""
    found = pa.array(keys.view(np.int64)).dictionary_encode()
    which, known = found.indices.to_numpy(), found.dictionary.to_numpy().view(np.uint64)
    form = np.empty(len(known), np.uint64)
    form[which] = forms
    return known, form, which


def _keeps_blocks() -> None:
    """The arrays of one step serve the next: glibc gives freed blocks back, and faults new ones in, only above the size of the largest that it has seen freed (32 MB at most)."""
    np.empty(31 << 20, np.uint8)


@returns_memory
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _keeps_blocks()
    for batch in batches:
        found = [tokens(b)[:2] for b in blocks(batch["text"])]
        if not found:
            continue
        keys, forms, which = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(forms.view(np.int64)), pa.array(np.bincount(which, minlength=len(keys)))], ["key", "form", "n"])


@dataclass
class Lexicon:
    """What all tasks know of the words: hashes, counts and units of frequent ones, the class of each unit, and the mass of shared units.

    Units 0 to own - 1 are words, own + c is what other words of class c share, and own + classes stands for what is before a text.
    """

    keys: np.ndarray
    logs: np.ndarray
    units: np.ndarray
    own: int
    class_of: np.ndarray
    share: np.ndarray
    shared_log: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.shared_log)

    def look_up(self, keys: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of tokens, which are known here, and log10(count + 1) of those (0 for others)."""
        shared = (forms % np.uint64(self.classes)).astype(np.int64) + self.own
        if not len(self.keys):
            return shared, np.zeros(len(keys), bool), np.zeros(len(keys))
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[k] == keys
        return np.where(known, self.units[k], shared), known, np.where(known, self.logs[k], 0.0)


@dataclass
class Parameters:
    """Context vectors R, place scales C, and vectors and biases of classes (K, k) and of units within classes (Q, q)."""

    R: np.ndarray
    C: np.ndarray
    K: np.ndarray
    k: np.ndarray
    Q: np.ndarray
    q: np.ndarray

    @staticmethod
    def shapes(own: int, classes: int) -> list[tuple[int, ...]]:
        return [(own + classes + 1, WIDTH), (CONTEXT, WIDTH), (classes, WIDTH), (classes,), (own + classes, WIDTH), (own + classes,)]

    @classmethod
    def start(cls, lex: Lexicon) -> Parameters:
        rng = np.random.default_rng(3)
        by_class = np.bincount(lex.class_of, lex.share, lex.classes)
        x = [(rng.normal(size=s) * 0.1).astype(np.float32) for s in cls.shapes(lex.own, lex.classes)]
        x[1], x[3], x[5] = np.full((CONTEXT, WIDTH), 0.5, np.float32), np.log(by_class).astype(np.float32), np.log(lex.share / by_class[lex.class_of]).astype(np.float32)
        return cls(*x)

    def parts(self) -> list[np.ndarray]:
        return [self.R, self.C, self.K, self.k, self.Q, self.q]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, own: int, classes: int) -> Parameters:
        parts, at = [], 0
        for shape in cls.shapes(own, classes):
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return cls(*parts)


def contexts(units: np.ndarray, bounds: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT units before each token, nearest first; ``before`` where the text hasn't begun."""
    out = np.full((CONTEXT, len(units)), before, np.int32)
    for k in range(CONTEXT):
        out[k, k + 1 :] = units[: max(0, len(units) - k - 1)]
        for place in range(k + 1):
            at = bounds[:-1] + place
            out[k, at[at < bounds[1:]]] = before
    return out.T


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of rows in an order. Rows alone are only copied, and two floats are added at a time, as one complex number: reduceat loops over columns and runs."""
    size = np.diff(np.append(first, len(order)))
    sums, long = np.take(values, order[first], axis=0), size > 1
    if long.any():
        rows = np.take(values, order[np.repeat(long, size)], axis=0)
        sums[long] = np.add.reduceat(rows.view(np.complex64), np.cumsum(size[long]) - size[long], axis=0).view(np.float32)
    return sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _order(x: np.ndarray) -> np.ndarray:
    return np.argsort(x.astype(np.uint16), kind="stable")  # classes and units are below 2**16; a radix sort


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps, of classes and of units within their classes."""

    def __init__(self, p: Parameters, lex: Lexicon, passes: int = 1):
        self.p, self.lex, self.rng, self.passes = p, lex, np.random.default_rng(11), passes
        self.seen = {name: np.full_like(x, 1e-4) for name, x in zip("RCKkQq", p.parts(), strict=True)}
        self.by_class = np.bincount(lex.class_of, lex.share, lex.classes)
        self.inner = lex.share / self.by_class[lex.class_of]
        self.log_classes, self.log_units = (np.log(k * x).astype(np.float32) for k, x in ((NOISE, self.by_class), (CLASS_NOISE, self.inner)))
        # classes and, by class, units to draw noise from
        self.below = np.cumsum(self.by_class)
        self.below /= self.below[-1]
        self.members = np.argsort(lex.class_of, kind="stable")
        self.ends = np.cumsum(np.bincount(lex.class_of, minlength=lex.classes))
        self.upto = np.cumsum(self.inner[self.members])
        self.place = np.empty_like(self.members)
        self.place[self.members] = np.arange(len(self.members))
        #: Gradients of units, zero between steps.
        self.dQ = np.zeros_like(p.Q)
        self.held: list[np.ndarray] = []
        #: Documents for further passes, if there are any.
        self.kept: list[np.ndarray] = []
        self.tokens = self.waiting = 0

    def add(self, units: np.ndarray) -> None:
        """One document's units. Documents are trained on some at a time, in an order that their tokens alone decide."""
        self.held.append(units)
        self.tokens += len(units)
        self.waiting += len(units)
        if self.waiting >= 16 * BATCH:
            self.flush()

    def finish(self) -> None:
        """Further passes over the documents, each in another order."""
        self.flush()
        documents = self.kept
        for turn in range(1, self.passes):
            for i in np.random.default_rng(turn).permutation(len(documents)).tolist():
                self.held.append(documents[i])
                self.waiting += len(documents[i])
                if self.waiting >= 16 * BATCH:
                    self.flush(turn)
            self.flush(turn)

    def flush(self, turn: int = 0) -> None:
        if not self.held:
            return
        units = np.concatenate(self.held)
        bounds = np.concatenate([[0], np.cumsum([len(u) for u in self.held])])
        if self.passes > 1 and not turn:
            self.kept += self.held
        self.held, self.waiting = [], 0
        context = contexts(units, bounds, self.lex.own + self.lex.classes)
        mixed = np.random.default_rng((len(units), turn)).permutation(len(units))
        for i in range(0, len(units), BATCH):
            part = mixed[i : i + BATCH]
            part = part[_order(self.place[units[part]])]  # by class and unit
            self.step(units[part], np.take(context.T, part, axis=1))

    def _move(self, name: str, x: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``rows``: where the gradient isn't zero, each once; all of them if None."""
        seen = self.seen[name] if rows is None else np.take(self.seen[name], rows, axis=0)
        seen += g * g
        g = RATE * g
        g /= np.sqrt(seen)
        if rows is None:
            x -= g
        else:
            self.seen[name][rows] = seen
            x[rows] = np.take(x, rows, axis=0) - g

    def step(self, w: np.ndarray, context: np.ndarray) -> None:
        """``w``: tokens in the order of their classes, and of units within; ``context``: for each place, the unit there of each token."""
        p, n, c = self.p, len(w), self.lex.class_of[w]
        near = np.take(p.R, context, axis=0)
        v = near[0] * p.C[0]
        for k in range(1, CONTEXT):
            v += near[k] * p.C[k]
        # classes: all tokens of the step share their noise
        noise = np.searchsorted(self.below, self.rng.random(NOISE), "right")
        log_noise = self.log_classes - p.k
        N = p.K[noise]
        gt = _sigmoid(log_noise[noise] - v @ N.T)
        gt /= n
        # units: all tokens of a class share theirs, which stand beside the class itself
        drawn = np.searchsorted(self.upto, np.arange(len(self.ends))[:, None] + self.rng.random((len(self.ends), CLASS_NOISE)), "right")
        other = self.members[np.minimum(drawn, self.ends[:, None] - 1)]
        log_inner = self.log_units - p.q
        shared = np.take(np.concatenate([p.K[:, None], p.Q[other]], axis=1), c, axis=0)
        gs = _sigmoid(np.take(np.concatenate([log_noise[:, None], log_inner[other]], axis=1), c, axis=0) - np.einsum("nd,nmd->nm", v, shared))
        gs[:, 0] -= 1
        gs /= n
        Q = np.take(p.Q, w, axis=0)
        hs = (_sigmoid(log_inner[w] - np.einsum("nd,nd->n", v, Q)) - 1) / n
        gv = np.einsum("nm,nmd->nd", gs, shared)
        gv += gt @ N
        Q *= hs[:, None]
        gv += Q
        # gradients of classes and of units; no unit is in two classes
        dK, dk = np.zeros_like(p.K), np.bincount(noise, np.ones(n, np.float32) @ gt, len(p.k)) + np.bincount(c, gs[:, 0], len(p.k))
        np.add.at(dK, noise, gt.T @ v)
        dq = np.bincount(w, hs, len(p.q))
        runs, first = _runs(w), _runs(c)
        self.dQ[w[runs]] = _run_sums(np.multiply(hs[:, None], v, out=Q), np.arange(n), runs)
        kinds, pull, told = c[first], gs.T, np.empty((len(first), 1 + CLASS_NOISE, WIDTH), np.float32)
        for k, (x, y) in enumerate(zip(first.tolist(), [*first[1:].tolist(), n], strict=True)):
            np.matmul(pull[:, x:y], v[x:y], out=told[k])
        dK[kinds] += told[:, 0]
        drawn = other[kinds]
        for m in range(CLASS_NOISE):
            self.dQ[drawn[:, m]] += told[:, m + 1]
            dq += np.bincount(other[c, m], gs[:, m + 1], len(p.q))
        units = np.flatnonzero(np.bincount(np.concatenate([w[runs], drawn.ravel()])))
        self._move("Q", p.Q, np.take(self.dQ, units, axis=0), units)
        self.dQ[units] = 0
        self._move("q", p.q, dq.astype(np.float32))
        self._move("K", p.K, dK)
        self._move("k", p.k, dk.astype(np.float32))
        dC = np.stack([np.einsum("nd,nd->d", gv, near[k]) for k in range(CONTEXT)])
        at = context.ravel()
        order = _order(at)
        at, near = at[order], np.multiply(gv, p.C[:, None], out=near)
        first = _runs(at)
        self._move("R", p.R, _run_sums(near.reshape(-1, WIDTH), order, first), at[first])
        self._move("C", p.C, dC)


def _log_softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the normalised exponential of one column of each row. ``s`` is overwritten."""
    if max(s.max(), -s.min()) > 60:  # else no exponential or sum leaves the range of a float
        s -= s.max(axis=1, keepdims=True)
    own = np.take(s.ravel(), np.arange(len(s)) * s.shape[1] + at)
    np.exp(s, out=s)
    return own - np.log(s @ np.ones(s.shape[1], s.dtype))


def log10_units(p: Parameters, lex: Lexicon, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The normalised log10 probability of each token's unit: of its class, and of the unit within the class."""
    out = np.empty(len(target))
    members = np.argsort(lex.class_of, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(lex.class_of, minlength=lex.classes))])
    place = np.empty_like(members)
    place[members] = np.arange(len(members)) - np.repeat(ends[:-1], np.diff(ends))
    table = [p.R * p.C[k] for k in range(CONTEXT)]
    inside = [(p.Q[members[x:y]].T, p.q[members[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
    for i in range(0, len(target), 1 << 15):
        w, c = target[i : i + (1 << 15)], context[i : i + (1 << 15)]
        order = _order(lex.class_of[w])
        w, c = w[order], np.take(c.T, order, axis=1)
        kind = lex.class_of[w]
        v, got = np.empty((len(w), WIDTH), np.float32), np.empty(len(w), np.float32)
        for x in range(0, len(w), SCORED):  # few enough for a core's cache
            y = min(x + SCORED, len(w))
            sums = np.take(table[0], c[0, x:y], axis=0, out=v[x:y], mode="clip")
            for k in range(1, CONTEXT):
                sums += np.take(table[k], c[k, x:y], axis=0)
            scores = sums @ p.K.T
            scores += p.k
            got[x:y] = _log_softmax(scores, kind[x:y])
        at, first = place[w], _runs(kind)
        for x, end in zip(first.tolist(), [*first[1:].tolist(), len(w)], strict=True):
            Q, q = inside[kind[x]]
            if len(q) > 1:
                for a in range(x, end, SCORED):
                    b = min(a + SCORED, end)
                    scores = v[a:b] @ Q
                    scores += q
                    got[a:b] += _log_softmax(scores, at[a:b])
        out[i + order] = got / np.log(10)
    return out


_TOKENS = "row struct<doc_id:long,row:long,part:long,round:int,order:long>, n_tokens long, known long, logs double, shares double, units array<int>, rest array<long>, times array<int>"


def _unit_rows(lexicon):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keeps_blocks()
        lex = lexicon.value
        for batch in batches:
            for block in blocks(batch["text"]):
                keys, forms, bounds = tokens(block)
                words, form, which = _distinct(keys, forms)
                units, known, logs = (np.take(x, which) for x in lex.look_up(words, form))
                shared = units >= lex.own
                # a word of a shared unit: its share of the unit is added by its count, here or by the join
                share = np.where(shared, logs - lex.shared_log[np.maximum(units - lex.own, 0)], 0.0)
                total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731, B023
                # words that aren't known here, once for each text that has them
                at = np.flatnonzero(~known)
                text = np.searchsorted(bounds, at, "right") - 1
                by = np.lexsort((keys[at], text))
                rare, text = keys[at][by], text[by]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])])[: len(at)])
                cuts, times = np.searchsorted(text[first], np.arange(len(block) + 1)), np.diff(np.append(first, len(at)))
                lists = lambda ends, x: pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(x))
                yield pa.record_batch(
                    [
                        batch["row"].slice(block.first, len(block)), pa.array(np.diff(bounds)), pa.array(total(known.astype(np.int64))), pa.array(total(logs)), pa.array(total(share)),
                        lists(bounds, units.astype(np.int32)), lists(cuts, rare[first].view(np.int64)), lists(cuts, times.astype(np.int32)),
                    ],
                    ["row", "n_tokens", "known", "logs", "shares", "units", "rest", "times"],
                )

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64), bounds - bounds[0]


def _trained(lexicon, start, passes: int):
    """Rows sorted by part: what each part makes of the parameters, as slices of whole numbers weighed by tokens."""

    def result(t: Trainer) -> pa.RecordBatch:
        t.finish()
        whole = np.rint(t.p.flat().astype(np.float64) / GRAIN).astype(np.int64)
        parts = np.array_split(whole, SLICES)
        return pa.record_batch([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in parts]), pa.array(np.full(SLICES, t.tokens, np.int64))], ["slice", "whole", "n"])

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keeps_blocks()
        lex, now, trainer = lexicon.value, None, None
        for batch in batches:
            parts = batch["part"].to_numpy()
            units, bounds = _lists(batch["units"])
            for i, part in enumerate(parts.tolist()):
                if part != now:
                    if trainer is not None:
                        yield result(trainer)
                    now, trainer = part, Trainer(Parameters.of(start.value.copy(), lex.own, lex.classes), lex, passes)
                trainer.add(units[bounds[i] : bounds[i + 1]])
        if trainer is not None:
            yield result(trainer)

    return run


@returns_memory
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of parts, each weighed by tokens, as one sum for each slice. Sums are exact: two words of 64 bits each."""
    sums: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for batch in batches:
        for k, whole, n in zip(*(batch[c].to_pylist() for c in ("slice", "whole", "n")), strict=True):
            x = np.frombuffer(whole, np.int64)
            high, low, total = sums.get(k, (0, 0, 0))
            sums[k] = (high + (x >> 16) * n, low + (x & 0xFFFF) * n, total + n)
    for k, (high, low, n) in sums.items():
        mean = (high.astype(np.float64) * 65536 + low) / n * GRAIN
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([mean.astype(np.float32).tobytes()])], ["slice", "mean"])


def _scores(lexicon, parameters):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keeps_blocks()
        lex = lexicon.value
        p = Parameters.of(parameters.value, lex.own, lex.classes)
        for batch in batches:
            units, bounds = _lists(batch["units"])
            model = np.add.reduceat(log10_units(p, lex, units, contexts(units, bounds, lex.own + lex.classes)), bounds[:-1]) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch["row"], pa.array(model)], ["row", "model"])

    return run


def _lexicon(counts: DataFrame, told, step: Column) -> tuple[Lexicon, int]:
    """The lexicon, and the step of counts from which words are in it."""
    lowest, total = 1 << 30, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():  # at most 4 * 64 rows
        if total + r.k > HEAD:
            break
        lowest, total = r.step, total + r.k
    head = counts.where(step >= lowest).toPandas()  # at most HEAD rows
    head = head.sort_values(["n", "key"], ascending=[False, True]).reset_index(drop=True)
    own = min(MOST_UNITS, told.words // WORDS_PER_UNIT, len(head))
    classes = 1 << max(4, own.bit_length() // 2)
    form = F.pmod(F.pmod("form", F.lit(1 << 20)), F.lit(classes))  # classes is a power of two, so a signed form has the same class
    mass = np.ones(classes)  # an unknown word beside the known ones
    for r in counts.groupBy(form.alias("c")).agg(F.sum(F.col("n") + 1).alias("mass")).collect():  # ``classes`` rows
        mass[r.c] += r.mass
    kind = (head.form.to_numpy(np.int64).view(np.uint64) % np.uint64(classes)).astype(np.int64)
    np.subtract.at(mass, kind[:own], head.n.to_numpy()[:own] + 1)
    units = np.where(head.index < own, np.arange(len(head)), kind + own)
    share = np.concatenate([head.n.to_numpy(float)[:own] + 1, mass])
    order = np.argsort(head.key.to_numpy(np.int64).view(np.uint64))
    keys, logs = head.key.to_numpy(np.int64).view(np.uint64), np.log10(head.n.to_numpy(float) + 1.0)
    return Lexicon(keys[order], logs[order], units[order].astype(np.int64), own, np.concatenate([kind[:own], np.arange(classes)]), share / share.sum(), np.log10(mass)), lowest


def score_texts(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = fold(F.col("doc_id")) == HELD
    # of words that differ in the case of letters only, all have one form
    counts = work.save(docs.where(~held).select("text").mapInArrow(_counts, "key long, form long, n long").groupBy("key").agg(F.min("form").alias("form"), F.sum("n").alias("n")), "counts")
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    step = F.floor(4 * F.log2("n")).cast("int")
    lex, lowest = _lexicon(counts, told, step)
    lexicon = spark.sparkContext.broadcast(lex)

    rounds = ROUNDS if told.tokens > PART_TOKENS else 1
    parts = min(MOST_PARTS, max(1, -(-told.tokens // (rounds * PART_TOKENS))))
    passes = min(MOST_PASSES, -(-LEAST_STEPS * BATCH * parts // max(1, told.tokens)))
    order = F.xxhash64("doc_id", "text")
    part, turn = F.when(held, F.lit(-1)).otherwise(F.pmod(F.xxhash64(order, F.lit(5)), F.lit(parts))).cast("long"), F.pmod(F.xxhash64(order, F.lit(9)), F.lit(rounds)).cast("int")
    rows = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row"), part.alias("part"), turn.alias("round"), order.alias("order")).alias("row"), "text")
    found = rows.mapInArrow(_unit_rows(lexicon), _TOKENS)
    found = work.save(found.select("row.*", "n_tokens", "known", "logs", "shares", "units", "rest", "times"), "tokens")

    flat = Parameters.start(lex).flat()
    for k in range(rounds):
        dealt = found.where(F.col("round") == k).where("part >= 0").select("part", "order", "units").repartition(parts, "part").sortWithinPartitions("part", "order")
        sums = dealt.select("part", "units").mapInArrow(_trained(lexicon, spark.sparkContext.broadcast(flat), passes), "slice int, whole binary, n long")
        sums = sums.repartition("slice").mapInArrow(_added, "slice int, mean binary").orderBy("slice").collect()  # SLICES rows, 4 bytes a parameter
        if sums:
            flat = np.concatenate([np.frombuffer(r.mean, np.float32) for r in sums])
    scored = found.select("row", "units").mapInArrow(_scores(lexicon, spark.sparkContext.broadcast(flat)), "row long, model double")
    scored = work.save(scored, "scored")
    rest = found.select("row", F.inline(F.arrays_zip("rest", "times")).alias("key", "times"))
    rest = rest.join(counts.where(step < lowest).select("key", "n"), "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return found.drop("rest", "times", "units").join(scored, "row").join(rest, "row", "left").select(
        "doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(told.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * F.log10(F.lit(float(told.tokens + told.words + 1)))).alias("base_score"), (F.col("model") + F.col("shares") + more_logs).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
