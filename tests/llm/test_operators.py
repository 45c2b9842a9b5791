"""The training-data operators against brute force, and on tables with nulls, ties, repeats, clashing columns and no rows."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from folioflow.llm import chat_format, fingerprints, jaccard_join, line_rules, linkage, lm_scoring, mixing, packing, queries, sharding, toxicity, url_filter, workspace

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans(url_filter.UPPER, url_filter.LOWER)
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to find another place to rest in peace before night falls"
ROWS = [
    (1, BASE, "en", "a", 1, "x"), (2, BASE, "en", "a", 1, "x"), (2, BASE, "en", "a", 1, "x"), (3, BASE.replace("night", "morning"), "en", None, 1, "x"), (4, None, None, None, None, None),
    (5, "", "en", "b", 0, "x"), (6, " \n\t ", "en", "b", 3, "x"), (7, "Two words", "en", "b", 9, "x"), (8, "TWO WORDS", "en", "b", 9, "x"), (None, "two words", "en", "b", 9, "x"),
    (9, "long " * 30_000 + "end", "en", "c", 9, "x"), (10, "été à la plage ## </turn> \\ ### 漢字 😀 <|endoftext|>", "fr", "c", 9, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute(queries.ORACLES[name])
    names = [c[0] for c in con.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in con.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in queries.QUERIES[name](spark, DATA).collect()), key=str)
    assert got == want


def test_jaccard_join_edges(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    n = len(shingle_set(BASE))
    links = {(r.doc_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect()}
    assert {(1, 3), (2, 3), (3, 3), (4, 0), (5, 0), (7, 2), (None, 2), (9, 0)} <= links
    assert (2, n, 1) in got and got.count((2, n, 1)) == 2
    linked = len(shingle_set(BASE) & shingle_set(ROWS[3][1])) / len(shingle_set(BASE) | shingle_set(ROWS[3][1])) >= 0.75
    assert (3, n, 1 if linked else 3) in got
    assert (4, 0, 4) in got and (5, 0, 5) in got and (6, 0, 6) in got and (7, 1, 7) in got and (8, 1, 7) in got and (None, 1, 7) in got
    assert jaccard_join.jaccard_components(empty).collect() == []
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, *([] if linked else [3]), 4, 5, 6, 7, 9, 10]


def test_small_sets_by_subsets(spark):
    """Pairs of small sets with every boundary, against brute force."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{(k * 7 + int(rng.integers(0, 2)) * (k == 9)) % 11}" for k in range(int(rng.integers(4, 14))))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i for i, _ in rows}
    sets = {i: shingle_set(t) for i, t in rows}
    for _ in rows:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    want[i] = min(want[i], want[j])
    for boundary in (1, 6, 10):
        old, jaccard_join.boundary_by_cost = jaccard_join.boundary_by_cost, lambda *_, b=boundary: b
        try:
            assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == want
        finally:
            jaccard_join.boundary_by_cost = old


def near_copies(n, length, edits, seed, texts=1):
    """Documents made of a few base texts by replacing words of them, so that many pairs are just below or just above the limit."""
    rng = np.random.default_rng(seed)
    bases = [[f"b{t}w{k}" for k in range(length)] for t in range(texts)]
    out = []
    for i in range(n):
        w = list(bases[i % texts])
        for k in rng.choice(length, int(rng.integers(0, edits)), replace=False):
            w[k] = f"x{i}y{k}" if rng.random() < 0.7 else f"z{k}"
        out.append((i, " ".join(w[: int(rng.integers(length * 4 // 5, length + 1))])))
    return out


def plain_links(rows):
    """doc_id: (component, number of links), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    linked = np.array([[i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    least = np.arange(len(rows))
    while True:
        new = np.where(linked, least[None, :], least[:, None]).min(axis=1)
        if (new == least).all():
            return {rows[i][0]: (rows[least[i]][0], int(linked[i].sum())) for i in range(len(rows))}
        least = new


@pytest.mark.parametrize("long,rows,cell,chunk", [(64, 4096, 1024, 1 << 20), (2, 5, 12, 40)])
def test_jaccard_links_by_every_path(spark, monkeypatch, long, rows, cell, chunk):
    """Short and long lists, lists cut into parts, clusters in one cell and in blocks: all give what comparing all pairs gives."""
    for module, name, value in ((jaccard_join, "LONG", long), (jaccard_join, "LIST_ROWS", rows), (linkage, "CELL_SETS", cell), (jaccard_join, "CHUNK", chunk), (jaccard_join, "FREQUENT_FROM", 3)):
        monkeypatch.setattr(module, name, value)
    made = near_copies(90, 60, 6, 1, texts=3) + [(1000 + i, t) for i, t in near_copies(60, 25, 4, 2)] + [(2000, " ".join(f"b0w{k}" for k in range(60)))] * 1
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == plain_links(made)
    if cell < 1024:
        for share in (0, 2):  # blocks meet as for counts, or those outside of the largest groups only
            monkeypatch.setattr(linkage, "WIDER", 1)
            monkeypatch.setattr(linkage, "MANY_OUTSIDE", share)
            assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == {c for c, _ in got.values()}


def test_pairs_are_not_written_out(spark):
    """A group of 1,500 near copies has over 200,000 links; its candidates are some rows for each set."""
    made = near_copies(1500, 80, 4, 5)
    rows = []
    save = jaccard_join.Workspace.save

    class Counting(jaccard_join.Workspace):
        def save(self, df, name):
            out = save(self, df, name)
            rows.append((name, out.count()))
            return out

    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    got = jaccard_join.jaccard_components(docs, Counting(spark, "t")).toPandas()
    assert got.n_links.sum() > 400_000 and dict(rows)["lists"] < 30_000 and dict(rows)["linked"] <= 6 * 1500


def test_frequent_shingles_in_short_batches(spark):
    """Texts that share but a frequent shingle are no candidates, however few rows a batch has: it is counted over a whole part of a task."""
    passages = [" ".join(f"p{k}w{j}" for j in range(5)) for k in range(60)]
    made = [(i, " ".join(f"{passages[(i * 7 + 11 * j * (1 + i // 60)) % 60]} " + " ".join(f"d{i}x{j}y{w}" for w in range(12)) for j in range(3))) for i in range(2000)]
    rows = []

    class Counting(jaccard_join.Workspace):
        def save(self, df, name):
            out = super().save(df, name)
            rows.append((name, out.count()))
            return out

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "2")
    try:
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
        assert jaccard_join.one_of_each(docs, Counting(spark, "t")).count() == 2000
    finally:
        spark.conf.set(batch, before)
    assert dict(rows)["frequent"] == 60 and dict(rows)["candidates"] == 0


def test_frequent_from():
    assert jaccard_join.frequent_from(0) == jaccard_join.frequent_from(1) == 32
    assert jaccard_join.frequent_from(51) == 15 and jaccard_join.frequent_from(10_000) == 2


def test_shared_counts():
    rng = np.random.default_rng(8)
    for k, universe in ((2, 20), (5, 40), (100, 300), (130, 4000)):
        sets = [np.sort(rng.choice(universe, int(rng.integers(1, universe // 2)), replace=False)).astype(np.uint64) for _ in range(k)]
        want = [[len(set(a.tolist()) & set(b.tolist())) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        assert (linkage.shared_counts(sets) == np.array(want)).all()


def test_lookup(spark):
    keys = spark.createDataFrame([(k,) for k in (-5, 7, (1 << 62) + 700, 700 - (1 << 63), 40_000)], "key long")
    look = workspace.Lookup(keys)
    rows = spark.createDataFrame([(k, "x", 1) for k in range(-50, 50)] + [((1 << 62) + 700, None, 2), (700 - (1 << 63), "y", 3), (40_000, "z", 4)], "v long, _words string, _page int")
    near, rest = look.split(rows, F.col("v"))
    assert near.columns == rest.columns == rows.columns
    assert sorted(r.v for r in near.collect()) == [700 - (1 << 63), -5, 7, 40_000, (1 << 62) + 700] and rest.count() == 98
    assert look.has(np.array([7, 8, -5, 40_000, 40_001])).tolist() == [True, False, True, True, False]
    assert workspace.Lookup(keys.limit(0)).split(rows, F.col("v"))[0].count() == 0


def test_lm_scores(spark, docs, empty):
    got = lm_scoring.score_texts(docs).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = collections.Counter(w for r in ROWS if not held(r[0]) for w in [*words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    key = lambda t: (str(t[0]), t[1])
    want = sorted(((r[0], len(words(r[1])) + 1, sum(counts[w] > 0 for w in [*words(r[1]), None]), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(r[1]), None])) for r in ROWS), key=key)
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), want, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(b[3]))
    assert {r.train_tokens for r in got} == {n} and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_texts(empty).collect() == []
    real = lm_scoring.op2_lm_scoring(spark, DATA).toPandas()
    assert real[real.held_out].score.sum() > real[real.held_out].base_score.sum()


def small_lexicon(own=30, classes=16, seed=1):
    rng = np.random.default_rng(seed)
    share = rng.random(own + classes) + 0.1
    return lm_scoring.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), own, np.concatenate([rng.integers(0, classes, own), np.arange(classes)]), share / share.sum(), np.zeros(classes))


def test_lm_probabilities():
    """Units' probabilities sum to one in any context, and are those of a plain log-bilinear model."""
    lex = small_lexicon()
    units = lex.own + lex.classes
    p = lm_scoring.Parameters.start(lex)
    for x in p.parts():
        x += np.random.default_rng(2).normal(size=x.shape).astype(np.float32) * 0.3
    for near in ([1, 2, 3, units], [40, 40, 0, 5]):
        got = 10 ** lm_scoring.log10_units(p, lex, np.arange(units), np.repeat([near], units, axis=0).astype(np.int32))
        assert abs(got.sum() - 1) < 1e-4
        v = sum(p.R[u] * p.C[k] for k, u in enumerate(near))
        for w in range(units):
            kind = lex.class_of[w]
            of_class = np.exp(p.K @ v + p.k)
            inside = np.exp(p.Q @ v + p.q) * (lex.class_of == kind)
            assert abs(got[w] - of_class[kind] / of_class.sum() * inside[w] / inside.sum()) < 1e-5


def test_lm_training_learns_contexts():
    """After training on texts in which one unit always follows another, that unit is likelier there than its share."""
    lex = small_lexicon()
    rng = np.random.default_rng(3)
    trainer = lm_scoring.Trainer(lm_scoring.Parameters.start(lex), lex)
    for _ in range(400):
        u = rng.choice(46, 200, p=lex.share)
        u[np.flatnonzero(u[:-1] == 7) + 1] = 9
        trainer.add(u)
    trainer.flush()
    got = 10 ** lm_scoring.log10_units(trainer.p, lex, np.array([9, 9]), np.array([[7, 3, 3, 3], [3, 3, 3, 3]], np.int32))
    assert got[0] > 5 * got[1]


def plain_step(p, seen, lex, rng, w, context):
    """One step of noise-contrastive estimation with AdaGrad, token by token."""
    n, (R, C, K, k, Q, q) = len(w), (x.astype(float) for x in p.parts())
    by_class = np.bincount(lex.class_of, lex.share, lex.classes)
    inner = lex.share / by_class[lex.class_of]
    members = [np.flatnonzero(lex.class_of == c) for c in range(lex.classes)]
    noise = rng.choice(lex.classes, lm_scoring.NOISE, p=by_class)
    drawn = rng.random((lex.classes, lm_scoring.CLASS_NOISE))
    other = [[m[min(np.searchsorted(np.cumsum(inner[m]), x, "right"), len(m) - 1)] for x in row] for m, row in zip(members, drawn, strict=True)]
    dR, dC, dK, dk, dQ, dq = (np.zeros_like(x) for x in (R, C, K, k, Q, q))
    for i in range(n):
        near, c = context[:, i], lex.class_of[w[i]]
        v, gv = (R[near] * C).sum(axis=0), np.zeros(lm_scoring.WIDTH)
        told = [(K, k, dK, dk, c, lm_scoring.NOISE * by_class[c], 1)] + [(K, k, dK, dk, x, lm_scoring.NOISE * by_class[x], 0) for x in noise]
        told += [(Q, q, dQ, dq, u, lm_scoring.CLASS_NOISE * inner[u], j == 0) for j, u in enumerate([w[i], *other[c]])]
        for table, bias, dtable, dbias, u, mass, real in told:
            g = (1 / (1 + mass * np.exp(-v @ table[u] - bias[u])) - real) / n
            gv += g * table[u]
            dtable[u] += g * v
            dbias[u] += g
        for place, u in enumerate(near):
            dR[u] += gv * C[place]
            dC[place] += gv * R[u]
    return [x - lm_scoring.RATE * g / np.sqrt(s + g * g) for x, g, s in zip((R, C, K, k, Q, q), (dR, dC, dK, dk, dQ, dq), seen, strict=True)]


def test_lm_step_is_plain_estimation():
    """A step's products over classes and runs of units give what single tokens add up to."""
    lex, rng = small_lexicon(), np.random.default_rng(4)
    trainer = lm_scoring.Trainer(lm_scoring.Parameters.start(lex), lex)
    for n in (1, 300):
        w = rng.choice(46, n, p=lex.share)
        w = w[np.argsort(trainer.place[w], kind="stable")]
        context = rng.integers(0, 47, (lm_scoring.CONTEXT, n)).astype(np.int32)
        state = np.random.default_rng()
        state.bit_generator.state = trainer.rng.bit_generator.state
        want = plain_step(trainer.p, [trainer.seen[x].astype(float) for x in "RCKkQq"], lex, state, list(w), context)
        trainer.step(w, context)
        assert all(abs(x - y).max() < 1e-4 for x, y in zip(trainer.p.parts(), want, strict=True)) and not trainer.dQ.any()


def test_lm_work_is_shared(monkeypatch):
    """A word is looked up once for a block, however often it occurs, and tokens are scored few enough at once for a core's cache."""
    seen, rows = [], []

    class Counting(lm_scoring.Lexicon):
        def look_up(self, keys, forms):
            seen.append(len(keys))
            return super().look_up(keys, forms)

    lex = Counting(**vars(small_lexicon()))
    pa, softmax = lm_scoring.pa, lm_scoring._log_softmax
    batch = pa.record_batch([pa.array([{"doc_id": 1}, {"doc_id": 2}]), pa.array(["a b a " * 300, ""])], ["row", "text"])
    got = list(lm_scoring._unit_rows(type("Shared", (), {"value": lex}))(iter([batch])))
    assert seen == [3] and [x for b in got for x in b["n_tokens"].to_pylist()] == [901, 1]
    monkeypatch.setattr(lm_scoring, "_log_softmax", lambda s, at: rows.append(len(s)) or softmax(s, at))
    units = np.random.default_rng(5).integers(0, 46, 9000)
    near = np.full((9000, lm_scoring.CONTEXT), 46, np.int32)
    p = lm_scoring.Parameters.start(lex)
    whole = lm_scoring.log10_units(p, lex, units, near)
    assert max(rows) <= 2048 and sum(rows) >= 9000
    # far scores are shifted
    p.k[3] += 500
    far = 10 ** lm_scoring.log10_units(p, lex, np.arange(46), near[:46])
    assert np.isfinite(whole).all() and abs(far.sum() - 1) < 1e-4


def test_lm_rare_words_come_once():
    """Words that tasks don't know leave once for each text, with how often they occur there; all texts' contexts end at their beginnings."""
    pa, lex = lm_scoring.pa, small_lexicon()
    end = lm_scoring.Lexicon(**vars(lex) | {"keys": np.array([lm_scoring.END]), "logs": np.array([0.5]), "units": np.array([2])})
    batch = pa.record_batch([pa.array([{"doc_id": i} for i in range(4)]), pa.array(["b a b b", "", None, "A c\ta"])], ["row", "text"])
    got = pa.Table.from_batches(lm_scoring._unit_rows(type("Shared", (), {"value": end}))(iter([batch]))).to_pydict()
    assert [sorted(x) for x in got["times"]] == [[1, 3], [], [], [1, 2]] and [len(set(x)) for x in got["rest"]] == [2, 0, 0, 2]
    assert got["known"] == [1, 1, 1, 1] and got["n_tokens"] == [5, 1, 1, 4]
    a, b = (dict(zip(got["rest"][i], got["times"][i], strict=True)) for i in (0, 3))
    assert [(a[k], b[k]) for k in a.keys() & b.keys()] == [(1, 2)]
    units, bounds = np.arange(20, 32), np.array([0, 1, 2, 8, 12])
    near = lm_scoring.contexts(units, bounds, 99)
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(x, y):
            assert near[i].tolist() == [units[i - k] if i - k >= x else 99 for k in range(1, lm_scoring.CONTEXT + 1)]


def test_lm_scores_ignore_partitions_and_case(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 2000)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(120).collect() + [(10_000, "THE the The thE " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in lm_scoring.score_texts(docs.repartition(k)).collect()} for k in (2, 9))
    assert one.keys() == two.keys() and all(abs(two[i] - x) < 1e-4 * abs(x) for i, x in one.items())
    _, forms, _ = lm_scoring.tokens(next(lm_scoring.blocks(lm_scoring.pa.array(["THE the The thE"]))))
    assert len(set(forms[:4].tolist())) == 1


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_neighbours(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    x, y = by[10], dict((r[0], r[1]) for r in ROWS)
    m = len(y[10]) // 3
    assert x.edited_sha256 == hashlib.sha256((y[10][: len(y[10]) - m] + y[9][:m]).encode()).hexdigest()
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0 and by[4].n_chars == 0
    assert fingerprints.fingerprint_neighbours(empty).collect() == []
    # each row against plain MinHash, and likenesses against true similarities
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (row, after) in enumerate(zip(order, order[1:] + order[:1], strict=True)):
        if row[0] in (2, None) or after[0] is None or row[0] == 3:
            continue
        text, other = row[1] or "", after[1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + other[:m]
        r = by[row[0]]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        a, b = shingle_set(text), shingle_set(edited)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
    assert {(r.doc_id, r.class_id) for r in fingerprints.near_duplicates(docs).collect()} == {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}


def test_minima_are_plain_minhash():
    texts = ["one two three four five six seven", "", "a b", "x " * 50]
    got = fingerprints.minima(lm_scoring.pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        values = [s for b in fingerprints.blocks(lm_scoring.pa.array([text])) for s in fingerprints.shingle_sets(b)][0]
        assert len(values) == len(shingle_set(text))
        for k in (0, 1, 100, 255):
            want = min(((int(fingerprints._A[k]) * int(v) + int(fingerprints._B[k])) % 2**64 for v in values), default=2**64 - 1)
            assert int(row[k]) == want


def test_fingerprints_take_long_batches_in_pieces(monkeypatch):
    """What a worker holds does not grow with the rows of a batch; no row is lost at a seam."""
    pa, seen, digests = lm_scoring.pa, [], fingerprints.digests
    monkeypatch.setattr(fingerprints, "digests", lambda least: seen.append(len(least)) or digests(least))
    n = 1801
    texts = [f"one{i} two three four five six" if i % 9 else "" for i in range(n)]
    batch = pa.record_batch([pa.array(texts), pa.array(range(n, 0, -1)), pa.array([0] * n), pa.array([False] * (n - 1) + [True])], ["text", "doc_id", "range", "copy"])
    got = [x for b in fingerprints._neighbours(iter([batch])) for x in b["doc_id"].to_pylist()]
    assert got == list(range(n, 1, -1)) and max(seen) < 1000


def test_bands_read_texts_in_one_pass():
    pa = lm_scoring.pa
    texts = ["a b c d e f g", None, "", "a b"]
    got = [(k, x, n) for b in fingerprints._bands(None)(iter([pa.record_batch([pa.array(texts)], ["text"])])) for k, x, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    sets = [s for b in fingerprints.blocks(pa.array(texts)) for s in fingerprints.shingle_sets(b)]
    assert [(x, n) for _, x, n in got] == [(fingerprints.signature(s), len(s)) for s in sets if len(s) for _ in range(fingerprints.BANDS)]


def test_sharding_groups(spark):
    """Equal texts stay together unless no shard could hold them; null and repeated ids are dealt like others; sizes and checksums are right."""
    big = [(None, "z" * 700)] * 120 + [(5, "y" * 90)] * 60
    rows = [*big, *((i, f"t{i} " * (1 + i % 9)) for i in range(100, 900)), (None, None), (1, "")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    want = collections.Counter((None if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((None if np.isnan(i) else int(i), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() / loads.mean() < 1.05
    shards = got.groupby("text_crc32").shard.nunique()
    assert shards[zlib.crc32(b"z" * 700)] > 1 and (shards.drop(zlib.crc32(b"z" * 700)) == 1).all()
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))


def test_sharding_cuts_by_bytes_only(spark):
    """Many light rows of one text stay together; a text of 30 % of the bytes lies in the three shards that can hold it."""
    rows = [(i, None if i % 2 else "") for i in range(200)] + [(1000 + i, f"t{i} " * 100) for i in range(1000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    heavy = [(i, "h" * 1000) for i in range(300)]
    got = sharding.assign_shards(spark.createDataFrame(heavy + [(1000 + i, f"{i:04}" * 250) for i in range(700)], "doc_id long, text string").repartition(5), 8).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert got[got.text_crc32 == zlib.crc32(b"h" * 1000)].shard.nunique() == 3 and loads.max() / loads.mean() < 1.02


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, 3).collect()
    assert len(got) == len(ROWS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign_shards(empty, 3).collect() == []
    sizes = np.random.default_rng(1).integers(1, 100, (500, 3)).astype(float)
    loads = np.array([sizes[sharding.place(sizes, 8) == k].sum(axis=0) for k in range(8)])
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.03).all()


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken - per.target) <= 0.51).all()
    assert mixing.mix_sources(empty).collect() == []
    mine = ["_mix_key", "_mix_times", "_Mix_Rows"]
    out = mixing.copies(docs.withColumns({c: F.lit("mine") for c in mine}))
    assert out.columns == [*docs.columns, *mine] and {tuple(r[c] for c in mine) for r in out.collect()} == {("mine",) * 3}
    times = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert set(times) <= {(r[0], r[1]) for r in ROWS} and max(times.values()) <= 4
    assert mixing.copies(empty).collect() == []


def test_mixing_targets_and_tilts(spark):
    """Targets against plain water filling, and sources near them with a small dual gradient."""
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 400)), [None, "a", "b", "c", "d"][min(4, i % 13)]) for i in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted([s for s in size if s], key=str) + [None]
    weight, left, want = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in want]
        level = (left - sum(want.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2 * size[s] for s in over}
    for s, x in got.groupby(got.source.fillna("-")):
        s = None if s == "-" else s
        assert abs(x.target.iloc[0] - want[s]) < 1e-6 * want[s] and x.source_size.iloc[0] == size[s]
        assert abs(x.taken.sum() - want[s]) <= 1 and (x.taken <= 2 * x["size"]).all() and x.dual_gap.max() < 1e-6
        # rates are those of a plain solver: exp(t * size) within the bound, t by halving
        z, low, high = x["size"].to_numpy(float) / x["size"].mean(), -400.0, 400.0
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if (x["size"] * np.minimum(2, np.exp(np.minimum(t * z, 1)))).sum() < want[s] else (low, t)
        assert np.abs(x.rate - np.minimum(2, np.exp(np.minimum(low * z, 1)))).max() < 1e-4
        if want[s] < 1.99 * size[s]:
            assert x.rate.nunique() > 10


def test_mixing_extreme_targets(spark):
    """Sources of one size, of very different sizes and with a target far below or at the bound meet their targets all the same."""
    rows = [(i, "w " * 7, "a") for i in range(50)] + [(100 + i, "w " * (1 if i else 60_000), "b") for i in range(400)] + [(1000 + i, "w " * (i % 90 + 1), "c") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((3.0, 1.0, 2.0), (0.001, 5.0, 0.002), (9.0, 0.0001, 9.0)):
        got = mixing.mix_sources(docs, weights=weights).toPandas()
        for _, x in got.groupby("source"):
            assert abs(x.taken.sum() - x.target.iloc[0]) <= 1 and (x.taken <= 2 * x["size"]).all() and x.dual_gap.max() < 1e-6 and x.rate.max() <= 2


def test_packing(docs, empty):
    got = packing.pack_documents(docs).toPandas()
    per = got.groupby("sequence_id").agg(n=("length", "sum"), first=("offset", "min"))
    assert per.n.max() <= 2048 and (per["first"] == 0).all()
    encode = packing.Encoder()
    for i, text in ((9, ROWS[10][1]), (10, ROWS[11][1]), (4, "")):
        ids = np.append(np.array(encode.full.encode(text, add_special_tokens=False).ids, np.uint32), np.uint32(1))
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for r in mine.itertuples())
    assert packing.pack_documents(empty).collect() == []


def test_packing_tiny_documents(spark):
    """Documents of one token fill sequences: there is no limit on pieces."""
    got = packing.pack_documents(spark.createDataFrame([(i, "") for i in range(5000)], "doc_id long, text string").coalesce(1)).toPandas()
    per = got.groupby("sequence_id").length.sum().sort_values()
    assert per.tolist() == [5000 - 2 * 2048, 2048, 2048]
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x.offset.tolist() == [0, *x.length.cumsum()[:-1]]


def test_encoders_agree():
    """Ids are those of the tokenizers library on every document of a table."""
    import pyarrow.parquet as pq

    encode = packing.Encoder()
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert encode(text or "").tolist() == encode.full.encode(text or "", add_special_tokens=False).ids


def test_packing_instructions():
    """Limits on tokens, segments and loss-bearing tokens hold together when nothing may be cut."""
    rng = np.random.default_rng(2)
    packer = packing.Packer(0, (100, 4, 50), cut=False)
    for i in range(300):
        n = int(rng.integers(1, 60))
        packer.add(packing.Example(i, np.arange(n, dtype=np.uint32), 0, rng.random(n) < 0.4))
    packer.finish()
    per = collections.defaultdict(list)
    for p in packer.done:
        per[p[5]].append(p)
    assert sorted(p[0] for p in packer.done) == list(range(300))
    assert all(sum(p[2] for p in x) <= 100 and len(x) <= 4 for x in per.values())


def test_packing_masked_rows(spark):
    """Rows of ids and masks are packed under all three limits; only what fits no sequence is cut, and nothing is lost."""
    rng = np.random.default_rng(3)
    ids = {i: rng.integers(0, 50_000, int(rng.integers(1, 60))).tolist() for i in range(300)} | {300: list(range(250)), 301: list(range(80)), 302: [], 303: [7] * 30}
    masks = {i: (rng.random(len(x)) < 0.7).tolist() for i, x in ids.items()} | {301: [True] * 80, 303: None}
    rows = spark.createDataFrame([(i, ids[i], masks[i]) for i in ids] + [(304, None, None)], "doc_id long, ids array<int>, learned array<boolean>")
    got = packing.pack_masked(rows, (100, 4, 50)).toPandas()
    per = got.groupby("sequence_id").agg(n=("length", "sum"), parts=("doc_id", "size"), learned=("learned", "sum"))
    assert per.n.max() <= 100 and per.parts.max() <= 4 and 45 <= per.learned.max() <= 50
    assert set(got.doc_id) == set(ids) - {302}
    for i, x in got.groupby("doc_id"):
        x = x.sort_values("start")
        mask = masks[i] or [True] * len(ids[i])
        assert len(x) == 1 or len(ids[i]) > 100 or sum(mask) > 50
        assert x.start.tolist() == [0, *x.length.cumsum()[:-1]] and x.length.sum() == len(ids[i])
        for r in x.itertuples():
            part = slice(r.start, r.start + r.length)
            assert r.learned == sum(mask[part]) and r.ids_crc32 == zlib.crc32(np.array(ids[i][part], "<u4").tobytes())


def test_line_rules(spark, docs, empty):
    got = line_rules.line_rules(docs).collect()
    assert len(got) == len(ROWS) and all(not r.kept for r in got if r.base_failed)
    assert line_rules.line_rules(empty).collect() == []
    rows = [(i, f"{'same words in every one of these lines ' * 8}\nunlike {i} {' '.join(f'w{i}x{k}' for k in range(15 if i else 90))}", "h") for i in range(60)]
    kept = {r.doc_id: r.kept for r in line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept[0] and not any(r for i, r in kept.items() if i)
    assert line_rules.without_rejected(docs).columns == docs.columns


def test_common_lines_of_a_large_host(spark):
    """The same lines in as many documents get the same verdict in a small and in a large host."""
    own = lambda i, n: " ".join(f"{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(n))  # noqa: E731  digits are alike in lines
    rows = [(i, f"{own('common', 60)}\n{own(i, 15 if i % 10_000 else 90)}", f"h{i // 10_000}") for i in (*range(30), *range(10_000, 10_030))] + [(i, own(i, 60), "h1") for i in range(20_000, 23_500)]
    kept = [r.doc_id for r in line_rules.without_rejected(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id").collect()]
    assert sorted(i for i in kept if i < 20_000) == [0, 10_000] and len(kept) == 3502


def test_repeated_rows_count_once(spark, tmp_path):
    """21 rows of one document and another with the same text are two documents; query and SQL agree on them."""
    text = "\n".join(" ".join(f"l{chr(97 + k)}{chr(97 + j)}" for j in range(12)) for k in range(6))
    rows = [(1, text, "a")] * 21 + [(2, text, "a")] + [(100 + i, text + f"\n{'own ' * 3}", "b") for i in range(22)] + [(100, text + f"\n{'own ' * 3}", "b")] * 3
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = line_rules.op7_quality_rules(spark, str(tmp_path)).toPandas()
    assert got[got.doc_id < 100].kept.all() and got[got.doc_id == 100].kept.all() and not got[got.doc_id > 100].kept.any()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(line_rules.ORACLE_SQL).df()[list(got.columns)]
    order = ["doc_id", "n_words_left"]
    assert got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()


def test_copies_and_nulls_count_as_documents(spark):
    """A line of 30 copies is in 30 documents; the first keeps its text. Null and empty texts are alike, and clashing columns stay."""
    text = "\n".join(" ".join(f"l{chr(97 + k)}{chr(97 + j)}" for j in range(12)) for k in range(6))
    docs = spark.createDataFrame([(i, text, "a", "x") for i in range(30)] + [(100, None, "a", "y"), (101, "", None, "z")], "doc_id long, text string, source string, _rule_key string")
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    assert [i for i, r in got.items() if r.kept] == [0] and got[100].n_words == got[101].n_words == 0 and got[100].base_failed
    left = line_rules.without_rejected(docs).collect()
    assert [(r.doc_id, r.text, r._rule_key) for r in left] == [(0, text, "x")]
    assert line_rules.without_rejected(docs.limit(0)).collect() == []


def test_common_lines_are_cut(spark):
    """Kept documents lose the lines that n_words_left leaves out, the first document keeps them, and n_chars follows."""
    own = lambda i, n: " ".join(f"{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(n))
    licence = ["Licence 1 of all the rights", "ähnlich in all of them 5"]
    text = lambda i: f"\n{licence[0]}\n{own(i, 40)}\n\n{licence[0].upper().replace('1', '7')}  \n{own(-i - 1, 40)}\n{licence[1]}" + "\n" * (i % 2)
    docs = spark.createDataFrame([(i, text(i), 1, "x", None) for i in [*range(30), 29]] + [(50, None, 1, "x", None)], "doc_id long, text string, n_chars int, note string, source string")
    got = line_rules.without_rejected(docs).collect()
    want = {i: f"\n{own(i, 40)}\n\n{own(-i - 1, 40)}" + "\n" * (i % 2) for i in range(1, 30)} | {0: text(0)}
    assert sorted(r.doc_id for r in got) == [*range(30), 29] and all(r.text == want[r.doc_id] and r.note == "x" and r.source is None for r in got)
    assert all(r.n_chars == (len(r.text) if r.doc_id else 1) for r in got)
    left = {r.doc_id: r.n_words_left for r in line_rules.line_rules(docs).collect()}
    assert all(len(words(r.text)) == left[r.doc_id] for r in got)


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x"), (2, "http://example.net/de/"), (3, "http://fakenet/"), (4, None), (5, "no scheme"), (6, "x://h.example.com/de/?q"), (7, "http://m.casino-win.org/a"), (7, "http://m.casino-win.org/a"), (8, "http://x.net")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.standard_rules(spark)).collect()}
    assert got == {(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "fakenet", "/", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
                   (6, "h.example.com", "/de/", "example.com/de/", "block"), (7, "m.casino-win.org", "/a", None, "block"), (8, "x.net", "", None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), url_filter.standard_rules(spark)).collect() == []


def test_url_rule_tables(spark):
    """Rules read as text: sites, words and bare expressions, of which one without a literal token is run on every URL."""
    lines = spark.createDataFrame([("example.com/de/", "block"), (" *casino* ", "block"), ("/^[0-9.]+/", "block"), ("# note", "block"), (None, "block"), ("a+b.org/x.y", "block")], "rule string, verdict string")
    urls = ["http://10.0.0.1/x", "http://sub.example.com/de/q", "http://the-casino.io", "http://ok.org/", "http://a+b.org/x.yz", "http://a+b.org/xzy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.judge_urls(pages, url_filter.rule_table(lines)).collect()}
    assert got == {0: ("block", None), 1: ("block", "example.com/de/"), 2: ("block", None), 3: ("allow", None), 4: ("block", "a+b.org/x.y"), 5: ("allow", None)}


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "####", "<</turn>", "", None, "a\\", "é😀\n: x"]
    rows = [(i % 3 if i else None, k, role, t, "x") for i in range(4) for k, t in enumerate(texts) for role in ("user", "assistant")]
    frame = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn int, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    for c in (None, 0, 1, 2):
        mine = sorted(((r[1], r[2], r[3] or "") for r in [*rows, rows[0]] if r[0] == c))
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        loss = "".join(t for _, r, t in mine if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(frame.limit(0))).collect() == []


def test_toxicity(spark, docs, empty):
    """Separates documents with marked words on held-out rows, and scores odd rows."""
    rng = np.random.default_rng(4)
    text = lambda i: " ".join([*(f"w{k}" for k in rng.integers(0, 400, 60)), *(["vile", "nasty"] if i % 5 == 1 else [])])
    many = spark.createDataFrame([(i, text(i)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 5 == 1 else 0) for i in range(0, 2000, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(many, labels)
    got = toxicity.score(many, model).toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 5 == 1)).mean() > 0.98
    odd = toxicity.score(docs.withColumn("Score", F.lit("mine")), model).collect()
    assert odd[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "name", "score"}
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit(docs, labels.limit(0)).model is None and toxicity.score(empty, model).collect() == []
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_with_more_labels_than_the_sample(spark, monkeypatch):
    """A feature's least count follows the positives in the bounded sample, not all toxic labels."""
    monkeypatch.setattr(toxicity, "POSITIVES", 20)
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('w', id % 97, ' v', id % 89, if(id % 2 = 1, ' vile nasty', '')) AS text")
    model = toxicity.fit(many, many.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic"))
    got = toxicity.score(many, model).selectExpr("avg(CAST((score >= 0.5) = (doc_id % 2 = 1) AS int)) AS right").first()
    assert len(model.keys) and got.right > 0.98


def test_toxicity_slopes():
    """Steps follow the non-negative risk's gradient, or climb its second part where that is below zero."""
    rng = np.random.default_rng(3)
    for shift in (-1.0, 2.0):
        is_p = np.arange(40) < 15
        z = rng.normal(size=40) + np.where(is_p, shift, -2 * shift)
        s = lambda z: 1 / (1 + np.exp(-z))
        second = lambda z: s(z[~is_p]).mean() - 0.4 * s(z[is_p]).mean()
        risk = (lambda z: 0.4 * (1 - s(z[is_p])).mean() + second(z)) if second(z) >= 0 else (lambda z: -second(z))
        got = toxicity.slopes(z, is_p, 0.4)
        for k in range(40):
            step = np.eye(40)[k] * 1e-5
            assert abs((risk(z + step) - risk(z - step)) / 2e-5 - got[k]) < 1e-7


@pytest.mark.parametrize("labelled", [5, 2, 1])
def test_toxicity_prior_of_all_documents(spark, labelled):
    """Of 30 % toxic documents about as many are predicted, whatever the share of labelled ones."""
    text = "concat('w', id % 97, ' v', id % 89, ' u', id % 7, if(id % 10 < 3, concat(' vile', id % 3, ' nasty', id % 4), ''))"
    many = spark.range(12_000).selectExpr("id AS doc_id", f"{text} AS text")
    labels = many.where(f"xxhash64(doc_id) % {labelled} = 0").selectExpr("doc_id", "CAST(doc_id % 10 < 3 AS int) AS toxic")
    share = toxicity.score(many, toxicity.fit(many, labels)).selectExpr("avg(CAST(score >= 0.5 AS int)) AS s").first().s
    assert 0.28 < share < 0.32


def test_joined_sets(monkeypatch):
    """Groups without counts are those of all pairs, in one side or between two, by pivots alone or with all pairs."""
    rng = np.random.default_rng(6)
    for outside in (0, 3, 48):
        monkeypatch.setattr(linkage, "OUTSIDE", outside)
        for _ in range(30):
            k = int(rng.integers(3, 40))
            bases = [rng.choice(1000, 40, replace=False) for _ in range(3)]
            sets = []
            for _ in range(k):
                b = bases[int(rng.integers(3))]
                sets.append(np.unique(np.concatenate([b[: int(rng.integers(30, 41))], rng.choice(1000, int(rng.integers(0, 9)))])).astype(np.uint64))
            side = rng.integers(0, 2, k) if rng.random() < 0.5 else np.zeros(k, int)
            order = np.argsort(side, kind="stable")
            sets, side, names = [sets[i] for i in order], side[order], list(range(10, 10 + k))
            told = [linkage._cell(names, sets, [1] * k, side.tolist(), True, counted) for counted in (True, False)]
            first, second = ({} if t is None else dict(zip(t["name"].to_pylist(), t["component"].to_pylist())) for t in told)
            assert first == second


def test_classes(spark):
    """What is told of a key is its class; keys that share a slot with another class are left open, and most are not."""
    keys = spark.range(3000).selectExpr("xxhash64(id) AS v", "CAST(id % 3 AS int) AS c")
    told = workspace.Classes(keys, 3).told(keys.withColumn("_page", F.lit("mine")), F.col("v"), "got")
    assert told.columns == ["v", "c", "_page", "got"]
    rows = told.collect()
    assert len(rows) == 3000 and all(r.got in (r.c, -1) for r in rows) and sum(r.got == -1 for r in rows) < 450
    clash = spark.createDataFrame([(5, 0), (5 + workspace._PAGE, 1), (6, 1)], "v long, c int")
    assert {r.v: r.got for r in workspace.Classes(clash, 2).told(clash, F.col("v"), "got").collect()} == {5: -1, 5 + workspace._PAGE: -1, 6: 1}
    assert workspace.Classes(keys.limit(0), 3).told(keys.limit(0), F.col("v"), "got").collect() == []


def shuffled(spark, run):
    """What a run gives, and the bytes that it shuffles where no table is small enough to be broadcast unasked."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total()
        got = run().collect()
        return got, total() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stages_shuffle_few_texts(spark):
    """Texts stay where they are read while sources are mixed, near copies go and common lines are cut."""
    own = lambda i, n: " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(n))
    text = lambda i: f"{own(i, 60)}\nall of them have this line\n{own(-i - 1, 60)}"
    docs = spark.createDataFrame([(i, text(i), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string").repartition(4).localCheckpoint()
    size = docs.selectExpr("sum(length(text)) AS n").first().n
    got, n = shuffled(spark, lambda: mixing.copies(docs))
    assert n < size / 4 and {r.text for r in got} <= {text(i) for i in range(400)}
    got, n = shuffled(spark, lambda: line_rules.without_rejected(docs))
    assert n < size / 4 and sorted((r.doc_id, r.text) for r in got) == [(i, text(i) if i < 2 else text(i).replace("all of them have this line\n", "")) for i in range(400)]


def test_cut_lines_with_many_common_ones(spark, monkeypatch):
    """Where the common lines are too many to be known to all tasks, the same are cut."""
    text = lambda i: "\n".join([" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(26)), "one common line", "one more of them", "", " ".join(f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(26))])
    docs = spark.createDataFrame([(i, text(i), 5, "a" if i % 3 else None) for i in range(120)], "doc_id long, text string, n_chars long, source string")
    told = [sorted(tuple(r) for r in line_rules.without_rejected(docs).collect()) for limit in (1 << 20, 1) if not monkeypatch.setattr(line_rules, "COMMON_LIMIT", limit)]
    assert told[0] == told[1] and len(told[0]) == 120 and sum("common" in r[1] for r in told[0]) == 2


def test_fingerprints_are_not_shuffled(spark, docs):
    """Classes come to the rows with the texts: nothing is shuffled once fingerprints are made. Repeated rows, null ids and texts keep theirs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = fingerprints.fingerprints(docs)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")]
        want = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in fingerprints.near_duplicates(docs).collect())
        assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in made.collect()) == want and any(n for _, _, n in want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert fingerprints.fingerprints(docs.limit(0)).collect() == []
