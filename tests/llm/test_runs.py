"""Periodic runs, SimHash groups and hard negatives against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import hard_negatives, periodic_runs, simhash
from folioflow.llm.textblocks import blocks

from test_operators import DATA, ROWS, SCHEMA, words

SPACE = " \t\n\v\f\r"


def plain_runs(w):
    """All runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def split(text):
    return [x for x in "".join(" " if c in SPACE else c for c in text or "").split(" ") if x]


def plain_planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, text):
    w = plain_planted(doc_id, split(text))
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def periodic_texts(seed, n, letters, size):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(size))]
        for _ in range(rng.randrange(3)):
            at, q = rng.randrange(len(w) + 1), rng.randrange(1, 6)
            piece = [f"w{rng.randrange(letters)}" for _ in range(q)]
            w[at:at] = (piece * rng.randrange(2, 9))[: rng.randrange(1, 30)]
        out.append(w)
    return out


@pytest.mark.parametrize("letters,size", [(2, 60), (3, 60), (30, 80)])
def test_runs_of(letters, size):
    for w in periodic_texts(letters, 150, letters, size):
        assert periodic_runs.runs_of(w) == plain_runs(w), w


def test_fibonacci_words_and_long_repeats():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.runs_of([*b]) == plain_runs([*b])
    assert periodic_runs.runs_of([7] * 30_000) == [(0, 30_000, 1)]
    assert periodic_runs.runs_of([1, 2, 3] * 4000) == [(0, 12_000, 3)]


def test_stretches_leave_out_no_run():
    texts = [" ".join(w) for w in periodic_texts(9, 200, 4, 80)] + ["", "a b " * 9]
    for block in blocks(pa.array(texts), 3000):
        _, runs, collapsed = periodic_runs._block(block)
        for k in range(len(block)):
            w = split(texts[block.first + k])
            assert sorted(runs[k], key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_end_positions(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PIECE", 4)
    rng = random.Random(1)
    places = rng.sample(range(1000), 200)
    mine = periodic_runs.EndPositions(places[0])
    for k, x in enumerate(places[1:], 1):
        told = sorted(places[:k])
        assert mine.add(x) == (max((y for y in told if y < x), default=None), min((y for y in told if y > x), default=None))
    assert list(mine) == sorted(places) and len(mine) == 200


def test_periodic_query(spark, tmp_path):
    """The query on odd rows and planted ones, against the rule by hand; repeated rows, nulls, very long and empty texts among them."""
    rng = random.Random(4)
    rows = [(*r[:2], r[5]) for r in ROWS if r[0] != 9] + [(i, " \n".join(rng.choice(["Der", "der", "été", "x", "漢字", "y1"]) for _ in range(rng.randrange(1, 70))), "x") for i in range(100, 220)]
    rows += [(500, "one \t two\nthree " * 40, "x"), (500, "one \t two\nthree " * 40, "x"), (9, "long " * 30 + "end", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i is not None and i < 500)


def test_find_runs_edges(spark):
    docs = spark.createDataFrame([*ROWS, (11, "a b c " * 40_000, "en", "c", 9, "x")], SCHEMA).withColumnRenamed("name", "row").withColumn("Collapsed", F.lit(1))
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "row", "runs", "collapsed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[9].collapsed == "long end" and [tuple(r) for r in got[9].runs] == [(0, 30_000, 1)]
    assert got[11].collapsed == "a b c" and [tuple(r) for r in got[11].runs] == [(0, 120_000, 3)]
    assert got[4].collapsed == got[5].collapsed == got[6].collapsed == "" and got[4].runs == [] and got[10].row == "x" and got[7].collapsed == "Two words"
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []


def plain_print(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_prints_are_plain_simhash(monkeypatch):
    texts = [r[1] for r in ROWS if r[0] != 9] + ["Ab cD " * 30, "é É x", "a b c", "one two three four", "one two three", " x\n" * 4]
    for limit in (1 << 16, 7):
        monkeypatch.setattr(simhash, "_HASHED", limit)
        got = [int(f) for b in blocks(pa.array(texts), 300) for f in simhash.prints(b)]
        assert got == [plain_print(t) for t in texts]


def near_prints(seed, n, balls):
    """Distinct fingerprints around a few centres, many of them at 3 to 5 bits."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(1 << 63), 1 << 63, balls)
    out = {0, -1}
    while len(out) < n:
        f = int(centres[rng.integers(balls)])
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            f ^= 1 << int(b) if b < 63 else -(1 << 63)
        out.add(f)
    return sorted(out)


def plain_groups(prints):
    v = np.array(prints, np.int64).view(np.uint64)
    linked = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    least = np.arange(len(v))
    while True:
        new = np.where(linked, least[None, :], least[:, None]).min(axis=1)
        if (new == least).all():
            return {prints[i]: prints[least[i]] for i in range(len(v))}
        least = new


def test_trie_pairs(monkeypatch):
    v = np.sort(np.array(near_prints(2, 700, 12), np.int64).view(np.uint64))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)) if i < j}
    root = (np.array([0]), np.array([len(v)]))
    for pairs, leaves in ((1 << 16, 32), (50, 1)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        monkeypatch.setattr(simhash, "LEAVES", leaves)
        got = [(int(i), int(j)) for a, b in simhash.trie_pairs(v, root, root, 0) for i, j in zip(a, b)]
        assert len(got) == len(want) and {(min(p), max(p)) for p in got} == want
    half = 300
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(v, (np.array([0]), np.array([half])), (np.array([half]), np.array([len(v)])), 0) for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in want if i < half <= j}


@pytest.mark.parametrize("most,rows", [(1 << 15, 1 << 17), (16, 50)])
def test_near_links(spark, monkeypatch, most, rows):
    """Groups of fingerprints by one node and by nodes cut into deeper ones, against comparing all pairs."""
    monkeypatch.setattr(simhash, "NODE_MOST", most)
    monkeypatch.setattr(simhash, "ROWS", rows)
    prints = near_prints(3, 900, 7)
    work = simhash.Workspace(spark, "t")
    links = simhash.near_links(spark.createDataFrame([(f,) for f in prints], "f long").repartition(5), work)
    got = {r.node: r.component for r in simhash.components(links, work, "c").collect()}
    want = plain_groups(prints)
    assert {f: got.get(f, f) for f in prints} == want and len(set(want.values())) < len(prints)


def test_near_groups(spark):
    """Documents against comparing all fingerprints; copies, nulls, empty and odd rows among them."""
    texts = [t for (t,) in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    rows = [(r[0], r[1], r[5]) for r in ROWS] + [(100 + i, t, "x") for i, t in enumerate(texts)] + [(200 + i, t + " more", "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f string").repartition(4)
    got = simhash.near_groups(docs).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    linked = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if linked[i][j]) for i in range(len(rows))]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows))), key=str)
    assert simhash.near_groups(docs.limit(0)).collect() == []


def plain_negatives(rows):
    rows = sorted({i: (label, v) for i, label, v in rows}.items())
    out = []
    for a, (label, v) in rows:
        if a % 100:
            continue
        score = {i: sum(int(x) * int(y) for x, y in zip(v, u)) for i, (_, u) in rows}
        order = sorted((i for i, _ in rows if i != a), key=lambda i: (-score[i], i))
        kinds = dict(rows)
        for p in [i for i in order if kinds[i][0] == label][:5]:
            found = [i for i in order if kinds[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,anchors,chunk", [(4096, 256, 32), (7, 2, 3)])
def test_hard_negatives(spark, monkeypatch, tile, anchors, chunk):
    """Against sorting all scores; small tiles and chunks make many partial sums. Many scores are equal, some vectors short, and components are large in one of two runs."""
    for name, value in (("TILE_ROWS", tile), ("TILE_ANCHORS", anchors), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(tile)
    big = 1 if tile > 100 else 1 << 24
    rows = [(int(i), int(rng.integers(0, 4)), [int(x) * big for x in rng.integers(-2, 6, 8 if i % 9 else 5)]) for i in rng.permutation(700)[:350]] + [(-100, 2, [3 * big] * 8), (100, 1, [big] * 8), (200, 9, [big] * 8)]
    rows = list({r[0]: r for r in rows}.values())
    frame = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(5)
    got = hard_negatives.hard_negatives(frame, frame.where("vec_id % 100 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows) != []
    assert hard_negatives.hard_negatives(frame.limit(0), frame.limit(0)).collect() == []


def test_vectors_that_take_part(spark):
    rows = [(1, 2, [0.5, -0.001]), (1, 2, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 1, [float("nan")]), (6, 1, [float("inf")]), (7, 1, []), (None, 1, [1.0]), (8, 3, [1.0]), (8, 3, [0.0])]
    got = hard_negatives.whole_rows(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, r string"))
    assert sorted((r.vec_id, r.label, r.v) for r in got.collect()) == [(1, 2, [128, -1]), (7, 1, []), (8, 3, [0])]
