"""Matching of rows and its counters against a plain loop over each document."""

import random

from test_catalog import token_set_ratio

from folioflow.operators import matching

EMPTY = {"", "null", "none", "n/a", "na", "non detecte", "inconnu"}


def key(name):
    return "".join(c if c.isascii() and c.isalnum() else "" for c in (name or "").lower())


def plain(expected, predicted):
    """doc: (expected, correct, tp, fp, fn); values here are single numbers and units plain words."""
    out = {}
    spaced = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    for doc in {r[0] for r in expected + predicted}:
        first = {}
        for r in sorted(r for r in predicted if r[0] == doc):
            if key(r[2]):
                first.setdefault(key(r[2]), r)
        c, taken = [0, 0, 0, 0, 0], set()
        for _, _, name, value, unit in sorted((r for r in expected if r[0] == doc), key=str):
            if not key(name):
                continue
            c[0] += 1
            hit = key(name) if key(name) in first else None
            if hit is None:
                best = 0.0
                for k, r in first.items():
                    if (s := token_set_ratio(spaced(name), spaced(r[2]))) > best and s >= 0.90:
                        hit, best = k, s
            if hit is None:
                c[4] += 1
                continue
            taken.add(hit)
            got = first[hit]
            no_unit = (unit or "").lower() in EMPTY
            if abs(float(value) - float(got[3])) <= 0.01 and (no_unit or (got[4] or "").lower() == unit.lower()):
                c[1] += 1
                c[2] += 1
            else:
                c[3] += 1
                c[4] += 1
        c[3] += sum(1 for r in predicted if r[0] == doc and key(r[2]) and key(r[2]) not in taken)
        out[doc] = tuple(c)
    return out


def test_row_counters(spark):
    rng = random.Random(7)
    names = ["alpha beta", "Alpha-Beta", "beta alpha", "alphabeta gamma", "gamma", "gamma delta", "delta", "", " - ", None, "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilom"]
    rows = lambda: [(d, n, rng.choice(names), str(rng.choice([1, 2])), rng.choice(["kg", "KG", None, "n/a", "m"])) for d in range(60) for n in range(rng.randrange(6))]
    expected, predicted = rows(), rows()
    schema = "doc long, n long, name string, value string, unit string"
    got = matching.row_counters(spark.createDataFrame(expected, schema).repartition(3), spark.createDataFrame(predicted, schema)).collect()
    assert {r.doc: tuple(r)[1:] for r in got} == plain(expected, predicted)
    none = spark.createDataFrame([], schema)
    assert matching.row_counters(none, none).collect() == [] and matching.matched_rows(none, none).collect() == []


def exchanges(spark, query):
    return query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_eval_rows_deals_documents_out_once(spark):
    """Part names come to the lines, then these go to their documents; nothing is shuffled after that."""
    assert exchanges(spark, matching.eval_rows) <= 3


def test_documents_lie_over_blocks(spark, monkeypatch):
    """Documents over several batches and blocks, one longer than a block and its pairs taken in pieces; null documents count nothing."""
    import pyarrow as pa

    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "epsilom", "zeta"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "x", "-"])
    rows = [(d, rng.random() < 0.5, n, name(), str(rng.choice([1, 2])), rng.choice(["kg", "KG", None, "n/a", "m"])) for d in range(25) for n in range(200 if d == 9 else rng.randrange(1, 12))]
    expected, predicted = ([(d, n, a, v, u) for d, p, n, a, v, u in rows if p is kind] for kind in (False, True))
    whole = pa.table(list(zip(*[(None, False, 1, "alpha", "1", "kg"), (None, True, 2, "alpha", "1", "kg"), *rows], strict=True)), schema=pa.schema([("doc", pa.int64()), ("predicted", pa.bool_()), ("n", pa.int64()), ("name", pa.string()), ("value", pa.string()), ("unit", pa.string())]))
    want = plain(expected, predicted) | {None: (0, 0, 0, 0, 0)}
    for block, pairs in ((10_000, 10_000), (40, 10_000), (40, 3)):
        monkeypatch.setattr(matching, "BLOCK", block)
        monkeypatch.setattr(matching, "PAIRS", pairs)
        got = [r for b in matching._in_blocks(matching._count_block)(iter(whole.to_batches(max_chunksize=7))) for r in b.to_pylist()]
        assert len(got) == 26 and {r["doc"]: tuple(r.values())[1:] for r in got} == want
    schema = "doc string, n long, name string"
    two = spark.createDataFrame([("a", 1, "Beta alpha"), ("a", 2, "zz"), (None, 1, "x"), ("b", 1, " - ")], schema), spark.createDataFrame([("a", 1, "alpha beta"), ("b", 1, "zz")], schema)
    assert sorted(map(tuple, matching.matched_rows(*two).collect())) == [("a", 1, "alphabeta"), ("a", 2, None)]


def test_texts_match_as_columns_do(spark):
    """Ratios and matches of two texts inside a task are those of the column forms."""
    from folioflow.functions.similarity import token_set_ratio_of
    from folioflow.operators.payloads import texts_match, with_match

    rng = random.Random(12)
    odd = [None, "", " ", "n/a", "Null", "12,5 mg", "12.504", "1 2", "a1b22", "G / L", "g/l", "abcdef", "xabcdefy", "été", "ete", "beta alpha", "alpha beta", "alpha beta gamma delta", "alpha beta gamma delt", "-", "1.", "٣"]
    pairs = [(a, b) for a in odd for b in odd] + [tuple(" ".join("".join(rng.choice("abc1") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))) for _ in range(2)) for _ in range(300)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for amounts in (False, True):
        got = {r.i: r.match for r in with_match(frame, "a", "b", amounts=amounts).collect()}
        assert got == {i: texts_match(a, b, amounts) for i, (a, b) in enumerate(pairs)}
    assert all(abs(token_set_ratio_of(a, b) - (1.0 if a == b else token_set_ratio(a, b))) < 1e-12 for a, b in pairs[len(odd) ** 2 :])


def test_eval_row_rates_shuffles_only_counters_more(spark):
    """Beyond eval_rows: counters and orders for their join, and the sums."""
    assert exchanges(spark, matching.eval_row_rates) <= 6
