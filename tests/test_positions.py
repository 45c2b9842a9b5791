"""Rows, values and amounts by position, against plain loops and comparison of each with each."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from folioflow.operators import positions


def frame(spark, rows):
    return spark.createDataFrame(rows, "page long, n long, text string, x int, y int, w int, h int").repartition(5)


def plain_rows(tokens, kind, height=1400):
    within = positions.tolerance(kind, height)
    at = lambda t: t[4] + t[6] // 2 if kind == "mean" else t[4]
    order = sorted(tokens, key=(lambda t: (at(t), t[1])) if kind == "mean" else (lambda t: (t[4], t[3], t[1])))
    rows = []
    for t in order:
        if rows:
            ys = [at(u) for u in rows[-1]]
            middle = sum(ys) // len(ys) if kind == "mean" else int(statistics.median(ys))
            if abs(at(t) - middle) <= within:
                rows[-1].append(t)
                continue
        rows.append([t])
    return [" ".join(t[2] for t in sorted(r, key=lambda t: t[3])) for r in rows]


@pytest.mark.parametrize("kind", ["median", "mean", "line"])
def test_page_rows(spark, kind):
    """Drifting lines, equal places and distances of exactly the tolerance."""
    rng = random.Random(kind)
    tokens = [(p, n, f"t{n}", rng.randrange(0, 900, 30), rng.choice([0, 16, 32, 14, 28, 21, rng.randrange(200)]), 10, rng.choice([0, 9, 10])) for p in range(12) for n in range(rng.randrange(1, 40))]
    got = positions.page_rows(frame(spark, [*tokens, (3, 99, None, 1, 1, 1, 1), (4, 99, "lost", None, 1, 1, 1), (77, 1, "lost", 1, None, 1, 1)]), kind).collect()
    for p in range(12):
        mine = sorted((r.row, r.text) for r in got if r.page == p)
        assert [t for _, t in mine] == plain_rows([t for t in tokens if t[0] == p], kind)
    assert {r.page for r in got} == set(range(12)) and positions.page_rows(frame(spark, []), kind).collect() == []


def test_values_at_cell_borders(spark):
    """Nearest numbers with windows that end exactly at a border of the grid, against comparing each with each."""
    rng = random.Random(2)
    names = ["Glycémie", "tsh", "crp", "Urée", "Créatinine us"]
    tokens, n = [], 0
    for p in range(40):
        for k in range(rng.randrange(1, 5)):
            y = rng.choice([71, 72, 73, 143, 144, 145, 170, 340, 0]) + 200 * k
            for text, x in ((rng.choice(names), 20), *((f"{rng.randrange(1, 99)},{rng.randrange(9)}", rng.choice([299, 300, 500, 680, 681])) for _ in range(2))):
                n += 1
                tokens.append((p, n, text, x, y if x == 20 else max(0, y + rng.choice([-171, -170, -73, -72, 0, 72, 73, 170])), 10, 10))
    got = {(r.page, r.label): (r.row, r.value) for r in positions.lab_values(frame(spark, tokens)).collect()}
    label = {"Glycémie": "Glycemie a jeun", "tsh": "Thyreostimuline (TSH)", "crp": "CRP", "Urée": "Uree", "Créatinine us": "Creatinine"}
    rows = {(r.page, r.row): r for r in positions.page_rows(frame(spark, tokens), "median").collect()}
    want = {}
    for (p, k), r in sorted(rows.items()):
        named = next((label[m] for m in ["Glycémie", "tsh", "Urée", "Créatinine us", "crp"] if m in r.text), None)
        if named is None or (p, named) in want:
            continue
        reach = 170 if named.startswith("Thyreo") else 72
        near = [(abs(t[4] - r.y), t[3], t[1], t[2]) for t in tokens if t[0] == p and abs(t[4] - r.y) <= reach and 300 <= t[3] <= 680]
        if near:
            want[p, named] = (k, min(near)[3].replace(",", "."))
    assert got == want and len(want) > 40


def test_no_cross_join(spark):
    for name in positions.QUERIES:
        plan = positions.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("text,unit,ref", [("mmol/1", "mmol/l", None), ("mUI/I", "mUI/l", None), ("g/l", "g/l", None), ("g/1", "g/l", None), ("%", "%", None), ("xx", None, None), ("450-120", None, "4.50-1.20"), ("4.5-12", None, "4.5-12"), ("٣,٥-٧", None, "3.5-7"), ("12a14", None, "12-14"), (None, None, None)])
def test_units_and_ranges(spark, text, unit, ref):
    got = spark.createDataFrame([(text,)], "t string").select(positions.clean_unit(F.col("t")).alias("u"), positions.reference_range(F.col("t")).alias("r")).first()
    assert (got.u, got.r) == (unit, ref)


def test_payment_amounts(spark):
    cases = {("12,500", "99,100", "1234"): "99,100", ("1234567", "12"): "1234,567", ("999", "12"): "999", ("45", "67"): "45", ("12,500", "12,500"): "12,500"}
    for ranked, want in cases.items():
        assert spark.createDataFrame([(list(ranked),)], "a array<string>").select(positions.payment_amount(F.col("a"))).first()[0] == want
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(positions.amount_candidates(F.col("t"))).first()[0]
    assert one("12.500 TND 77") == ["12,500", "12", "500", "77"]
    assert one("1O0,500") == ["100,500", "100", "500"] and one("7") == [] and one("123456789") == []


def test_amounts_near_keywords(spark):
    """Scores equal those of each amount with each keyword of its page; second keywords count only without first ones."""
    rng = random.Random(8)
    words = ["payer", "Montant", "12,500", "777", "4567", "x", "A PAYER:", "9,000 88"]
    tokens = [(p, n, rng.choice(words[(1 if p % 3 == 0 else 0):6 if p % 3 == 0 else 8]), rng.randrange(1000), rng.randrange(1400), 21, 11) for p in range(20) for n in range(12)]
    got = positions.amounts_near_keywords(frame(spark, tokens)).collect()
    for p in range(20):
        mine = [t for t in tokens if t[0] == p]
        keys = [t for t in mine if "payer" in t[2].lower()] or [t for t in mine if "montant" in t[2].lower()]
        want = []
        for t in sorted(mine, key=lambda t: t[1]):
            z = t[2].replace(" ", "").replace("O", "0").replace(".", ",")
            found = list(dict.fromkeys([*re.findall(r"\d{1,7},\d{3}", z), *re.findall(r"(?<!\d)\d{2,7}(?!\d)", z)]))
            near = min([1000, *(abs(t[4] + 5 - k[4] - 5) + abs(t[3] + 10 - k[3] - 10) // 4 for k in keys)])
            want += [(near - 150 * bool(re.fullmatch(r"\d{1,6},\d{3}", a)), a) for a in found]
        want.sort(key=lambda w: w[0])
        assert [(r.score, r.amount) for r in sorted((r for r in got if r.page == p), key=lambda r: r.rank)] == want


def test_lab_grid_deals_lines_out_once(spark):
    """One shuffle, of lines before they are words; no sort or join of words after it."""
    plan = positions.lab_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.index("posexplode(") < plan.index("Exchange hashpartitioning(l_orderkey")


def test_blocks_cut_no_page(monkeypatch):
    """Pages that lie over batches and blocks, one longer than a block, null numbers and equal places: the same rows as from one block."""
    import pyarrow as pa

    rng = random.Random(4)
    words = ["tsh", "CRP", "Urée", "12,5", "<7", "g/l", "mUI/I", "3-9", "120-450", "x", ""]
    rows = [(p, rng.choice([None, 1, 2]), rng.randrange(0, 1000, 100), rng.choice([0, 15, 16, 17, 72, 73, 170, -20, 18, 45]), rng.choice(words)) for p in range(30) for _ in range(300 if p == 11 else rng.randrange(1, 20))]
    whole = pa.table(list(zip(*rows, strict=True)), schema=pa.schema([("page", pa.int64()), ("n", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("text", pa.string())]))
    run = lambda size: [tuple(r.values()) for b in positions._blocks(1000, 1400)(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    want = run(10_000)
    monkeypatch.setattr(positions, "BLOCK", 50)
    assert run(7) == want and len(want) > 20


def test_word_rules_are_those_of_columns(spark):
    rng = random.Random(9)
    odd = ["12\n", "12\r", "7 ", " 4 a 5 ", "1A2", "<>3", "< 3", "٣,٥", "1234-12345", "450-1", "g / l", "G/L ", "mUl/I", "ui/l", "ngml", "%", "İtsh", "tsh_", "glycém-", "uréeß", " 5", "mg/dl\n", ""]
    texts = [*odd, *("".join(rng.choice("gl/mu1Iı0.,-aA %dоmo٣<") for _ in range(rng.randrange(1, 7))) for _ in range(3000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", positions.clean_unit(F.col("t")), positions.reference_range(F.col("t"))).collect()
    for i, unit, ref in got:
        assert positions.word_rules(texts[i])[2:] == (unit, ref), repr(texts[i])
    assert [positions.word_rules(t)[1] for t in ("<12,5", " 7 ", "12345", "1.2345", "n.d.", "٣,٥")] == ["12.5", " 7 ", None, None, None, "3.5"]
    bits = lambda t: positions.LABEL_OF[positions.word_rules(t)[0]]
    assert [positions.LABELS[bits(t)] if bits(t) >= 0 else None for t in ("GLYCÉMIE", "tsh", "tshx", "Cholestérol HDL total", "cholesterol", "crp-us", "Créatinine urée", "hdl")] == ["Glycemie a jeun", "Thyreostimuline (TSH)", None, "Cholesterol HDL", None, "CRP", "Uree", None]
