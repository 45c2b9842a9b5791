"""Matches with their places and rules over distances, against plain loops over the same patterns."""

import random
import re

from pyspark.sql import functions as F

from folioflow.operators import windows as w

EASTERN = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def test_match_spans(spark):
    rng = random.Random(1)
    texts = ["", None, "aXbXX", "é1 22😀333", *("".join(rng.choice("a1 é-") for _ in range(rng.randrange(30))) for _ in range(60))]
    for pattern in (r"\d+", "X", "[a1]{2}", "1.?-"):
        got = {r.id: r.s for r in frame(spark, texts).select("id", w.match_spans(F.col("text"), pattern).alias("s")).collect()}
        for i, t in enumerate(texts):
            if t is None:
                assert got[i] is None
            elif "😀" not in t:  # characters beyond 16 bits count as Spark counts them
                assert [tuple(x) for x in got[i]] == [(*m.span(), m[0]) for m in re.finditer(pattern, t)]


def iso(y, m, d, low=2000, high=2099):
    return f"{y:04}-{m:02}-{d:02}" if 1 <= m <= 12 and 1 <= d <= 31 and low <= y <= high else None


def ok(x):
    return x if x and 2012 <= int(x[:4]) <= 2038 else None


def first(s):
    for m in re.finditer(w.YMD, s):
        if x := iso(*map(int, m.groups())):
            return x
    m = re.search(w.COMPACT, re.sub(r"\s+", "", s))
    return iso(*map(int, m.groups())) if m else None


def plain_deadline(text):
    text = text.translate(EASTERN)
    flat = re.sub(r"\s+", " ", text)
    for p in w.LABELLED:
        m = re.search(p, flat, re.I)
        if m and (x := ok(first(flat[m.end() : m.end() + 45]))):
            return x, "labelled", None
    for m in re.finditer(w.YMD_STRICT, flat):
        if re.search(w.PAYMENT, flat[max(0, m.start() - 120) : m.end() + 8], re.I) and (x := ok(iso(*map(int, m.groups())))):
            return x, "look back", m.start()
    if re.search(w.ARABIC_PAYMENT, text) and (x := ok(first(text))):
        return x, "any", None
    return None, None, None


def plain_band(text):
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    found = []
    for i in range(len(lines)):
        block = " ".join(lines[max(0, i - 1) : i + 3]).translate(EASTERN)
        if re.search(w.BAND_WORDS, block, re.I):
            found += [x for x in (plain_deadline(block)[0], ok(first(block))) if x]
    return max(found, key=found.count) if found else None


def noisy(seed, n):
    rng = random.Random(seed)
    words = ["payer", "Prière de payer avant le", "avant le :", "PAYERAVANTLE", "montant", "قبل", "الدفع", "total", "x" * 45, "y" * 119, "z" * 30, "2024-05-06", "2025 . 1 . 2", "20260314", "201٥/٣/٤", "2005-01-01", "2024-13-40", "2031,7,8", "202605091", "le", "prelevement", "06/05/2021"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "\n", "\t", " "]) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_deadlines(spark):
    """Labels, windows of exactly 45, 120 and 8 characters, and Arabic words, on texts in which they overlap."""
    texts = [*noisy(5, 400), "payer" + "x" * 114 + " 2024-05-06", "payer" + "x" * 115 + " 2024-05-06", "payer" + "x" * 116 + " 2024-05-06", "2024-05-06 xxx payer", "2024-05-06 xx avant", "2024-05-06 avant", ""]
    got = {r.id: (r.deadline, r.rule, r["at"]) for r in w.with_deadline(frame(spark, texts), "text").collect()}
    want = {i: plain_deadline(t) for i, t in enumerate(texts)}
    assert got == want and {r for _, r, _ in want.values()} == {"labelled", "look back", "any", None}
    bands = {r.id: r.band for r in w.band_deadlines(frame(spark, texts), "id", "text").collect()}
    assert bands == {i: x for i, t in enumerate(texts) if (x := plain_band(t))}
    assert w.with_deadline(frame(spark, ["x"]).limit(0), "text").collect() == [] and w.with_deadline(frame(spark, [None]), "text").first().deadline is None


def test_date_near(spark):
    words = ("prelevement", "total", "payer")

    def plain(text):
        for word in words:
            i = text.lower().find(word)
            part = text[i : i + 100].translate(EASTERN) if i >= 0 else ""
            dates = [iso(*map(int, m.groups()), 1990, 2100) for m in re.finditer(w.YMD_LAB, part)] + [iso(*map(int, m.groups()[::-1]), 1990, 2100) for m in re.finditer(w.DMY_LAB, part)]
            if found := [x for x in dates if x]:
                return found[0]
        return None

    texts = [*noisy(6, 300), "total" + " " * 85 + "2024-05-06", "total" + " " * 86 + "2024-05-06", "Total 06/05/2021 2022-01-01"]
    got = {r.id: r.d for r in frame(spark, [t.replace(" ", " ") for t in texts]).select("id", w.date_near(F.col("text"), *words).alias("d")).collect()}
    assert got == {i: plain(t.replace(" ", " ")) for i, t in enumerate(texts)}


def test_line_windows(spark):
    text = "Glycémie\n 5,4 g / 1 ( 3 - 9 )\nTSH 2 ui/l\ntsh 7 ui/l\nPlaquettes\n\n999999 88\nHémoglobine\nx\ny\n12\nLymphocytes et Monocytes 31"
    got = {(r.label, r.i, r.value, r.unit, r.reference) for r in w.next_line_tests(frame(spark, [text]), "id", "text").collect()}
    assert got == {("Glycemie a jeun", 0, "5.4", "g/l", "3 - 9"), ("TSH", 2, "2", "ui/l", None)}
    known = {(r.label, r.i, r.value) for r in w.known_line_tests(frame(spark, [text, None, ""]), "id", "text").collect()}
    assert known == {("TSH", 0, "5,4"), ("Plaquettes", 2, "2"), ("Hemoglobine", 6, "88"), ("Lymphocytes", 9, "12"), ("Monocytes", 9, "12")}


def test_lines_are_folded_once(spark):
    """One shuffle, of lines before they are texts; each line is folded, and its numbers are looked for, in one place of the plan."""
    plan = w.line_tests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("lower(") == 1 and plan.count("regexp_extract_all(") == 1


def plain_tests(text):
    """Both rules line by line."""
    fold = lambda s: re.sub(r"\s+", " ", s.lower().translate(str.maketrans("éèà", "eea"))).strip()
    lines, out = [re.sub(r"\s+", " ", x).strip(" ") for x in re.split(r"\r\n|[\n\r]", text.translate(EASTERN))], {}
    for i, line in enumerate(lines):
        joined = f"{line} {lines[i + 1]}" if i + 1 < len(lines) and not re.search("[0-9]", line) else line
        label = next((name for name, words in w.FAST_TESTS if any(x in fold(joined) for x in words)), None)
        m = re.search(rf"(\d{{1,4}}(?:[,.]\d{{1,3}})?)\s*({w.UNIT_WORDS})", joined, re.I | re.A)
        if len(line) >= 4 and label and m:
            ref = re.search(r"\(([^)]*\d[^)]*)\)", joined[m.end() :])
            out.setdefault(("next line", label), (i, m[1].replace(",", "."), re.sub(r"\s+", "", m[2]).translate(str.maketrans("1t", "ll")), (ref and ref[1].strip(" ")) or None, joined[:220]))
        window = " ".join(lines[i : i + 3])
        number = next((x for x in re.findall(r"\d{1,6}(?:[,.]\d{1,3})?", window) if float(x.replace(",", ".")) <= 500_000), None)
        for name, words, unit in w.KNOWN_TESTS:
            if line and number is not None and any(x in fold(window) for x in words):
                out.setdefault(("window", name), (i, number, unit, None, window[:220]))
    return out


def test_both_rules_on_noisy_pages(spark):
    """Names and numbers over line ends, empty lines, words that only two lines together have, numbers too large, against a plain loop."""
    rng = random.Random(13)
    words = ["Globules", "rouges", "blancs", "cholesterol", "HDL", "total", "TSH", "Glycémie", "vitamine", "D", "12,5", "999999", "500000,1", "٧", "g/l", "mmol / t", "%", "( 3 - 9 )", "x" * 100, "", "ab"]
    texts = ["", *("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\n", "\r\n", "\t"]) for _ in range(rng.randrange(1, 16))) for _ in range(400))]
    rows = w.tests_of_lines(frame(spark, [*texts, None]), "id", "text").collect()
    got = {i: {} for i in range(len(texts))}
    for r in rows:
        got[r.id][r.rule, r.label] = (r.i, r.value, r.unit, r.reference, r.line)
    assert got == {i: plain_tests(t) for i, t in enumerate(texts)}
    alone = {(r.id, r.label, r.i, r.value) for r in w.known_line_tests(frame(spark, texts), "id", "text").collect()}
    assert alone == {(r.id, r.label, r.i, r.value) for r in rows if r.rule == "window"} and len(alone) > 50
