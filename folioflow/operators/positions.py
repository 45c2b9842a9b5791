"""Words with places on a page: rows out of them, values beside labels, amounts near keywords.

A token has a page, its number ``n`` in reading order, a text and a box (x, y, w, h; whole numbers of pixels). Pages are of bounded size: only
what belongs to one page comes together, and tokens meet labels in windows of a sorted page, never each with each. Null texts and tokens without a place are no tokens. Ties go to the
one further left, then to the one read first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import group_starts, whole_groups
from ..functions.columns import ACCENTED, PLAIN, folded
from ..sources.ledger import table
from .fields import EASTERN, LATIN, latin_digits

#: Size of the rendered pages.
WIDTH, HEIGHT = 1000, 1400
# Tolerances of rows as a least number of pixels and a share of the page's height.
TOLERANCES = {"median": (14, 0.012), "mean": (14, 0.02), "line": (10, 0.015)}
# Windows around labels, borders of the columns, and the shares of the page that they are.
WINDOW, WIDE_WINDOW, UNIT_WINDOW, RANGE_WINDOW = 72, 170, 18, 45
VALUES_FROM, VALUES_TO, UNIT_SPAN, RANGES_FROM, LINE_TO = 0.30, 0.68, 0.16, 0.74, 0.76
LONGEST_LINE = 220
# Words of nine laboratory labels, and which of them a label has; the first label that fits is a row's.
LABEL_WORDS = ("glycem", "thyreostimuline|\\btsh\\b", "cholesterol", "hdl", "ldl", "total", "triglycer", "uree", "creatinin", "\\bcrp\\b")
LABELS = ("Glycemie a jeun", "Thyreostimuline (TSH)", "Cholesterol HDL", "Cholesterol LDL", "Cholesterol total", "Triglycerides", "Uree", "Creatinine", "CRP")
_BITS = (1, 2, 4 + 8, 4 + 16, 4 + 32, 64, 128, 256, 512)
TSH, LABEL_OF = 1, np.array([next((k for k, b in enumerate(_BITS) if mask & b == b), -1) for mask in range(1 << len(LABEL_WORDS))])
_END = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"  # as $ is read on the JVM
NOT_PLAIN, NUMBER = re.compile(r"(?a)[^a-z0-9/%\s]"), re.compile(r"(?a)^[<>]?\d{1,4}(?:\.\d{1,3})?" + _END)
RANGE = re.compile(r"(?a)^(\d{1,4}(?:\.\d{1,3})?)\s*(?:-|[aA])\s*(\d{1,4}(?:\.\d{1,3})?)" + _END)
UNIT_RULES = tuple((re.compile(pattern + _END), name) for pattern, name in (("^g/?l", "g/l"), ("^mmol/?l", "mmol/l"), ("^m?ui/?l", "mUI/l"), ("^u?mol/?l", "umol/l"), ("^mg/?d?l", None)))
OTHER_UNITS = ("%", "g%", "ng/ml", "ui/l")
FOLDED, DIGITS = str.maketrans(ACCENTED, PLAIN), str.maketrans(EASTERN, LATIN)
VALUES = ("page", "label", "row", "value", "unit", "reference", "line")
# Tokens that a task takes at a time (a page is never cut), rows that it hands back at a time, words that it remembers.
BLOCK, BATCH, MOST_RULES = 200_000, 10_000, 200_000
# Scores of amounts near keywords.
FAR, SHAPE_BONUS = 1000, 150


def tolerance(kind: str, height: int) -> int:
    least, share = TOLERANCES[kind]
    return max(least, int(height * share))


def _starts(tokens: Column, within: int, mean: bool) -> Column:
    """Places at which rows begin in an array of tokens sorted by ``at``: each token within reach of its row's middle so far joins the row."""
    y = lambda i: F.get(tokens, i)["at"]

    def step(acc: Column, i: Column) -> Column:
        n = i - acc["first"]
        if mean:
            middle = F.floor(acc["total"] / n).cast("int")
        else:  # a row's tokens are sorted, so its median is between two of them
            middle = F.floor((y(acc["first"] + F.floor((n - 1) / 2).cast("int")) + y(acc["first"] + F.floor(n / 2).cast("int"))) / 2).cast("int")
        joins = F.abs(y(i) - middle) <= within
        return F.struct(
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(i))).alias("starts"), F.when(joins, acc["first"]).otherwise(i).alias("first"),
            (F.when(joins, acc["total"]).otherwise(F.lit(0).cast("long")) + y(i)).alias("total"),
        )

    zero = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("first"), y(F.lit(0)).cast("long").alias("total"))
    return F.aggregate(F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>")), zero, step)["starts"]


def page_rows(tokens: DataFrame, kind: str, height: int = HEIGHT) -> DataFrame:
    """page, row (from 1), y (median of the tokens'), text, n_tokens of the rows of each page.

    ``kind``: *median* and *line* compare a token's top with the median of its row's, *mean* its centre with the mean of theirs; they differ in their tolerances too.
    """
    centre = F.col("y") + F.floor(F.col("h") / 2).cast("int")
    token = F.struct(*((centre.alias("at"), F.col("n").alias("then")) if kind == "mean" else (F.col("y").alias("at"), F.col("x").alias("then"))), "n", "x", "y", "text")
    pages = tokens.where("text is not null and x is not null and y is not null").groupBy("page").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    pages = pages.withColumn("starts", _starts(F.col("tokens"), tolerance(kind, height), kind == "mean"))
    k, size = F.col("k"), F.coalesce(F.get("starts", F.col("k") + 1), F.size("tokens"))
    rows = pages.select("page", "tokens", "starts", F.posexplode("starts").alias("k", "start"))
    rows = rows.select("page", (k + 1).alias("row"), F.slice("tokens", F.col("start") + 1, size - F.col("start")).alias("tokens"))
    ys = F.array_sort(F.transform("tokens", lambda t: t["y"]))
    across = F.array_sort(F.transform("tokens", lambda t: F.struct(t["x"].alias("x"), t["at"].alias("at"), t["then"].alias("then"), t["n"].alias("n"), t["text"].alias("text"))))
    return rows.select("page", "row", ys.alias("ys"), F.array_join(F.transform(across, lambda t: t["text"]), " ").alias("text"), F.size("tokens").alias("n_tokens")).select(
        "page", "row", F.floor((F.get("ys", F.floor((F.col("n_tokens") - 1) / 2).cast("int")) + F.get("ys", F.floor(F.col("n_tokens") / 2).cast("int"))) / 2).cast("int").alias("y"), "text", "n_tokens"
    )


def default_unit(label: Column) -> Column:
    return F.when(label.rlike("(?i)glycem|cholesterol|triglycer"), "g/l").when(label.rlike("(?i)tsh|thyreostimuline"), "mUI/l")


def clean_unit(text: Column) -> Column:
    """A unit as it is meant, with I and 1 read for l; null for what is none."""
    plain = F.regexp_replace(F.translate(latin_digits(F.trim(text)), "Iı1", "lll"), r"\s+", "")
    low = F.replace(folded(plain), F.lit("mul"), F.lit("mui"))
    return (
        F.when(low.rlike("^g/?l$"), "g/l").when(low.rlike("^mmol/?l$"), "mmol/l").when(low.rlike("^m?ui/?l$"), "mUI/l").when(low.rlike("^u?mol/?l$"), "umol/l")
        .when(low.rlike("^mg/?d?l$") | low.isin("%", "g%", "ng/ml", "ui/l"), plain)
    )


def reference_range(text: Column) -> Column:
    """A range like 4.5-12, in which three digits without a dot are read as d.dd; null for what is none."""
    plain = F.replace(latin_digits(F.trim(text)), F.lit(","), F.lit("."))
    pattern = r"^(\d{1,4}(?:\.\d{1,3})?)\s*(?:-|[aA])\s*(\d{1,4}(?:\.\d{1,3})?)$"
    part = lambda k: F.regexp_replace(F.regexp_extract(plain, pattern, k), r"^(\d)(\d\d)$", "$1.$2")
    return F.when(plain.rlike(pattern), F.concat(part(1), F.lit("-"), part(2)))


def word_rules(word: str) -> tuple[int, str | None, str | None, str | None]:
    """What a word is by itself: the LABEL_WORDS in it as bits, and the value, the unit and the range that it stands for, each null if it is none. Unit and range are those of ``clean_unit`` and ``reference_range``."""
    plain = NOT_PLAIN.sub(" ", word.lower().translate(FOLDED))
    latin = word.translate(DIGITS)
    dotted, trimmed = latin.replace(",", "."), latin.strip(" ")
    unit = re.sub(r"(?a:\s+)", "", word.strip(" ").translate(DIGITS | {ord(c): "l" for c in "Iı1"}))
    low = re.sub(r"(?a:\s+)", " ", unit.lower().translate(FOLDED)).strip(" ").replace("mul", "mui")
    unit = next((name or unit for pattern, name in UNIT_RULES if pattern.search(low)), unit if low in OTHER_UNITS else None)
    ends = RANGE.search(trimmed.replace(",", "."))
    return (
        sum(1 << k for k, w in enumerate(LABEL_WORDS) if re.search(w, plain)), re.sub("^[<>]+", "", dotted) if NUMBER.search(trimmed.replace(",", ".")) else None, unit,
        ends and "-".join(re.sub(r"(?a:^(\d)(\d\d)$)", r"\1.\2", e) for e in ends.groups()),
    )


def _row_starts(y: np.ndarray, starts: np.ndarray, within: int) -> np.ndarray:
    """Whether a row begins at a token, as ``page_rows`` has it for *median*: the next token of all pages at a time."""
    new = np.zeros(len(y), bool)
    new[starts] = True
    sizes = np.diff(starts, append=len(y))
    by = np.argsort(-sizes, kind="stable")
    longest, begin = sizes[by], starts[by]
    first = begin.copy()
    for k in range(1, int(longest[0])):
        m = np.searchsorted(-longest, -k)
        i, b = begin[:m] + k, first[:m]
        apart = np.abs(y[i] - (y[b + (i - b - 1) // 2] + y[b + (i - b) // 2]) // 2) > within
        new[i[apart]] = True
        first[:m] = np.where(apart, i, b)
    return new


def _within(keys: np.ndarray, at: np.ndarray, reach: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``at`` the places of the sorted ``keys`` that differ by ``reach`` at most, as pairs (which, place) and counts."""
    low, high = np.searchsorted(keys, at - reach), np.searchsorted(keys, at + reach, "right")
    counts = high - low
    which = np.repeat(np.arange(len(at)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - low, counts), counts


def _values_of_pages(tokens: pa.Table, width: int, height: int, rules: dict[str, tuple]) -> pa.Table:
    """VALUES of the whole pages of a block (page, n, x, y, text; a page's tokens one after another). ``rules`` keeps what is known of words."""
    pages, n, x, y, texts = (tokens.column(k).combine_chunks() for k in ("page", "n", "x", "y", "text"))
    starts = group_starts(pages)
    n, x, y = n.fill_null(np.iinfo(np.int64).min).to_numpy(), x.to_numpy().astype(np.int64), y.to_numpy().astype(np.int64)
    coded = texts.dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if len(rules) > MOST_RULES:
        rules.clear()
    told = [rules.get(w) or rules.setdefault(w, word_rules(w)) for w in vocabulary]
    rank = np.empty(len(vocabulary), np.int64)
    rank[sorted(range(len(vocabulary)), key=vocabulary.__getitem__)] = np.arange(len(vocabulary))
    known = [np.array([t[k] is not None for t in told]) for k in (1, 2, 3)]
    # places as one number: pages lie further apart than any window reaches
    page, low = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(y))), int(y.min())
    apart = int(y.max()) - low + WIDE_WINDOW + 1
    key = page * apart + (y - low)
    order = np.lexsort((rank[code], n, x, key))
    n, x, y, key, code = n[order], x[order], y[order], key[order], code[order]
    # rows with a label
    row = np.flatnonzero(_row_starts(y, starts, tolerance("median", height)))
    size = np.diff(row, append=len(y))
    number = np.arange(len(row)) - np.searchsorted(row, starts)[page[row]] + 1
    label = LABEL_OF[np.bitwise_or.reduceat(np.array([t[0] for t in told])[code], row)]
    has = np.flatnonzero(label >= 0)
    row, size, number, label = row[has], size[has], number[has], label[has]
    middle = page[row] * apart + (y[row + (size - 1) // 2] + y[row + size // 2]) // 2 - low
    reach = np.where(label == TSH, WIDE_WINDOW, WINDOW)
    # the nearest number of a row: the first of those at the next place from it on, or of those at the last place before it
    is_value = np.flatnonzero(known[0][code] & (x >= int(width * VALUES_FROM)) & (x <= int(width * VALUES_TO)))
    places = np.append(key[is_value], np.iinfo(np.int64).max)
    is_value = np.append(is_value, 0)
    after = np.searchsorted(places, middle)
    before = np.searchsorted(places, places[after - 1])
    far = np.iinfo(np.int64).max
    to_after, to_before = places[after] - middle, np.where(after > 0, middle - places[before], far)
    one, other = is_value[before], is_value[after]
    first = (to_before < to_after) | ((to_before == to_after) & ((x[one] < x[other]) | ((x[one] == x[other]) & (n[one] <= n[other]))))
    hit = np.where(first, one, other)
    # of each label the first row with a number
    found = np.flatnonzero(np.minimum(to_before, to_after) <= reach)
    found = found[np.sort(np.unique(page[row[found]] * len(LABELS) + label[found], return_index=True)[1])]
    row, size, number, label, middle, reach, hit = (a[found] for a in (row, size, number, label, middle, reach, hit))

    def least(of: np.ndarray, window: int, right: np.ndarray | None, k: int, by_x: bool) -> pa.Array:
        """Of what ``of`` marks, beside each value: the first from the left or of the reading order."""
        of = np.flatnonzero(of)
        which, at, _ = _within(key[of], key[hit], window)
        at = of[at]
        if right is not None:
            near = (x[at] >= x[hit][which]) & (x[at] <= right[which])
            which, at = which[near], at[near]
        names = sorted({t[k] for t in told if t[k] is not None})
        place = {name: i for i, name in enumerate(names)}
        name = np.array([place.get(t[k], -1) for t in told])[code[at]]
        best = np.lexsort((name, n[at], *([x[at]] if by_x else []), which))
        which, at = np.unique(which[best], return_index=True)
        out = np.full(len(hit), -1)
        out[which] = name[best][at]
        return pa.array(names, pa.string()).take(pa.array(out, mask=out < 0))

    units = least(known[1][code], UNIT_WINDOW, x[hit] + int(width * UNIT_SPAN), 2, True)
    ranges = least(known[2][code] & (x >= int(width * RANGES_FROM)), RANGE_WINDOW, None, 3, False)
    left = np.flatnonzero(x <= int(width * LINE_TO))
    _, at, counts = _within(key[left], middle, reach)
    words = lambda code: pa.array(vocabulary, pa.string()).take(pa.array(code))
    line = pc.binary_join(pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), words(code[left[at]])), " ")
    bare = np.flatnonzero(pc.equal(line, "").to_numpy(zero_copy_only=False))
    if len(bare):  # nothing to the left: the row itself, from left to right
        lines = line.to_pylist()
        for i in bare:
            own = np.arange(row[i], row[i] + size[i])
            lines[i] = " ".join(vocabulary[c] for c in code[own[np.lexsort((rank[code[own]], n[own], y[own], x[own]))]])
        line = pa.array(lines, pa.string())
    values = pa.array([t[1] for t in told], pa.string()).take(pa.array(code[hit]))
    return pa.table([pages.take(pa.array(starts[page[row]])), pa.array(LABELS, pa.string()).take(pa.array(label)), pa.array(number.astype(np.int32)), values, units, ranges, pc.utf8_slice_codeunits(line, 0, LONGEST_LINE)], VALUES)


def _blocks(width: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, tuple] = {}
        for block in whole_groups(batches, "page", BLOCK):
            yield from _values_of_pages(block, width, height, rules).to_batches(max_chunksize=BATCH)

    return run


def lab_values(tokens: DataFrame, width: int = WIDTH, height: int = HEIGHT, together: bool = False) -> DataFrame:
    """page, label, row, value, unit, reference, line: for each label the number nearest to its first row that has one within reach, with the unit and the range beside that number.

    Pages are dealt out once, and a task takes many whole ones at a time. ``together``: the tokens of each page lie in one partition already, one after another.
    """
    tokens = tokens.where("page is not null and text is not null and x is not null and y is not null").select("page", F.col("n").cast("long").alias("n"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "text")
    tokens = tokens if together else tokens.repartition("page").sortWithinPartitions("page")
    kind = tokens.schema["page"].dataType.simpleString()
    out = tokens.mapInArrow(_blocks(width, height), f"page {kind}, label string, row int, value string, unit string, reference string, line string")
    return out.withColumn("unit", F.coalesce("unit", default_unit(F.col("label"))))


def amount_candidates(text: Column) -> Column:
    """Amounts with three decimals, then numbers of two to seven digits, each once in the order that they are found."""
    compact = F.translate(latin_digits(text), "O. ", "0,")
    decimals = F.regexp_extract_all(compact, F.lit(r"\d{1,7},\d{3}"), F.lit(0))
    whole = F.filter(F.regexp_extract_all(compact, F.lit(r"\d+"), F.lit(0)), lambda x: F.length(x).between(2, 7))
    return F.array_distinct(F.concat(decimals, whole))


def amounts_near_keywords(tokens: DataFrame, first: str = "payer|المطلوب", second: str = "montant|المبلغ") -> DataFrame:
    """page, rank (from 1), score, amount, chosen: all amounts of a page by how near they are to a keyword, those shaped like an amount before others; ``chosen`` is the amount to pay.

    Keywords of the second kind count on pages without the first kind. A page's keywords are one array, and each amount takes the least score over it.
    """
    centre = lambda a, b: F.col(a) + F.floor(F.col(b) / 2).cast("int")
    tokens = tokens.where("text is not null and x is not null and y is not null").select("page", "n", "text", centre("x", "w").alias("cx"), centre("y", "h").alias("cy"))
    kind = F.when(F.col("text").rlike(f"(?iu){first}"), 0).when(F.col("text").rlike(f"(?iu){second}"), 1)
    told = tokens.withColumn("kind", kind).where("kind is not null").groupBy("page").agg(F.min("kind").alias("least"), F.collect_list(F.struct("kind", "cx", "cy")).alias("words"))
    told = told.select("page", F.filter("words", lambda w: w["kind"] == F.col("least")).alias("words"))
    found = tokens.withColumn("amounts", amount_candidates(F.col("text"))).where(F.size("amounts") > 0).join(told, "page", "left")
    near = F.array_min(F.transform("words", lambda w: F.abs(F.col("cy") - w["cy"]) + F.floor(F.abs(F.col("cx") - w["cx"]) / 4).cast("int")))
    found = found.select("page", "n", F.least(F.lit(FAR), F.coalesce(near, F.lit(FAR))).alias("away"), F.posexplode("amounts").alias("k", "amount"))
    score = F.col("away") - F.when(F.col("amount").rlike(r"^\d{1,6},\d{3}$"), SHAPE_BONUS).otherwise(0)
    pages = found.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(score.alias("score"), "n", "k", "amount"))).alias("ranked"))
    return pages.select("page", payment_amount(F.transform("ranked", lambda r: r["amount"])).alias("chosen"), F.posexplode("ranked").alias("at", "r")).select("page", (F.col("at") + 1).alias("rank"), "r.score", "r.amount", "chosen")


def payment_amount(ranked: Column) -> Column:
    """Of ranked candidates the largest with three decimals; else the longest number, with its comma restored from four digits on. The first of equal ones."""
    strong = F.filter(ranked, lambda a: F.contains(a, F.lit(",")))
    millis = lambda a: F.replace(a, F.lit(","), F.lit("")).cast("long")
    largest = F.get(F.filter(strong, lambda a: millis(a) == F.array_max(F.transform(strong, millis))), F.lit(0))
    longest = F.get(F.filter(ranked, lambda a: F.length(a) == F.array_max(F.transform(ranked, lambda b: F.length(b)))), F.lit(0))
    return F.when(F.size(strong) > 0, largest).otherwise(F.regexp_replace(longest, r"^(\d{1,4})(\d{3})$", "$1,$2"))


# Fixture: each line of an order is a laboratory line of a page, its words set apart and up to 11 pixels off.
NAMES = ("Glycémie à jeun", "TSH", "Cholestérol HDL", "Cholesterol LDL", "CHOLESTEROL total", "Triglycérides", "Urée", "Créatinine", "CRP us")
UNITS = ("g/l", "mmol/1", "mUI/I", "umol/L", "??", "mg/d1")


def lab_tokens(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """Pages of laboratory lines, one for each order: a name, a value, a unit and a range for each of its lines. ``together``: lines are dealt out by page before they are cut into words."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    quantity = F.col("l_quantity").cast("int")
    value = F.when(F.col("l_partkey") % 11 == 0, "n.d.").otherwise(F.concat(F.when(F.col("l_partkey") % 13 == 0, "<").otherwise(""), quantity.cast("string"), F.lit(","), (F.col("l_suppkey") % 10).cast("string")))
    words = F.concat(
        F.split(pick(NAMES, F.col("l_partkey")), " "), F.array(value, pick(UNITS, F.col("l_suppkey")), F.concat((quantity + 90).cast("string"), F.lit("-"), (quantity + 130).cast("string")))
    )
    n = F.size("words")
    x = F.when(F.col("k") < F.col("size") - 3, 20 + 90 * F.col("k")).when(F.col("k") == F.col("size") - 3, 400 + (F.col("l_suppkey") % 40) * 8).when(F.col("k") == F.col("size") - 2, 480 + (F.col("l_suppkey") % 40) * 8).otherwise(780)
    y = 60 * F.col("l_linenumber") + (F.col("l_partkey") * 7 + F.col("k") * 5) % 23 - 11
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey") if together else rows
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", words.alias("words"))
    rows = rows.select("*", n.alias("size"), F.posexplode("words").alias("k", "text"))
    return rows.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**4 + F.col("l_suppkey") % 100 * 100 + F.col("k")).alias("n"), "text",
        x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(60).alias("w"), (12 + F.col("l_partkey") % 9).cast("int").alias("h"),
    )


def bill_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pages of bills, one for each customer: keywords and amounts of its orders at places made from their keys."""
    total = F.floor(F.col("o_totalprice") * 10).cast("long")
    dotted = F.concat(F.floor(total / 1000).cast("string"), F.lit("."), F.lpad((total % 1000).cast("string"), 3, "0"))
    kind = F.col("o_orderkey") % 7
    word = F.when(kind == 0, "Payer:").when(kind < 3, "MONTANT").when(kind == 3, "المبلغ").otherwise("Date")
    amount = F.when(kind < 4, dotted).when(kind == 4, total.cast("string")).when(kind == 5, F.concat(F.lit("ref"), (total % 90).cast("string"), F.lit("O "), F.replace(dotted, F.lit("."), F.lit(",")))).otherwise("--")
    token = lambda k, text, x: F.struct(F.lit(k).alias("k"), text.alias("text"), x.cast("int").alias("x"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(token(0, word, F.col("o_orderkey") * 37 % 300), token(1, amount, 300 + F.col("o_orderkey") * 53 % 600))).alias("t"))
    return rows.select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") * 2 + F.col("t.k")).alias("n"), "t.text", "t.x", (F.col("o_orderkey") * 29 % 1300 + F.col("t.k") * 7).cast("int").alias("y"), F.lit(81).alias("w"), F.lit(15).alias("h"))


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all laboratory pages by all three rules."""
    tokens = lab_tokens(spark, d)
    out = None
    for kind in TOLERANCES:
        rows = page_rows(tokens, kind).select(F.lit(kind).alias("kind"), "page", "row", "y", "text", "n_tokens")
        out = rows if out is None else out.unionByName(rows)
    return out


def lab_grid(spark: SparkSession, d: str) -> DataFrame:
    """Values, units and ranges beside the labels of all laboratory pages."""
    return lab_values(lab_tokens(spark, d, together=True), together=True)


def near_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of all bills by their distance to keywords."""
    return amounts_near_keywords(bill_tokens(spark, d))


QUERIES = {f.__name__: f for f in (token_rows, lab_grid, near_amounts)}

_LAB = """
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_concat(string_split(['Glycémie à jeun', 'TSH', 'Cholestérol HDL', 'Cholesterol LDL', 'CHOLESTEROL total', 'Triglycérides', 'Urée', 'Créatinine', 'CRP us'][l_partkey % 9 + 1], ' '),
    [CASE WHEN l_partkey % 11 = 0 THEN 'n.d.' ELSE CASE WHEN l_partkey % 13 = 0 THEN '<' ELSE '' END || CAST(trunc(l_quantity) AS INT) || ',' || l_suppkey % 10 END,
     ['g/l', 'mmol/1', 'mUI/I', 'umol/L', '??', 'mg/d1'][l_suppkey % 6 + 1], (CAST(trunc(l_quantity) AS INT) + 90) || '-' || (CAST(trunc(l_quantity) AS INT) + 130)]) AS words FROM lineitem
), lk AS (SELECT *, len(words) AS size, unnest(range(0, len(words))) AS k FROM li),
tok AS MATERIALIZED (
  SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 10000 + l_suppkey % 100 * 100 + k AS n, words[k + 1] AS text,
    CAST(CASE WHEN k < size - 3 THEN 20 + 90 * k WHEN k = size - 3 THEN 400 + (l_suppkey % 40) * 8 WHEN k = size - 2 THEN 480 + (l_suppkey % 40) * 8 ELSE 780 END AS INT) AS x,
    CAST(60 * l_linenumber + (l_partkey * 7 + k * 5) % 23 - 11 AS INT) AS y, CAST(12 + l_partkey % 9 AS INT) AS h FROM lk
)"""
_ROWS = """
pg AS MATERIALIZED (
  SELECT 'median' AS kind, 16 AS tol, page, list(struct_pack(a := y, b := CAST(x AS BIGINT), n := n, x := x, y := y, t := text) ORDER BY y, x, n, text) AS ts FROM tok GROUP BY page
  UNION ALL SELECT 'line', 21, page, list(struct_pack(a := y, b := CAST(x AS BIGINT), n := n, x := x, y := y, t := text) ORDER BY y, x, n, text) FROM tok GROUP BY page
  UNION ALL SELECT 'mean', 28, page, list(struct_pack(a := CAST(y + h // 2 AS INT), b := CAST(n AS BIGINT), n := n, x := x, y := y, t := text) ORDER BY y + h // 2, n, x, text) FROM tok GROUP BY page
), st(kind, tol, page, i, s, total, row) AS (
  SELECT kind, tol, page, 1, 1, CAST(ts[1].a AS BIGINT), 1 FROM pg
  UNION ALL
  SELECT kind, tol, page, i + 1, CASE WHEN j THEN s ELSE i + 1 END, CASE WHEN j THEN total ELSE 0 END + a, CASE WHEN j THEN row ELSE row + 1 END FROM (
    SELECT st.*, pg.ts[i + 1].a AS a, abs(pg.ts[i + 1].a - CASE WHEN st.kind = 'mean' THEN total // (i + 1 - s) ELSE CAST(floor((pg.ts[s + (i - s) // 2].a + pg.ts[s + (i + 1 - s) // 2].a) / 2.0) AS INT) END) <= st.tol AS j
    FROM st JOIN pg ON pg.kind = st.kind AND pg.page = st.page WHERE i < len(pg.ts)
  )
), rw AS MATERIALIZED (
  SELECT kind, page, row, CAST(floor(median(y)) AS INT) AS y, string_agg(t, ' ' ORDER BY x, a, b, n, t) AS text, CAST(count(*) AS INT) AS n_tokens
  FROM (SELECT st.kind, st.page, st.row, u.* FROM st JOIN pg ON pg.kind = st.kind AND pg.page = st.page, LATERAL (SELECT pg.ts[st.i].a AS a, pg.ts[st.i].b AS b, pg.ts[st.i].n AS n, pg.ts[st.i].x AS x, pg.ts[st.i].y AS y, pg.ts[st.i].t AS t) u)
  GROUP BY kind, page, row
)"""
ORACLES = {
    "token_rows": f"WITH RECURSIVE {_LAB}, {_ROWS} SELECT kind, page, CAST(row AS INT) AS row, y, text, n_tokens FROM rw",
    "lab_grid": f"""WITH RECURSIVE {_LAB}, {_ROWS},
pl AS (SELECT page, row, y, text, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9/%\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM rw WHERE kind = 'median'),
lb AS (
  SELECT *, CASE WHEN label = 'Thyreostimuline (TSH)' THEN 170 ELSE 72 END AS reach FROM (SELECT page, row, y AS ly, text AS row_text, CASE WHEN p LIKE '%glycem%' THEN 'Glycemie a jeun' WHEN p LIKE '%thyreostimuline%' OR regexp_matches(p, '\\btsh\\b') THEN 'Thyreostimuline (TSH)'
    WHEN p LIKE '%cholesterol%' AND p LIKE '%hdl%' THEN 'Cholesterol HDL' WHEN p LIKE '%cholesterol%' AND p LIKE '%ldl%' THEN 'Cholesterol LDL' WHEN p LIKE '%cholesterol%' AND p LIKE '%total%' THEN 'Cholesterol total'
    WHEN p LIKE '%triglycer%' THEN 'Triglycerides' WHEN p LIKE '%uree%' THEN 'Uree' WHEN p LIKE '%creatinin%' THEN 'Creatinine' WHEN regexp_matches(p, '\\bcrp\\b') THEN 'CRP' END AS label FROM pl) WHERE label IS NOT NULL
), ht AS (
  SELECT lb.*, t.x AS vx, t.y AS vy, ltrim(replace(t.text, ',', '.'), '<>') AS value FROM lb JOIN tok t ON t.page = lb.page AND abs(t.y - ly) <= reach AND t.x BETWEEN 300 AND 680 AND regexp_full_match(replace(t.text, ',', '.'), '[<>]?[0-9]{{1,4}}(\\.[0-9]{{1,3}})?')
  QUALIFY row_number() OVER (PARTITION BY lb.page, label ORDER BY row, abs(t.y - ly), t.x, t.n, t.y, t.text) = 1
), un AS (
  SELECT ht.page, label, CASE WHEN regexp_full_match(lw, 'g/?l') THEN 'g/l' WHEN regexp_full_match(lw, 'mmol/?l') THEN 'mmol/l' WHEN regexp_full_match(lw, 'm?ui/?l') THEN 'mUI/l' WHEN regexp_full_match(lw, 'u?mol/?l') THEN 'umol/l' ELSE tx END AS unit
  FROM ht JOIN (SELECT *, translate(text, 'I1', 'll') AS tx, replace(lower(translate(text, 'I1', 'll')), 'mul', 'mui') AS lw FROM tok) t ON t.page = ht.page AND abs(t.y - vy) <= 18 AND t.x BETWEEN vx AND vx + 160
  WHERE regexp_full_match(lw, 'g/?l|mmol/?l|m?ui/?l|u?mol/?l|mg/?d?l') OR lw IN ('%', 'g%', 'ng/ml', 'ui/l')
  QUALIFY row_number() OVER (PARTITION BY ht.page, label ORDER BY t.x, t.n, t.text) = 1
), rf AS (
  SELECT ht.page, label, regexp_replace(split_part(t.text, '-', 1), '^(.)(..)$', '\\1.\\2') || '-' || regexp_replace(split_part(t.text, '-', 2), '^(.)(..)$', '\\1.\\2') AS reference
  FROM ht JOIN tok t ON t.page = ht.page AND abs(t.y - vy) <= 45 AND t.x >= 740 AND regexp_full_match(t.text, '[0-9]{{1,4}}-[0-9]{{1,4}}')
  QUALIFY row_number() OVER (PARTITION BY ht.page, label ORDER BY t.n, t.text) = 1
), ln AS (SELECT ht.page, label, string_agg(t.text, ' ' ORDER BY t.y, t.x, t.n, t.text) AS line FROM ht JOIN tok t ON t.page = ht.page AND abs(t.y - ly) <= reach AND t.x <= 760 GROUP BY ht.page, label)
SELECT page, label, CAST(row AS INT) AS row, value, coalesce(unit, CASE WHEN regexp_matches(lower(label), 'glycem|cholesterol|triglycer') THEN 'g/l' WHEN label LIKE 'Thyreo%' THEN 'mUI/l' END) AS unit, reference, line[:220] AS line
FROM ht LEFT JOIN un USING (page, label) LEFT JOIN rf USING (page, label) LEFT JOIN ln USING (page, label)""",
    "near_amounts": """
WITH o AS (SELECT *, CAST(floor(o_totalprice * 10) AS BIGINT) AS total, o_orderkey % 7 AS kind FROM orders),
p AS (SELECT *, (total // 1000) || '.' || lpad(CAST(total % 1000 AS VARCHAR), 3, '0') AS dotted FROM o),
t AS (
  SELECT o_custkey AS page, o_orderkey * 2 AS n, CASE WHEN kind = 0 THEN 'Payer:' WHEN kind < 3 THEN 'MONTANT' WHEN kind = 3 THEN 'المبلغ' ELSE 'Date' END AS text, o_orderkey * 37 % 300 + 40 AS cx, o_orderkey * 29 % 1300 + 7 AS cy FROM p
  UNION ALL SELECT o_custkey, o_orderkey * 2 + 1, CASE WHEN kind < 4 THEN dotted WHEN kind = 4 THEN CAST(total AS VARCHAR) WHEN kind = 5 THEN 'ref' || total % 90 || 'O ' || replace(dotted, '.', ',') ELSE '--' END, 300 + o_orderkey * 53 % 600 + 40, o_orderkey * 29 % 1300 + 14 FROM p
), kw AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'payer|المطلوب') THEN 0 ELSE 1 END AS kind FROM t WHERE regexp_matches(lower(text), 'payer|المطلوب|montant|المبلغ')),
kk AS (SELECT * FROM kw WHERE kind = (SELECT min(k.kind) FROM kw k WHERE k.page = kw.page)),
c AS (SELECT page, n, cx, cy, replace(replace(replace(text, 'O', '0'), '.', ','), ' ', '') AS z FROM t),
a AS (SELECT page, n, cx, cy, list_concat(regexp_extract_all(z, '[0-9]{1,7},[0-9]{3}'), list_filter(regexp_extract_all(z, '[0-9]+'), lambda x: len(x) BETWEEN 2 AND 7)) AS l FROM c),
b AS (SELECT page, n, cx, cy, l[i] AS amount, i FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM a) WHERE list_position(l, l[i]) = i),
s AS (
  SELECT b.page, b.n, b.i, amount, least(1000, coalesce(min(abs(b.cy - k.cy) + abs(b.cx - k.cx) // 4), 1000)) - CASE WHEN regexp_full_match(amount, '[0-9]{1,6},[0-9]{3}') THEN 150 ELSE 0 END AS score
  FROM b LEFT JOIN kk k ON k.page = b.page GROUP BY b.page, b.n, b.i, amount
), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score, n, i) AS rank FROM s),
ch AS (
  SELECT page, coalesce(
    arg_min(amount, struct_pack(a := -CAST(replace(amount, ',', '') AS BIGINT), b := rank)) FILTER (WHERE amount LIKE '%,%'),
    regexp_replace(arg_min(amount, struct_pack(a := -len(amount), b := rank)), '^([0-9]{1,4})([0-9]{3})$', '\\1,\\2')) AS chosen FROM r GROUP BY page
)
SELECT page, CAST(rank AS INT) AS rank, CAST(score AS INT) AS score, amount, chosen FROM r JOIN ch USING (page)""",
}
