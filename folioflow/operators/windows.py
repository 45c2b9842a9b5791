"""Stretches of text around matches: where patterns match, and what stands so many characters or lines before and after.

Matches are data: an array of places in the text, from which rules over distances are plain columns. Lines and blocks of lines are rows of their own. A null text has no matches;
overlapping stretches each count; of several hits the first in the text wins unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ACCENTED, PLAIN
from ..sources.ledger import table
from .fields import latin_digits

# Dates, words of payment, years of deadlines, and how far from a match is looked.
YMD = r"(20\d{2})\s*[.\s,/\-]\s*(\d{1,2})\s*[.\s,/\-]\s*(\d{1,2})"
YMD_STRICT = r"(20\d{2})\s*[.\s\-/]\s*(\d{1,2})\s*[.\s\-/]\s*(\d{1,2})"
YMD_LAB, DMY_LAB = r"(20\d{2})\s*[./\s-]\s*(\d{1,2})\s*[./\s-]\s*(\d{1,2})", r"(\d{1,2})\s*[./\s-]\s*(\d{1,2})\s*[./\s-]\s*(20\d{2})"
COMPACT = r"(20\d{2})(\d{2})(\d{2})(?!\d)"
LABELLED = (r"pri[eèéê]re\s+de\s+payer\s+avant\s+le\D{0,60}", r"payer\s+avant\s+le\D{0,50}", r"avant\s+le\D{0,40}", r"payeravantle\D{0,40}")
PAYMENT, ARABIC_PAYMENT = r"payer|avant|pri[eèéê]re|الدفع|قبل|دفع|le\s*$", "الدفع|قبل"
BAND_WORDS = r"payer|avant|قبل|الدفع|pri[eèéê]?re|plait|prier|الرجاء"
FIRST_YEAR, LAST_YEAR = 2012, 2038
TAIL, BEFORE, AFTER, NEAR = 45, 120, 8, 100
MOST_PLAUSIBLE, LONGEST_LINE = 500_000, 220
# Laboratory tests by words of their names, with units for those known by the line.
FAST_TESTS = (
    ("Glycemie a jeun", ("glycem", "glucose")), ("Cholesterol total", ("cholesterol total",)), ("Cholesterol HDL", ("cholesterol hdl", " hdl")), ("Cholesterol LDL", ("cholesterol ldl", " ldl")),
    ("Triglycerides", ("triglycer",)), ("Uree", ("uree", "orer", "oree")), ("Creatinine", ("creatinin",)), ("ASAT / GOT", ("asat", "sgot", "got")), ("ALAT / GPT", ("alat", "sgpt", "gpt")),
    ("Vitamine D", ("vitamine d", "hydroxy")), ("TSH", ("tsh", "thyreostimuline")), ("Hemoglobine", ("hemoglob",)), ("Globules rouges", ("globules rouges",)), ("Leucocytes", ("leucocytes", "globules blancs")), ("Plaquettes", ("plaquettes",)),
)
KNOWN_TESTS = (
    ("Globules rouges", ("globules rouges",), "Millions/mm3"), ("Hemoglobine", ("hemoglob",), "g%"), ("Hematocrite", ("hematocrit",), "%"), ("VGM", ("vgm",), "fL"), ("TCMH", ("tcmh", "tom"), "pg"), ("CCMH", ("ccmh", "comme"), "%"),
    ("Leucocytes", ("leucocytes", "leucogytes"), "/mm3"), ("PN. Neutrophiles", ("neutrophiles",), "%"), ("PN. Eosinophiles", ("eosinophiles",), "%"), ("PN. Basophiles", ("basophiles", "basophile"), "%"), ("Lymphocytes", ("lymphocytes",), "%"),
    ("Monocytes", ("monocytes",), "%"), ("Plaquettes", ("plaquettes", "plaque"), "/mm3"), ("Vitamine D", ("vitamine d", "hydroxy", "vitamined"), "µg/l"), ("TSH", ("tsh", "thyreostimuline", "thyreo"), "uIU/mL"),
)
UNIT_WORDS = r"g\s*/?\s*[l1]|mmol\s*/?\s*[l1t]|mg\s*/?\s*[l1]|mg\s*/?\s*d[l1]|u?mol\s*/?\s*[l1]|µmol\s*/?\s*[l1]|ui\s*/?\s*[l1]|u[i1]?\s*/?\s*ml|mui\s*/?\s*[l1]|ng\s*/?\s*ml|%"


def squeezed(text: Column) -> Column:
    """Runs of white space of any script as one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def match_spans(text: Column, pattern: str) -> Column:
    """start, end (from 0) and hit of each match of a pattern that matches no empty text, from left to right."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), lambda p: p["hit"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit")))).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("spans"))
    return F.aggregate(pairs, zero, step)["spans"]


def valid_date(hit: Column, pattern: str, order: tuple[int, int, int] = (1, 2, 3), years: tuple[int, int] = (2000, 2099)) -> Column:
    """ISO text of a matched date whose parts are in range (each month has 31 days), or null."""
    y, m, d = (F.regexp_extract(hit, pattern, k).try_cast("int") for k in order)
    return F.when(m.between(1, 12) & d.between(1, 31) & y.between(*years), F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")))


def _dates(text: Column, pattern: str, order=(1, 2, 3), years=(2000, 2099)) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: valid_date(h, pattern, order, years)))


def first_date(text: Column) -> Column:
    """The first date with separators; else the first run of eight digits that is one, blanks left out."""
    compact = F.regexp_extract(F.regexp_replace(text, r"(?U)\s+", ""), COMPACT, 0)
    return F.coalesce(F.get(_dates(text, YMD), F.lit(0)), valid_date(compact, COMPACT))


def plausible(iso: Column) -> Column:
    """A deadline, if its year may be one."""
    return F.when(F.substring(iso, 1, 4).cast("int").between(FIRST_YEAR, LAST_YEAR), iso)


def date_near(text: Column, *words: str) -> Column:
    """The first date within 100 characters from where a word first stands; of the words the first that has one. Dates with the year first come before others."""
    low = F.lower(text)

    def near(word: str) -> Column:
        at = F.locate(word, low)
        part = latin_digits(F.substring(text, at, F.lit(NEAR)))
        return F.when(at > 0, F.get(F.concat(_dates(part, YMD_LAB, years=(1990, 2100)), _dates(part, DMY_LAB, (3, 2, 1), (1990, 2100))), F.lit(0)))

    return F.coalesce(*map(near, words))


def with_deadline(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with deadline, rule (labelled, look back or any) and at (where the date begins in the squeezed text, for look back).

    In this order: the date in the 45 characters after a label; the first plausible date with words of payment in the 120 characters before it or the 8 after; in a text with Arabic words of payment
    the first date of all.
    """
    rows = rows.withColumn("_digits", latin_digits(F.col(text))).withColumn("_plain", squeezed(F.col("_digits")))
    plain = F.col("_plain")

    def labelled(pattern: str) -> Column:
        pattern = f"(?iu){pattern}"
        at = F.regexp_instr(plain, F.lit(pattern))
        return F.when(at > 0, plausible(first_date(F.substring(plain, at + F.length(F.regexp_extract(plain, pattern, 0)), F.lit(TAIL)))))

    dated = F.transform(match_spans(plain, YMD_STRICT), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), plausible(valid_date(s["hit"], YMD_STRICT)).alias("iso")))
    from_ = lambda s: F.greatest(F.lit(0), s["start"] - BEFORE)
    around = lambda s: F.substring(plain, from_(s) + 1, s["end"] + AFTER - from_(s))
    rows = rows.withColumn("_spans", dated).withColumn("_back", F.get(F.filter("_spans", lambda s: s["iso"].isNotNull() & around(s).rlike(f"(?iu){PAYMENT}")), F.lit(0)))
    rows = rows.withColumn("_labelled", F.coalesce(*map(labelled, LABELLED)))
    any_ = F.when(F.col("_digits").rlike(ARABIC_PAYMENT), plausible(first_date(F.col("_digits"))))
    rows = rows.withColumn("deadline", F.coalesce(F.col("_labelled"), F.col("_back.iso"), any_))
    rule = F.when(F.col("_labelled").isNotNull(), "labelled").when(F.col("_back").isNotNull(), "look back").when(F.col("deadline").isNotNull(), "any")
    return rows.withColumns({"rule": rule, "at": F.when(rule == "look back", F.col("_back.start"))}).drop("_digits", "_plain", "_spans", "_back", "_labelled")


def band_deadlines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and band: the deadline found most often in blocks of four lines (one before, two after) that have words of payment; of equal ones the first."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    lined = rows.select(key, lines.alias("lines"))
    blocks = lined.select(key, "lines", F.posexplode("lines").alias("i", "line"))
    first = F.greatest(F.lit(1), F.col("i"))
    blocks = blocks.select(key, "i", latin_digits(F.array_join(F.slice("lines", first, F.col("i") + 4 - first), " ")).alias("block")).where(F.col("block").rlike(f"(?iu){BAND_WORDS}"))
    hits = with_deadline(blocks, "block").select(key, "i", F.posexplode(F.array("deadline", plausible(first_date(F.col("block"))))).alias("k", "iso")).where("iso is not null")
    times = hits.groupBy(key, "iso").agg(F.count("*").alias("n"), F.min(F.struct("i", "k")).alias("first"))
    return times.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "iso"))["iso"].alias("band"))


def first_plausible_number(text: Column) -> Column:
    """The first number from 0 to 500,000, as it stands."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\d{1,6}(?:[,.]\d{1,3})?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double") <= MOST_PLAUSIBLE), F.lit(0))


def _lined(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, i, line and the two lines after it (null past the end), blanks squeezed; plain, plain_second and plain_third: the same folded, null where they are empty; number: the first plausible one of the three."""
    lines = F.transform(F.split(latin_digits(F.col(text)), r"\r\n|[\n\r]"), lambda x: F.trim(squeezed(x)))
    rows = rows.select(key, lines.alias("lines"))
    rows = rows.select(key, "lines", F.transform("lines", lambda x: F.translate(F.lower(x), ACCENTED, PLAIN)).alias("plains"), F.transform("lines", first_plausible_number).alias("numbers"))
    rows = rows.select(key, "lines", "plains", "numbers", F.posexplode_outer("lines").alias("i", "line"))
    after = lambda lines, k: F.get(lines, F.col("i") + k)
    plain = lambda k: F.nullif(after("plains", k), F.lit(""))
    number = F.coalesce(*(after("numbers", k) for k in range(3)))
    return rows.select(key, "i", "line", after("lines", 1).alias("second"), after("lines", 2).alias("third"), plain(0).alias("plain"), plain(1).alias("plain_second"), plain(2).alias("plain_third"), number.alias("number"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _named(rule: str, label: Column, unit: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), label.alias("label"), unit.alias("unit"))


def _next_line(lined: DataFrame) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """The lines with what the rule needs, the tests that it may find at each, and what it says of one."""
    with_next = F.col("second").isNotNull() & ~F.col("line").rlike(r"\d")
    lined = lined.select("*", F.when(with_next, F.concat_ws(" ", "line", "second")).otherwise(F.col("line")).alias("joined"), F.when(with_next, F.concat_ws(" ", "plain", "plain_second")).otherwise(F.col("plain")).alias("plain_joined"))
    label = F.lit(None).cast("string")
    for name, words in reversed(FAST_TESTS):
        label = F.when(_any(F.col("plain_joined"), words), name).otherwise(label)
    lined = lined.select("*", F.when(F.length("line") >= 4, label).alias("label"))
    joined, pattern = F.col("joined"), rf"(?i)(\d{{1,4}}(?:[,.]\d{{1,3}})?)\s*({UNIT_WORDS})"
    rest = F.substring(joined, F.regexp_instr(joined, F.lit(pattern)) + F.length(F.regexp_extract(joined, pattern, 0)), F.length(joined))
    says = {
        "value": F.replace(F.regexp_extract(joined, pattern, 1), F.lit(","), F.lit(".")), "unit": F.translate(F.regexp_replace(F.regexp_extract(joined, pattern, 2), r"\s+", ""), "1t", "ll"),
        "reference": F.when(F.contains(joined, F.lit("(")), F.nullif(F.trim(F.regexp_extract(rest, r"\(([^)]*\d[^)]*)\)", 1)), F.lit(""))), "line": F.substring(joined, 1, LONGEST_LINE),
    }
    return lined, [F.when(F.col("label").isNotNull() & joined.rlike(pattern), _named("next line", F.col("label"), F.lit(None).cast("string")))], says


def _known_line(lined: DataFrame) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """The lines with what the rule needs, the tests that it may find at each, and what it says of one."""
    lined = lined.select("*", F.concat_ws(" ", "line", "second", "third").alias("window"), F.when((F.col("line") != "") & F.col("number").isNotNull(), F.concat_ws(" ", "plain", "plain_second", "plain_third")).alias("plain_window"))
    says = {"value": F.col("number"), "unit": F.col("t.unit"), "reference": F.lit(None).cast("string"), "line": F.substring("window", 1, LONGEST_LINE)}
    return lined, [F.when(_any(F.col("plain_window"), words), _named("window", F.lit(name), F.lit(unit))) for name, words, unit in KNOWN_TESTS], says


def _first_tests(rows: DataFrame, key: str, text: str, **rules) -> DataFrame:
    """rule, ``key``, label, i, value, unit, reference, line: each test's first line by each rule.

    Each line is cut, folded and looked at once: tests that it lacks are nulls of an array, dropped when it has been taken apart, as a filter on them before that would find them anew.
    """
    lined, tests, told = _lined(rows, key, text), [], {}
    for name, rule in rules.items():
        lined, more, told[name.replace("_", " ")] = rule(lined)
        tests += more
    found = lined.select("*", F.explode_outer(F.array(*tests)).alias("t")).where("t is not null")
    said = []
    for c in ("value", "unit", "reference", "line"):
        by = F.lit(None).cast("string")
        for name, says in told.items():
            by = F.when(F.col("t.rule") == name, says[c]).otherwise(by)
        said.append(by.alias(c))
    found = found.select(key, "i", "t.rule", "t.label", *said)
    return found.groupBy(key, "rule", "label").agg(F.min(F.struct("i", "value", "unit", "reference", "line")).alias("f")).select("rule", key, "label", "f.*")


def next_line_tests(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, label, i, value, unit, reference, line: each test's first line with a value and a unit; a line without digits is read together with the next one."""
    return _first_tests(rows, key, text, next_line=_next_line).drop("rule")


def known_line_tests(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, label, i, value, unit, reference (null), line: each of fifteen known tests at its first window of three lines that names it and has a plausible number."""
    return _first_tests(rows, key, text, window=_known_line).drop("rule")


def tests_of_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Both in one pass, told by ``rule``: *next line* and *window*."""
    return _first_tests(rows, key, text, next_line=_next_line, window=_known_line)


# Fixtures: bills and laboratory pages as noisy text.
def _bills(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.add_months("o_orderdate", 240)
    iso, old = F.date_format(day, "yyyy-MM-dd"), F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd")
    eastern = F.translate(F.date_format(day, "yyyy/M/d"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("Facture 2011-01-05 Prière de payer avant le : "), iso))
        .when(k % 8 == 1, F.concat(F.lit("PAYER  AVANT\u00a0LE\n"), F.date_format(day, "yyyy . M . d"), F.lit(" merci 2020-01-01")))
        .when(k % 8 == 2, F.concat(F.lit("net payeravantle"), F.date_format(day, "yyyyMMdd")))
        .when(k % 8 == 3, F.concat(F.lit("Montant a payer "), F.repeat(F.lit("x"), (k % 90).cast("int")), F.lit(" "), F.when(k % 16 == 3, old).otherwise(iso), F.lit(" "), F.repeat(F.lit("y"), (k % 200).cast("int")), F.lit(" "), iso))
        .when(k % 8 == 4, F.concat(F.lit("الرجاء الدفع "), F.repeat(F.lit("z "), (k % 80).cast("int")), F.lit("قبل "), eastern))
        .when(k % 8 == 5, F.concat(F.lit("Total "), iso, F.lit("\nsolde 12,500")))
        .when(k % 8 == 6, F.concat(F.lit("avant le 2024-13-45 reste "), F.repeat(F.lit("w"), (k % 70).cast("int")), F.lit(" avant "), iso))
        .otherwise(F.concat(F.lit("entete\n\nprière\n"), iso, F.lit("\n"), old, F.lit("\nplait "), iso, F.lit("\nfin")))
    )
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


LINE_NAMES = ("Glycémie", "Hémoglobine", "Plaquettes", "TSH us", "Urée", "VGM", "Lymphocytes", "Vitamine D", "Créatinine", "tom", "Note", "Cholesterol HDL")


def _lab_pages(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, LINE_NAMES)), (F.col("l_partkey") % 12 + 1).cast("int"))
    value = F.when(F.col("l_partkey") % 17 == 0, "999999 77").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(","), (F.col("l_suppkey") % 10).cast("string")))
    unit = F.element_at(F.array(*map(F.lit, (" g / 1", "mmol/t", " %", " UI/l", ""))), (F.col("l_partkey") % 5 + 1).cast("int"))
    s = F.col("l_suppkey") % 4
    line = (
        F.when(s == 0, F.concat(name, F.lit(" : "), value, unit, F.lit(" ( 3 - 9 )"))).when(s == 1, F.concat(name, F.lit("\n "), value, unit)).when(s == 2, F.concat(name, F.lit("\n\n"), value, unit))
        .otherwise(F.concat(name, F.lit("  "), value))
    )
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")  # before the texts are made
    return rows.groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def bill_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines of all bills: by the text, with rule and place, by blocks of lines, and the date near words."""
    rows = _bills(spark, d)
    told = with_deadline(rows, "text").withColumn("near", date_near(F.col("text"), "payer avant", "prière", "total"))
    return told.join(band_deadlines(rows, "o_orderkey", "text"), "o_orderkey", "left").select("o_orderkey", "deadline", "rule", "at", "band", "near")


def line_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of all laboratory pages, by the line with the next one and by windows of three lines."""
    return tests_of_lines(_lab_pages(spark, d), "l_orderkey", "text").select("rule", "l_orderkey", "label", "i", "value", "unit", "reference", "line")


QUERIES = {f.__name__: f for f in (bill_deadlines, line_tests)}


def _iso_sql(hit: str, pattern: str, order=(1, 2, 3), years=(2000, 2099)) -> str:
    y, m, d = (f"TRY_CAST(regexp_extract({hit}, '{pattern}', {k}) AS INT)" for k in order)
    return f"CASE WHEN {hit} <> '' THEN CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND {y} BETWEEN {years[0]} AND {years[1]} THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END END"


def _dates_sql(text: str, pattern: str, order=(1, 2, 3), years=(2000, 2099)) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}'), lambda h: {_iso_sql('h', pattern, order, years)}), lambda x: x IS NOT NULL)"


_EIGHT = r"(20\d{2})(\d{2})(\d{2})"
_FLAT = r"[\s\x{00A0}]+"


def _first_sql(text: str) -> str:
    """Runs of eight digits are taken out of the text without blanks; one more digit after them makes them none."""
    compact = f"regexp_extract(regexp_replace({text}, '{_FLAT}', '', 'g') || 'x', '({_EIGHT})\\D', 1)"
    return f"coalesce(({_dates_sql(text, YMD)})[1], {_iso_sql(compact, _EIGHT)})"


def _ok_sql(iso: str) -> str:
    return f"CASE WHEN CAST(({iso})[1:4] AS INT) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN {iso} END"


def _labelled_sql(pattern: str) -> str:
    after = f"length(string_split_regex(p, '(?i){pattern}')[1]) + length(regexp_extract(p, '(?i){pattern}'))"
    tail = f"p[{after} + 1 : {after} + {TAIL}]"
    return f"CASE WHEN regexp_matches(p, '(?i){pattern}') THEN {_ok_sql(_first_sql(tail))} END"


_BILLS_SQL = """
o AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH AS day, strftime(CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH, '%Y-%m-%d') AS iso, strftime(CAST(o_orderdate AS DATE) + INTERVAL 120 MONTH, '%Y-%m-%d') AS old FROM orders),
b AS MATERIALIZED (SELECT o_orderkey, CASE k % 8
  WHEN 0 THEN 'Facture 2011-01-05 Prière de payer avant le : ' || iso
  WHEN 1 THEN 'PAYER  AVANT' || chr(160) || 'LE' || chr(10) || year(day) || ' . ' || month(day) || ' . ' || day(day) || ' merci 2020-01-01'
  WHEN 2 THEN 'net payeravantle' || strftime(day, '%Y%m%d')
  WHEN 3 THEN 'Montant a payer ' || repeat('x', CAST(k % 90 AS INT)) || ' ' || CASE WHEN k % 16 = 3 THEN old ELSE iso END || ' ' || repeat('y', CAST(k % 200 AS INT)) || ' ' || iso
  WHEN 4 THEN 'الرجاء الدفع ' || repeat('z ', CAST(k % 80 AS INT)) || 'قبل ' || translate(year(day) || '/' || month(day) || '/' || day(day), '0123456789', '٠١٢٣٤٥٦٧٨٩')
  WHEN 5 THEN 'Total ' || iso || chr(10) || 'solde 12,500'
  WHEN 6 THEN 'avant le 2024-13-45 reste ' || repeat('w', CAST(k % 70 AS INT)) || ' avant ' || iso
  ELSE 'entete' || chr(10) || chr(10) || 'prière' || chr(10) || iso || chr(10) || old || chr(10) || 'plait ' || iso || chr(10) || 'fin' END AS text FROM o)"""
_DEADLINES_SQL = f"""
WITH {_BILLS_SQL},
l AS (SELECT o_orderkey, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM b),
bl AS (SELECT o_orderkey, i, array_to_string(ls[greatest(1, i) : i + 3], ' ') AS text FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM l)),
t AS (
  SELECT o_orderkey, i, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS d FROM (SELECT o_orderkey, -1 AS i, text FROM b UNION ALL SELECT o_orderkey, i, text FROM bl WHERE regexp_matches(text, '(?i){BAND_WORDS}'))
), q AS (SELECT *, regexp_replace(d, '{_FLAT}', ' ', 'g') AS p FROM t),
h AS (SELECT *, regexp_extract_all(p, '{YMD_STRICT}') AS hs, string_split_regex(p, '{YMD_STRICT}') AS gs FROM q),
s AS (SELECT o_orderkey, i, j, p, hs[j] AS hit, list_sum(list_transform(gs[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(hs[1:j - 1], lambda x: len(x))), 0) AS st FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS j FROM h)),
k AS (
  SELECT o_orderkey, i, min(struct_pack(st := CAST(st AS INT), iso := iso)) AS back FROM (SELECT *, {_ok_sql(_iso_sql('hit', YMD_STRICT))} AS iso FROM s)
  WHERE iso IS NOT NULL AND regexp_matches(p[CAST(greatest(0, st - {BEFORE}) AS BIGINT) + 1 : CAST(st + len(hit) + {AFTER} AS BIGINT)], '(?i){PAYMENT}') GROUP BY o_orderkey, i
), z AS MATERIALIZED (
  SELECT q.o_orderkey, q.i, q.d, back, coalesce({', '.join(map(_labelled_sql, LABELLED))}) AS lab, CASE WHEN regexp_matches(d, '{ARABIC_PAYMENT}') THEN {_ok_sql(_first_sql('d'))} END AS other
  FROM q LEFT JOIN k ON k.o_orderkey = q.o_orderkey AND k.i = q.i
), hits AS (
  SELECT o_orderkey, i, 0 AS c, coalesce(lab, back.iso, other) AS iso FROM z WHERE i >= 0 UNION ALL SELECT o_orderkey, i, 1, {_ok_sql(_first_sql('d'))} FROM z WHERE i >= 0
), band AS (
  SELECT o_orderkey, arg_min(iso, struct_pack(a := -n, b := f)) AS band FROM (SELECT o_orderkey, iso, count(*) AS n, min(i * 2 + c) AS f FROM hits WHERE iso IS NOT NULL GROUP BY o_orderkey, iso) GROUP BY o_orderkey
), nr AS (
  SELECT o_orderkey, coalesce({', '.join(f"(CASE WHEN strpos(lower(text), '{w}') > 0 THEN list_concat({_dates_sql('c', YMD_LAB, years=(1990, 2100))}, {_dates_sql('c', DMY_LAB, (3, 2, 1), (1990, 2100))}) END)[1]".replace("regexp_extract_all(c,", f"regexp_extract_all(translate(text[strpos(lower(text), '{w}') : strpos(lower(text), '{w}') + {NEAR - 1}], '٠١٢٣٤٥٦٧٨٩', '0123456789'),") for w in ('payer avant', 'prière', 'total'))}) AS near FROM b
)
SELECT z.o_orderkey, coalesce(lab, back.iso, other) AS deadline, CASE WHEN lab IS NOT NULL THEN 'labelled' WHEN back IS NOT NULL THEN 'look back' WHEN other IS NOT NULL THEN 'any' END AS rule,
  CASE WHEN lab IS NULL THEN back.st END AS at, band, near FROM z LEFT JOIN band ON band.o_orderkey = z.o_orderkey JOIN nr ON nr.o_orderkey = z.o_orderkey WHERE z.i = -1"""
_has = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
_PLAIN = "trim(strip_accents(lower({})))"
_UNIT_SQL = UNIT_WORDS.replace("'", "''")
_TESTS_SQL = f"""
WITH li AS (
  SELECT *, [{', '.join(f"'{n}'" for n in LINE_NAMES)}][l_partkey % 12 + 1] AS name, [' g / 1', 'mmol/t', ' %', ' UI/l', ''][l_partkey % 5 + 1] AS unit,
    CASE WHEN l_partkey % 17 = 0 THEN '999999 77' ELSE CAST(trunc(l_quantity) AS INT) || ',' || l_suppkey % 10 END AS v FROM lineitem
), pg AS (
  SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, line) AS text FROM (
    SELECT *, CASE l_suppkey % 4 WHEN 0 THEN name || ' : ' || v || unit || ' ( 3 - 9 )' WHEN 1 THEN name || chr(10) || ' ' || v || unit WHEN 2 THEN name || chr(10) || chr(10) || v || unit ELSE name || '  ' || v END AS line FROM li
  ) GROUP BY l_orderkey
), ls AS (SELECT l_orderkey, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ls FROM pg),
ln AS MATERIALIZED (SELECT l_orderkey, i, ls[i + 1] AS line, ls[i + 2] AS second, ls[i + 3] AS third FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM ls)),
jn AS (SELECT *, CASE WHEN second IS NOT NULL AND NOT regexp_matches(line, '\\d') THEN line || ' ' || second ELSE line END AS j FROM ln WHERE length(line) >= 4),
jl AS (SELECT *, {_PLAIN.format('j')} AS p FROM jn),
nl AS (
  SELECT l_orderkey, CASE {' '.join(f"WHEN {_has('p', w)} THEN '{n}'" for n, w in FAST_TESTS)} END AS label, i, replace(regexp_extract(j, '(?i)(\\d{{1,4}}(?:[,.]\\d{{1,3}})?)\\s*({_UNIT_SQL})', 1), ',', '.') AS value,
    translate(regexp_replace(regexp_extract(j, '(?i)(\\d{{1,4}}(?:[,.]\\d{{1,3}})?)\\s*({_UNIT_SQL})', 2), '\\s+', '', 'g'), '1t', 'll') AS unit, nullif(trim(regexp_extract(j, '\\(([^)]*\\d[^)]*)\\)', 1)), '') AS reference, j[:{LONGEST_LINE}] AS line FROM jl
), wn AS (SELECT *, concat_ws(' ', line, second, third) AS w FROM ln WHERE line <> ''),
wv AS (SELECT *, {_PLAIN.format('w')} AS p, list_filter(regexp_extract_all(w, '\\d{{1,6}}(?:[,.]\\d{{1,3}})?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE) <= {MOST_PLAUSIBLE})[1] AS value FROM wn),
wt AS ({' UNION ALL '.join(f"SELECT l_orderkey, '{n}' AS label, i, value, '{u}' AS unit, CAST(NULL AS VARCHAR) AS reference, w[:{LONGEST_LINE}] AS line FROM wv WHERE value IS NOT NULL AND {_has('p', k)}" for n, k, u in KNOWN_TESTS)}),
al AS (SELECT 'next line' AS rule, * FROM nl WHERE label IS NOT NULL AND value <> '' UNION ALL SELECT 'window', * FROM wt)
SELECT rule, l_orderkey, label, CAST(i AS INT) AS i, value, unit, reference, line FROM al QUALIFY row_number() OVER (PARTITION BY rule, l_orderkey, label ORDER BY i) = 1"""
ORACLES = {"bill_deadlines": _DEADLINES_SQL, "line_tests": _TESTS_SQL}
