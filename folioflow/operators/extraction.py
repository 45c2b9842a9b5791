"""Fields out of noisy texts (stores, numbers, totals, items, laboratory tests), and the warnings and quality of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import table
from .fields import amount_texts, amount_value, currency

# Brands, words that rule a line out, words of total lines, and the patterns of numbers.
BRANDS = ("zara", "carrefour", "monoprix", "geant", "aziza", "mg", "costco", "walmart", "decathlon", "lc waikiki")
IGNORED_DOMAINS = ("facebook", "google", "instagram", "youtube", "gmail", "hotmail", "mail")
NO_STORE = ("ticket", "total", "ttc", "tva", "date", "caisse", "paiement", "cash", "visa", "www", "facebook")
NO_RECEIPT_ITEM = ("total", "ttc", "tva", "tax", "paiement", "payment", "rendu", "monnaie", "visa")
NO_INVOICE_ITEM = ("total", "subtotal", "sous total", "ttc", "tva", "tax", "invoice", "facture", "client")
TOTAL_WORDS = ("total", "ttc", "net a payer", "amount due")
DOMAIN = r"(?i)(?:www\s*\.?\s*)?([a-z][a-z0-9-]{1,24})\s*\.\s*(?:com|tn|fr|net|org)(?:\s*\.\s*[a-z]{2})?"
RECEIPT_NUMBERS = (
    r"(?i)\bInvoice\s*(?:No|Number|#)?\.?\s*:?\s*([A-Z0-9][A-Z0-9\-\/]{2,})",
    r"(?i)\bInv(?:oice)?\s*(?:No|#)?\.?\s*:?\s*([A-Z0-9][A-Z0-9\-\/]{2,})",
    r"(?i)\bBill\s*(?:No|#)?\.?\s*:?\s*([A-Z0-9][A-Z0-9\-\/]{2,})",
    r"(?i)\bReceipt\s*(?:No|#)?\.?\s*:?\s*([A-Z0-9][A-Z0-9\-\/]{2,})",
)
TICKET_NUMBERS = (
    r"(?i)\b(\d{5,14})\s+\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s+\d{1,2}:\d{2}\b",
    r"(?i)(?:date\s+heure|heure\s+date)[^\n]*\n[^\d]{0,24}(\d{5,14})\s+\d{1,2}[./-]\d{1,2}[./-]\d{2,4}",
    r"(?i)(?:ticket|recu|receipt|transaction|trx|caisse)\s*(?:n|no|num|numero|#)?\s*[:.-]?\s*([a-z0-9][a-z0-9/-]{2,})",
    r"(?i)\b(?:tkt|tc)\s*[:.-]?\s*([a-z0-9][a-z0-9/-]{2,})",
)
INVOICE_NUMBERS = (
    r"(?i)(?:invoice|facture)\s*(?:n|no|num|numero|number|#)?\s*[:.-]?\s*([a-z0-9][a-z0-9/-]{2,})",
    r"(?i)(?:n|no|num|numero|#)\s*(?:facture|invoice)?\s*[:.-]?\s*([a-z0-9][a-z0-9/-]{2,})",
)
TAX_IDS = (r"(?i)(?:tax id|vat|tva|matricule|identifiant fiscal)[^\d]{0,30}(\d{6,20})", r"\b(\d{13,20})\b")
# Canonical names of laboratory tests and categories, first hit wins.
TEST_NAMES = {
    "tsh": ("tsh", "thyreostimuline"), "vitamin_d": ("vitamine d", "hydroxy", "25-oh"), "glucose": ("glycem", "glucose"), "cholesterol_total": ("cholesterol total",),
    "hdl_cholesterol": ("hdl",), "ldl_cholesterol": ("ldl",), "triglycerides": ("triglycer",), "creatinine": ("creatinin",), "urea": ("uree", "urée"),
    "hemoglobin": ("hemoglob", "hémoglob"), "hematocrit": ("hematocrit", "hématocrit"), "leukocytes": ("leucocyt", "leukocyt"), "platelets": ("plaquette", "platelet"), "crp": ("crp", "c reactive"),
}
TEST_CATEGORIES = {
    "hematology": ("hemoglob", "hémoglob", "leucocyt", "plaquette", "hematocrit"), "hormonology": ("tsh", "thyre", "vitamine d"),
    "serology": ("crp", "anticorps", "hiv", "hbs", "serolog"), "biochemistry": ("glycem", "glucose", "creatinin", "uree", "cholesterol", "hdl", "ldl"),
}
BLANKS = r"[\s  ]+"
MONEY = r"(?<!\d)(?:\d{1,4}(?:[   ]\d{3})+|\d{1,6})\s*[,.]\s*\d{2,3}(?!\d)"
MOST_ITEMS = 12
LETTERS = "A-Za-zÀ-ÿ"


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of the words, in any case; the words are plain text."""
    return F.regexp_like(F.lower(text), F.lit("|".join(words)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cleaned(line: Column) -> Column:
    """White space runs as one blank, no blanks or rules at the ends."""
    return F.regexp_replace(F.regexp_replace(line, BLANKS, " "), r"^[ \-_:;|]+|[ \-_:;|]+$", "")


def title(text: Column) -> Column:
    """Each run of letters gets a capital, also after an apostrophe or a dash."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0)), F.initcap), "")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that is found, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def money_texts(text: Column) -> Column:
    """Amounts of two or three decimals without their blanks, each once, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), lambda x: F.regexp_replace(x, BLANKS, ""))
    return F.array_distinct(F.concat(found, amount_texts(text)))


def best_amount(text: Column, words: tuple[str, ...] = TOTAL_WORDS) -> Column:
    """The largest amount of the lines with one of the words, else of the whole text; of equal ones the first; '' for none."""
    lines = F.filter(F.split(text, "\n"), lambda x: has_any(x, words))
    keyed = F.flatten(F.transform(lines, money_texts))
    found = _let(keyed, lambda k: F.when(F.size(k) > 0, k).otherwise(money_texts(text)))
    return F.coalesce(F.array_max(F.transform(found, lambda x, i: F.struct(amount_value(x).alias("value"), (-i).alias("place"), x.alias("text"))))["text"], F.lit(""))


def domain_name(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(DOMAIN), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, "^[ .-]+|[ .-]+$", "")))
    one = F.get(F.filter(found, lambda x: (x != "") & ~x.isin(*IGNORED_DOMAINS)), F.lit(0))
    return _let(one, lambda x: F.when(F.length(x) <= 3, F.upper(x)).otherwise(title(F.translate(x, "-", " "))))


def business_line(text: Column, skip: tuple[str, ...] = NO_STORE) -> Column:
    """The first line that reads like a name, in title case, or null."""
    good = lambda x: (F.length(x) >= 3) & ~has_any(x, skip) & (F.regexp_count(x, F.lit("[a-zA-Z]")) >= 3) & (F.regexp_count(x, F.lit(r"\d")) <= F.length(x) * 0.45)
    return title(F.trim(F.substring(F.get(F.filter(F.transform(F.split(text, "\n"), cleaned), good), F.lit(0)), 1, 90)))


def store_name(text: Column) -> Column:
    """Its domain, else a known brand, else its first business line unless that is noise; '' for none."""
    brand = F.coalesce(*[F.when(F.regexp_like(F.lower(text), F.lit(rf"\b{b}\b")), F.lit(b.upper())) for b in BRANDS])

    def quiet(line: Column) -> Column:
        letters, digits = F.regexp_count(line, F.lit(f"[{LETTERS}]")), F.regexp_count(line, F.lit(r"\d"))
        noise = F.contains(line, F.lit("°")) | (letters < 2) | ((digits > letters) & ~F.regexp_like(line, F.lit(r"(?i)\b7\s*-?\s*eleven\b")))
        return F.when(~noise, line)

    return F.coalesce(domain_name(text), brand, _let(business_line(text), quiet), F.lit(""))


def ticket_number(text: Column) -> Column:
    ends = lambda c: F.regexp_replace(c, "^[ .:-]+|[ .:-]+$", "")
    return F.coalesce(ends(first_match(text, RECEIPT_NUMBERS)), F.upper(ends(first_match(text, TICKET_NUMBERS))), F.lit(""))


def invoice_number(text: Column) -> Column:
    """The first pattern's match that has two digits, in capitals."""
    found = [F.upper(F.regexp_replace(first_match(text, (p,)), "^[ .:-]+|[ .:-]+$", "")) for p in INVOICE_NUMBERS]
    return F.coalesce(*[F.when(F.regexp_count(x, F.lit(r"\d")) >= 2, x) for x in found], F.lit(""))


def text_items(text: Column, total: Column, skip: tuple[str, ...], shortest: int, widest: int) -> Column:
    """description, unit_price (the first of several amounts, else ''), amount (the last) of the lines with one; not the total's; 12 at most. A null text has none."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), cleaned), lambda x: (F.length(x) >= shortest) & ~has_any(x, skip))
    read = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), money_texts(x).alias("found"))), lambda r: F.size(r["found"]) > 0)
    rows = F.transform(read, lambda r: F.struct(
        cleaned(F.aggregate(r["found"], r["line"], lambda a, v: F.replace(a, v, F.lit(" ")))).alias("description"),
        F.when(F.size(r["found"]) > 1, r["found"][0]).otherwise("").alias("unit_price"), F.element_at(r["found"], -1).alias("amount")))
    named = F.filter(rows, lambda r: (F.length(r["description"]) >= 3) & (F.regexp_count(r["description"], F.lit("[a-zA-Z]")) >= 2) & ((digits(total) == "") | (digits(r["amount"]) != digits(total))))
    return F.transform(F.slice(named, 1, MOST_ITEMS), lambda r: r.withField("description", F.substring(r["description"], 1, widest)))


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _codes(**missing: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in missing.items()]))


def _points(*weighed: tuple[float, Column]) -> Column:
    out = F.lit(0.0)
    for weight, c in weighed:
        out = out + F.when(c, F.lit(weight)).otherwise(0.0)
    return out


def _lowered(quality: Column, warnings: Column, above: float, step: float, most: int) -> Column:
    n = F.least(F.size(warnings), F.lit(most))
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))
    return F.round(F.greatest(F.lit(0.0), q - F.when(q > above, step * n).otherwise(0.0)), 3)


def receipt_check(store: Column, day: Column, total: Column, money: Column, items: Column) -> Column:
    """The warnings and the quality of a receipt. Null and blank count as missing."""
    warnings = _codes(MISSING_STORE=~present(store), MISSING_TOTAL=~present(total), NO_ITEMS=F.size(items) == 0)
    named = F.coalesce(F.try_divide(F.size(F.filter(items, lambda r: present(r["description"]))), F.size(items)), F.lit(0.0))
    q = _points((0.22, present(store)), (0.18, present(day)), (0.2, present(total)), (0.15, present(money))) + 0.25 * named
    return F.struct(warnings.alias("warnings"), _lowered(q, warnings, 0.9, 0.06, 3).alias("quality"))


def bill_check(reference: Column, amount: Column, due: Column, start: Column, end: Column, note: Column) -> Column:
    """The warnings and the quality of a bill: a base by its note of confidence times what is filled."""
    said = F.lower(F.trim(F.coalesce(note, F.lit(""))))
    warnings = _codes(MISSING_REFERENCE=~present(reference), MISSING_AMOUNT=~present(amount), MISSING_DUE_DATE=~present(due), MISSING_CONFIDENCE_NOTE=said == "")
    base = F.when(said == "high", 0.88).when(said == "medium", 0.62).when(said == "low", 0.38).otherwise(0.52)
    filled = sum((present(c).cast("int") for c in (reference, amount, due, start, end)), F.lit(0))
    return F.struct(warnings.alias("warnings"), _lowered(base * (0.55 + 0.09 * filled), warnings, -1.0, 0.05, 4).alias("quality"))


def invoice_check(number: Column, day: Column, due: Column, money: Column, seller: Column, client: Column, tax_id: Column, total: Column, tax: Column, items: Column) -> Column:
    """The warnings and the quality of a supplier's invoice: weights of what is filled out of 8.2."""
    warnings = _codes(MISSING_INVOICE_NUMBER=~present(number), MISSING_INVOICE_DATE=~present(day), MISSING_SELLER=~present(seller), MISSING_TOTAL=~present(total), NO_LINE_ITEMS=F.size(items) == 0)
    named = F.coalesce(F.try_divide(F.size(F.filter(items, lambda r: present(r["description"]))), F.size(items)), F.lit(0.0))
    filled = _points((1.0, present(number)), (1.0, present(day)), (0.5, present(due)), (0.5, present(money)), (1.0, present(seller)), (0.7, present(client)), (0.4, present(tax_id)), (1.2, present(total)), (0.4, present(tax))) + 1.5 * named
    return F.struct(warnings.alias("warnings"), _lowered(filled / 8.2, warnings, 0.88, 0.06, 4).alias("quality"))


def tolerant_number(raw: Column) -> Column:
    """A comma is a decimal point, blanks go; null for what is no number."""
    return F.replace(F.replace(raw, F.lit(" ")), F.lit(","), F.lit(".")).try_cast("double")


def reference_range(raw: Column) -> Column:
    """The least and the largest of two numbers or more; nulls else. Dashes part numbers."""
    tokens = F.split(F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), "[aà-]", " "), r"\s+")
    found = F.array_compact(F.transform(tokens, lambda x: x.try_cast("double")))
    two = F.size(found) >= 2
    return F.struct(F.when(two, F.array_min(found)).alias("low"), F.when(two, F.array_max(found)).alias("high"))


def _first_key(text: Column, keys: dict[str, tuple[str, ...]], other: str) -> Column:
    return F.coalesce(*[F.when(has_any(text, words), F.lit(name)) for name, words in keys.items()], F.lit(other))


def test_name(raw: Column) -> Column:
    return _first_key(raw, TEST_NAMES, "unknown")


def test_category(raw: Column) -> Column:
    return _first_key(raw, TEST_CATEGORIES, "other")


HEADS = ("Bienvenue www . zara-home . com", "** Carrefour Market **", " - l'épicerie d'o'neil 3 -", "N° 5", "ticket de caisse\nfacebook.com\nboulangerie 12", "2200112 33 a b c")


def _slips(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a noisy slip: a head, a number in one of five shapes, items with four shapes of amounts, lines that are none, a total."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    thousands = F.floor(whole / 1000)
    grouped = F.when(thousands > 0, F.concat(thousands.cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    amount = F.when(k == 0, F.concat_ws(",", whole, rest)).when(k == 1, F.concat_ws(" . ", whole, rest)).when(k == 2, F.concat_ws(",", grouped, rest)).otherwise(F.concat(F.lit("x 10,00 "), whole.cast("string"), F.lit("."), rest))
    p = F.col("l_partkey") % 7
    line = F.when(p == 0, F.concat(F.lit("TVA incluse "), amount)).when(p == 1, "Remise fidele").when(p == 2, "a 1").otherwise(F.concat(F.lit(" | Article  nr "), (F.col("l_partkey") % 50).cast("string"), F.lit(" : "), amount, F.lit(" ;")))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", line.alias("line")).alias("x"), cents.alias("cents"))
    rows = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"), F.sum("cents").alias("cents"))
    o = F.col("l_orderkey")
    key = o.cast("string")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (o % 6 + 1).cast("int"))
    number = (
        F.when(o % 5 == 0, F.concat(F.lit("Invoice No: INV-"), key, F.lit("/A"))).when(o % 5 == 1, F.concat(F.lit("Receipt # r"), key)).when(o % 5 == 2, F.concat(F.lit("caisse no 40"), key))
        .when(o % 5 == 3, F.concat(F.lit("tc: 77/"), key)).otherwise(F.concat(F.lit("12345"), key, F.lit(" 03/04/2024 12:30")))
    )
    total = F.concat(F.lit("TOTAL TTC : "), F.floor(F.col("cents") / 100).cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.when(o % 3 == 0, " EUR").when(o % 3 == 1, " dinars").otherwise(""))
    return rows.select(o.alias("order_id"), F.concat_ws("\n", head, number, "body", F.when(o % 4 != 0, total)).alias("text"))


def receipt_fields(spark: SparkSession, d: str) -> DataFrame:
    """Store, number, total, currency and items of each noisy slip, with warnings and quality."""
    text = F.col("text")
    rows = _slips(spark, d).select("order_id", "text", store_name(text).alias("store"), ticket_number(text).alias("ticket"), best_amount(text).alias("total"), currency(text).alias("currency"))
    rows = rows.withColumn("items", text_items(text, F.col("total"), NO_RECEIPT_ITEM, 5, 120))
    day = F.regexp_extract("text", r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0)
    rows = rows.withColumn("check", receipt_check(F.col("store"), day, F.col("total"), F.col("currency"), F.col("items")))
    first = F.get("items", F.lit(0))
    return rows.select("order_id", "store", "ticket", "total", "currency", F.size("items").alias("n_items"), first["description"].alias("first_item"), first["amount"].alias("first_amount"), F.array_join("check.warnings", ";").alias("warnings"), F.col("check.quality").alias("quality"))


def supplier_fields(spark: SparkSession, d: str) -> DataFrame:
    """The noisy slips read as suppliers' invoices: number, tax id, items with unit prices, warnings and quality."""
    text = F.col("text")
    rows = _slips(spark, d).select("order_id", "text", invoice_number(text).alias("number"), F.coalesce(first_match(text, TAX_IDS), F.lit("")).alias("tax_id"), best_amount(text).alias("total"), store_name(text).alias("seller"), currency(text).alias("currency"))
    rows = rows.withColumn("items", text_items(text, F.col("total"), NO_INVOICE_ITEM, 6, 140))
    day, none = F.regexp_extract("text", r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0), F.lit(None).cast("string")
    rows = rows.withColumn("check", invoice_check(F.col("number"), day, none, F.col("currency"), F.col("seller"), none, F.col("tax_id"), F.col("total"), none, F.col("items")))
    return rows.select("order_id", "number", "tax_id", F.size("items").alias("n_items"), F.size(F.filter("items", lambda r: r["unit_price"] != "")).alias("n_unit_prices"), F.array_join("check.warnings", ";").alias("warnings"), F.col("check.quality").alias("quality"))


def bill_quality(spark: SparkSession, d: str) -> DataFrame:
    """Orders as bills with fields and notes missing by turns: how many have which warnings and quality."""
    k = F.col("o_orderkey")
    gone = lambda n: F.when(k % n != 0, F.lit("x"))
    note = F.element_at(F.array(*map(F.lit, ["high", " Medium ", "low", "", "sure"])), (k % 5 + 1).cast("int"))
    check = bill_check(gone(2), gone(3), F.when(k % 7 == 0, " ").otherwise("x"), gone(11), gone(13), note)
    return table(spark, d, "orders").select(check.alias("c")).groupBy(F.array_join("c.warnings", ";").alias("warnings"), F.col("c.quality").alias("quality")).agg(F.count("*").alias("n"))


LAB_NAMES = ("Glycémie à jeun (GLUCOSE)", "TSH ultra", "Cholesterol total", "HDL", "Anticorps HBs", "Hémoglobine", "Plaquettes", "Urée", "Ferritine")


def lab_tests(spark: SparkSession, d: str) -> DataFrame:
    """Laboratory rows with numbers and ranges in several shapes: canonical name, category, value, range, status and confidence."""
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*map(F.lit, LAB_NAMES)), (k % 9 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    value = F.when(k % 5 == 0, "traces").when(k % 5 == 1, F.concat(size, F.lit(",5"))).when(k % 5 == 2, F.concat(F.lit(" "), size)).when(k % 5 == 3, F.concat(F.lit("1 "), size)).otherwise(F.concat(size, F.lit(".25")))
    bounds = F.when(k % 4 == 0, "10,5 - 30").when(k % 4 == 1, "40 à 12").when(k % 4 == 2, "< 20").otherwise("5-15-25")
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"), tolerant_number(value).alias("value"), reference_range(bounds).alias("r"))
    v, low, high = F.col("value"), F.col("r.low"), F.col("r.high")
    status = F.when(v.isNull() | low.isNull() | high.isNull(), "unknown").when(v < low, "low").when(v > high, "high").otherwise("normal")
    return rows.select("p_partkey", test_name(F.col("raw")).alias("name"), test_category(F.col("raw")).alias("category"), "value", low.alias("low"), high.alias("high"), status.alias("status"), F.when(v.isNotNull(), 0.7).otherwise(0.4).alias("confidence"))


QUERIES = {f.__name__: f for f in (receipt_fields, supplier_fields, bill_quality, lab_tests)}


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _first_sql(patterns: tuple[str, ...], wrap: str = "{0}") -> str:
    return ", ".join(wrap.format(f"nullif(regexp_extract(text, '{p}', 1), '')") for p in patterns)


def _key_sql(keys: dict[str, tuple[str, ...]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql('raw', w)} THEN '{k}'" for k, w in keys.items()) + f" ELSE '{other}' END"


_CLEAN = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^[ \-_:;|]+|[ \-_:;|]+$', '', 'g')"
_TITLE = f"array_to_string(list_transform(regexp_extract_all({{0}}, '[{LETTERS}]+|[^{LETTERS}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_ENDS = "regexp_replace({0}, '^[ .:-]+|[ .:-]+$', '', 'g')"
# No look-around here: digits of the fixtures touch no letters where amounts are.
_FOUND = r"list_transform(list_concat(regexp_extract_all({0}, '\b(?:\d{{1,4}}(?: \d{{3}})+|\d{{1,6}})\s*[,.]\s*\d{{2,3}}\b'), regexp_extract_all({0}, '\b\d{{1,4}}\s*[,.]\s*\d{{3}}\b')), lambda x: regexp_replace(x, '\s+', '', 'g'))"
_VALUE = "coalesce(TRY_CAST(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE), -1.0)"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_SLIPS_SQL = f"""l AS (SELECT l_orderkey AS o, l_linenumber AS nr, l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, (l_orderkey + l_linenumber) % 4 AS k FROM lineitem),
w AS (SELECT *, CAST(cents // 100 AS VARCHAR) AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS rest, cents // 100000 AS th FROM l),
a AS (SELECT *, CASE k WHEN 0 THEN whole || ',' || rest WHEN 1 THEN whole || ' . ' || rest WHEN 2 THEN CASE WHEN th > 0 THEN th || ' ' || right(whole, 3) ELSE whole END || ',' || rest ELSE 'x 10,00 ' || whole || '.' || rest END AS amount FROM w),
i AS (SELECT o, nr, cents, CASE p % 7 WHEN 0 THEN 'TVA incluse ' || amount WHEN 1 THEN 'Remise fidele' WHEN 2 THEN 'a 1' ELSE ' | Article  nr ' || (p % 50) || ' : ' || amount || ' ;' END AS line FROM a),
g AS (SELECT o, string_agg(line, chr(10) ORDER BY nr, line) AS body, sum(cents)::BIGINT AS cents FROM i GROUP BY o),
t AS (SELECT o AS order_id, concat_ws(chr(10), CASE o % 6 {" ".join(f"WHEN {n} THEN '" + h.replace("'", "''").replace(chr(10), "' || chr(10) || '") + "'" for n, h in enumerate(HEADS))} END,
  CASE o % 5 WHEN 0 THEN 'Invoice No: INV-' || o || '/A' WHEN 1 THEN 'Receipt # r' || o WHEN 2 THEN 'caisse no 40' || o WHEN 3 THEN 'tc: 77/' || o ELSE '12345' || o || ' 03/04/2024 12:30' END, body,
  CASE WHEN o % 4 <> 0 THEN 'TOTAL TTC : ' || (cents // 100) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || CASE o % 3 WHEN 0 THEN ' EUR' WHEN 1 THEN ' dinars' ELSE '' END END) AS text FROM g),
ln AS (SELECT order_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
c AS (SELECT order_id, i, raw, {_CLEAN.format('raw')} AS x FROM ln),
m AS (SELECT order_id, i, j, v, {_VALUE.format('v')} AS val, {_any_sql('raw', TOTAL_WORDS)} AS keyed FROM (SELECT order_id, i, raw, unnest({_FOUND.format('raw')}) AS v, generate_subscripts({_FOUND.format('raw')}, 1) AS j FROM ln)),
tot AS (SELECT order_id, v AS total FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY keyed DESC, val DESC, i, j) AS r FROM m) WHERE r = 1),
bl AS (SELECT order_id, {_TITLE.format('trim(arg_min(x, i)[1:90])')} AS line FROM c WHERE length(x) >= 3 AND NOT {_any_sql('x', NO_STORE)} AND {_COUNT.format('x', '[a-zA-Z]')} >= 3 AND {_COUNT.format('x', '[0-9]')} <= length(x) * 0.45 GROUP BY order_id),
dm AS (SELECT order_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '{DOMAIN}', 1), lambda x: lower(trim(x, ' .-'))), lambda x: x <> '' AND x NOT IN {IGNORED_DOMAINS})[1] AS dom,
  CASE {" ".join(f"WHEN regexp_matches(lower(text), '\\b{b}\\b') THEN '{b.upper()}'" for b in BRANDS)} END AS brand FROM t),
f AS (SELECT t.order_id, text, coalesce(total, '') AS total, coalesce(CASE WHEN length(dom) <= 3 THEN upper(dom) ELSE {_TITLE.format("replace(dom, '-', ' ')")} END, brand,
    CASE WHEN NOT contains(line, '°') AND {_COUNT.format('line', f'[{LETTERS}]')} >= 2 AND {_COUNT.format('line', '[0-9]')} <= {_COUNT.format('line', f'[{LETTERS}]')} THEN line END, '') AS store,
    CASE WHEN regexp_matches(lower(text), ' tnd|dt|dinar') THEN 'TND' WHEN regexp_matches(lower(text), ' eur|euro') THEN 'EUR' WHEN regexp_matches(lower(text), ' usd|dollar') THEN 'USD' ELSE '' END AS currency,
    contains(text, '03/04/2024') AS dated FROM t LEFT JOIN tot USING (order_id) LEFT JOIN bl USING (order_id) LEFT JOIN dm USING (order_id))"""


def _items_sql(skip: tuple[str, ...], shortest: int) -> str:
    digits = r"regexp_replace({0}, '\D', '', 'g')"
    return f"""it0 AS (SELECT order_id, i, x, {_FOUND.format('x')} AS found FROM c WHERE length(x) >= {shortest} AND NOT {_any_sql('x', skip)}),
u AS (SELECT order_id, i, x, list_transform(list_filter(list_zip(found, range(len(found))), lambda z: list_position(found, z[1]) = z[2] + 1), lambda z: z[1]) AS found FROM it0 WHERE len(found) > 0),
it1 AS (SELECT order_id, i, found[1] AS one, found[-1] AS amount, len(found) AS n, {_CLEAN.format("list_reduce(list_concat([x], found), lambda a, v: replace(a, v, ' '))")} AS description FROM u),
it AS (SELECT it1.*, row_number() OVER (PARTITION BY order_id ORDER BY i) AS r FROM it1 JOIN f USING (order_id) WHERE length(description) >= 3 AND {_COUNT.format('description', '[a-zA-Z]')} >= 2 AND (total = '' OR {digits.format('amount')} <> {digits.format('total')}))"""


ORACLES = {
    "receipt_fields": f"""WITH {_SLIPS_SQL}, {_items_sql(NO_RECEIPT_ITEM, 5)},
        s AS (SELECT order_id, CAST(count(*) AS INTEGER) AS n_items, min(description) FILTER (r = 1) AS first_item, min(amount) FILTER (r = 1) AS first_amount FROM it WHERE r <= {MOST_ITEMS} GROUP BY 1),
        q AS (SELECT f.*, coalesce(n_items, 0) AS n_items, first_item, first_amount, list_filter([CASE WHEN store = '' THEN 'MISSING_STORE' END, CASE WHEN total = '' THEN 'MISSING_TOTAL' END, CASE WHEN n_items IS NULL THEN 'NO_ITEMS' END], lambda x: x IS NOT NULL) AS wn,
          CAST(CASE WHEN store <> '' THEN 0.22 ELSE 0 END + CASE WHEN dated THEN 0.18 ELSE 0 END + CASE WHEN total <> '' THEN 0.2 ELSE 0 END + CASE WHEN currency <> '' THEN 0.15 ELSE 0 END + CASE WHEN n_items > 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS q FROM f LEFT JOIN s USING (order_id))
        SELECT order_id, store, coalesce({_first_sql(RECEIPT_NUMBERS, _ENDS)}, {_first_sql(TICKET_NUMBERS, 'upper(' + _ENDS + ')')}, '') AS ticket, total, currency, n_items, first_item[1:120] AS first_item, first_amount, array_to_string(wn, ';') AS warnings,
          round(greatest(0.0, q - CASE WHEN q > 0.9 THEN 0.06 * least(len(wn), 3) ELSE 0 END), 3) AS quality FROM q""",
    "supplier_fields": f"""WITH {_SLIPS_SQL}, {_items_sql(NO_INVOICE_ITEM, 6)},
        s AS (SELECT order_id, CAST(count(*) AS INTEGER) AS n_items, CAST(count(*) FILTER (n > 1) AS INTEGER) AS n_unit_prices FROM it WHERE r <= {MOST_ITEMS} GROUP BY 1),
        b AS (SELECT f.*, coalesce(n_items, 0) AS n_items, coalesce(n_unit_prices, 0) AS n_unit_prices, coalesce({_first_sql(TAX_IDS)}, '') AS tax_id, [{_first_sql(INVOICE_NUMBERS, 'upper(' + _ENDS + ')')}] AS nums FROM f LEFT JOIN s USING (order_id)),
        n AS (SELECT *, coalesce(list_filter(nums, lambda x: {_COUNT.format('x', '[0-9]')} >= 2)[1], '') AS number FROM b),
        q AS (SELECT *, list_filter([CASE WHEN number = '' THEN 'MISSING_INVOICE_NUMBER' END, CASE WHEN NOT dated THEN 'MISSING_INVOICE_DATE' END, CASE WHEN store = '' THEN 'MISSING_SELLER' END, CASE WHEN total = '' THEN 'MISSING_TOTAL' END, CASE WHEN n_items = 0 THEN 'NO_LINE_ITEMS' END], lambda x: x IS NOT NULL) AS wn,
          CAST(CASE WHEN number <> '' THEN 1 ELSE 0 END + CASE WHEN dated THEN 1 ELSE 0 END + CASE WHEN currency <> '' THEN 0.5 ELSE 0 END + CASE WHEN store <> '' THEN 1 ELSE 0 END + CASE WHEN tax_id <> '' THEN 0.4 ELSE 0 END + CASE WHEN total <> '' THEN 1.2 ELSE 0 END + CASE WHEN n_items > 0 THEN 1.5 ELSE 0 END AS DOUBLE) / 8.2 AS q FROM n)
        SELECT order_id, number, tax_id, n_items, n_unit_prices, array_to_string(wn, ';') AS warnings, round(greatest(0.0, q - CASE WHEN q > 0.88 THEN 0.06 * least(len(wn), 4) ELSE 0 END), 3) AS quality FROM q""",
    "bill_quality": """WITH b AS (SELECT o_orderkey AS k, ['high', 'medium', 'low', '', 'sure'][o_orderkey % 5 + 1] AS note FROM orders),
        w AS (SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN 'MISSING_REFERENCE' END, CASE WHEN k % 3 = 0 THEN 'MISSING_AMOUNT' END, CASE WHEN k % 7 = 0 THEN 'MISSING_DUE_DATE' END, CASE WHEN note = '' THEN 'MISSING_CONFIDENCE_NOTE' END], lambda x: x IS NOT NULL) AS wn,
          (CASE note WHEN 'high' THEN 0.88 WHEN 'medium' THEN 0.62 WHEN 'low' THEN 0.38 ELSE 0.52 END)::DOUBLE * (0.55::DOUBLE + 0.09::DOUBLE * ((k % 2 <> 0)::INT + (k % 3 <> 0)::INT + (k % 7 <> 0)::INT + (k % 11 <> 0)::INT + (k % 13 <> 0)::INT)) AS q FROM b)
        SELECT array_to_string(wn, ';') AS warnings, round(greatest(0.0::DOUBLE, q - 0.05::DOUBLE * least(len(wn), 4)), 3) AS quality, count(*) AS n FROM w GROUP BY 1, 2""",
    "lab_tests": f"""WITH p AS (SELECT p_partkey, p_partkey AS k, {list(LAB_NAMES)!r}[p_partkey % 9 + 1] AS raw, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size WHEN 3 THEN CAST('1' || p_size AS DOUBLE) ELSE p_size + 0.25 END::DOUBLE AS value FROM part),
        r AS (SELECT *, CASE k % 4 WHEN 0 THEN 10.5 WHEN 1 THEN 12 WHEN 3 THEN 5 END::DOUBLE AS low, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 40 WHEN 3 THEN 25 END::DOUBLE AS high FROM p)
        SELECT p_partkey, {_key_sql(TEST_NAMES, 'unknown')} AS name, {_key_sql(TEST_CATEGORIES, 'other')} AS category, value, low, high,
          CASE WHEN value IS NULL OR low IS NULL THEN 'unknown' WHEN value < low THEN 'low' WHEN value > high THEN 'high' ELSE 'normal' END AS status, CASE WHEN value IS NULL THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM r""",
}
