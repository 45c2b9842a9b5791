"""Fields of single records: labels of kinds, dates, amounts, scripts, currencies, file checks, display dates, file names and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import from_url_key
from ..sources.ledger import LEDGER_SQL, ledger, table

# Labels of kinds.
KIND_LABELS = {
    "steg_ocr": "Facture STEG (OCR local)",
    "steg_gemini": "Facture STEG (Gemini)",
    "steg_local": "Facture STEG (Docling + Qwen local)",
    "medical_ocr": "Analyse medicale (OCR structure)",
    "medical_gemini": "Analyse medicale (Gemini)",
    "medical_local": "Analyse medicale (Docling + Qwen local)",
    "receipt": "Ticket de caisse",
    "receipt_test": "Ticket de caisse (import historique)",
    "receipt_local": "Ticket de caisse (Docling + Qwen local)",
    "supplier_invoice": "Facture fournisseur",
    "supplier_invoice_local": "Facture fournisseur (Docling + Qwen local)",
    "document_local": "Document (Docling + Qwen local)",
    "extraction_error": "Traitement a verifier",
}
# Accepted suffixes, the largest size, image types, short months.
SUFFIXES = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp")
MOST_BYTES = 20 * 1024 * 1024
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}
MONTHS = ("Jan", "Fev", "Mars", "Avr", "Mai", "Juin", "Juil", "Aout", "Sept", "Oct", "Nov", "Dec")
EASTERN, LATIN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(KIND_LABELS), kind), kind)


def method_label(kind: Column) -> Column:
    return (
        F.when(kind == "extraction_error", "Extraction").when(kind.endswith("_local"), "Pipeline IA local").when(kind == "receipt_test", "Dataset test annote")
        .when(kind.endswith("_gemini") | kind.isin("receipt", "supplier_invoice"), "Gemini API").when(kind.endswith("_ocr"), "OCR local").otherwise("Mixte")
    )


def family_label(kind: Column) -> Column:
    return (
        F.when(kind == "extraction_error", "Erreur").when(kind.startswith("steg_"), "Facture STEG").when(kind.startswith("medical_"), "Analyse medicale")
        .when(kind.isin("receipt", "receipt_local", "receipt_test"), "Ticket de caisse").when(kind.isin("supplier_invoice", "supplier_invoice_local"), "Facture fournisseur").otherwise("Autre")
    )


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by kind with its label, method, family and status, most first. Kinds are dealt to events by id; one of them is unknown."""
    kinds = F.array(*map(F.lit, [*KIND_LABELS, "other_kind"]))
    rows = table(spark, d, "events").select(F.element_at(kinds, (F.col("event_id") % (len(KIND_LABELS) + 1) + 1).cast("int")).alias("kind"))
    status = F.when(F.col("kind") == "extraction_error", "error").otherwise("ok")
    return rows.groupBy("kind").agg(F.count("*").alias("n")).select("kind", kind_label(F.col("kind")).alias("label"), method_label(F.col("kind")).alias("method"), family_label(F.col("kind")).alias("family"), status.alias("status"), "n")


def _calendar(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string")


def _repaired(year: Column) -> Column:
    """A year misread with a leading 9."""
    return F.when(year.startswith("9"), F.concat(F.lit("2"), F.substring(year, 2, 3))).otherwise(year)


def iso_dates(text: Column) -> Column:
    """All dates of a text that the calendar has, as ISO text, each once: year first, then year last, then short years."""

    def found(pattern: str, date) -> Column:
        parts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.split(x, "[./-]"))
        return F.transform(parts, date)

    short = lambda y: F.concat(F.when(y.cast("int") <= 79, F.lit("20")).otherwise(F.lit("19")), y)
    every = F.concat(
        found(r"\b[29]0\d{2}[./-]\d{1,2}[./-]\d{1,2}\b", lambda p: _calendar(_repaired(p[0]), p[1], p[2])),
        found(r"\b\d{1,2}[./-]\d{1,2}[./-][29]0\d{2}\b", lambda p: _calendar(_repaired(p[2]), p[1], p[0])),
        found(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2}\b", lambda p: _calendar(short(p[2]), p[1], p[0])),
    )
    return F.array_distinct(F.array_compact(every))


def amount_texts(text: Column) -> Column:
    """Amounts with three decimals as they stand, without blanks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{1,4}\s*[,.]\s*\d{3}\b"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))


def amount_value(raw: Column) -> Column:
    """Blanks and dots go, the comma is the decimal point; -1 for what is no number then."""
    return F.coalesce(F.replace(F.replace(F.replace(raw, F.lit(" ")), F.lit(".")), F.lit(","), F.lit(".")).try_cast("double"), F.lit(-1.0))


def _noisy(orders: DataFrame) -> DataFrame:
    """Lines as a scan would give them: five shapes of dates, misread years, impossible days, amounts with blanks, two numbers in a line."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    later = F.date_format(F.add_months(day, 240), "yyyy")
    date = (
        F.when(k % 5 == 0, F.concat(later, F.date_format(day, "-MM-dd"))).when(k % 5 == 1, F.concat(F.date_format(day, "d/M/"), later)).when(k % 5 == 2, F.date_format(day, "dd.MM.yy"))
        .when(k % 5 == 3, F.concat(F.lit("31/02/2024 puis 9"), F.substring(later, 2, 3), F.date_format(day, "/MM/dd"))).otherwise(F.lit("99-99-2024"))
    )
    whole, rest = F.floor("o_totalprice") % 10_000, F.lpad((F.floor(F.col("o_totalprice") * 1000) % 1000).cast("string"), 3, "0")
    amount = F.concat(whole.cast("string"), F.when(k % 3 == 0, ",").when(k % 3 == 1, " , ").otherwise("."), rest)
    return orders.select("o_orderkey", F.concat(F.lit("Ref 12 du "), date, F.lit(" net "), amount, F.when(k % 4 == 0, " dinars 7,5").when(k % 4 == 1, " EUR x").when(k % 4 == 2, " US Dollar").otherwise(" -")).alias("line"))


def field_dates(spark: SparkSession, d: str) -> DataFrame:
    """The first date of each noisy line, and how many it has."""
    dates = iso_dates(F.col("line"))
    return _noisy(table(spark, d, "orders")).select("o_orderkey", F.get(dates, F.lit(0)).alias("first_date"), F.size(dates).alias("n_dates"))


def currency(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    some = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lower, w))
    return F.when(some(" tnd", "dt", "dinars", "dinar"), "TND").when(some(" eur", "euro"), "EUR").when(some(" usd", "dollar"), "USD").otherwise("")


def field_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The amounts of each noisy line: how many, the first as text, as a number and in thousandths, and the currency."""
    rows = _noisy(table(spark, d, "orders")).withColumn("found", amount_texts(F.col("line"))).withColumn("amount_text", F.get("found", F.lit(0)))
    return rows.select("o_orderkey", F.size("found").alias("n_amounts"), "amount_text", amount_value(F.col("amount_text")).alias("amount"), F.round(amount_value(F.col("amount_text")) * 1000).cast("long").alias("thousandths"), currency(F.col("line")).alias("currency"))


def latin_digits(text: Column) -> Column:
    return F.translate(text, EASTERN, LATIN)


def arabic_ratio(text: Column) -> Column:
    """Arabic letters among Arabic and Latin ones, 0 where there are none."""
    arabic, latin = F.regexp_count(text, F.lit("[؀-ۿݐ-ݿࢠ-ࣿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.coalesce(F.try_divide(arabic, arabic + latin), F.lit(0.0))


def text_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean share of Arabic letters and texts that eastern digits are in, by language."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " فاتورة رقم ٤٢ ۷").otherwise(""))
    rows = table(spark, d, "documents").select("lang", text.alias("t"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg(arabic_ratio(F.col("t"))), 6).alias("arabic"), F.count_if(latin_digits(F.col("t")) != F.col("t")).alias("eastern"))


def accepted_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by suffix, with their image type: accepted ones, and those of a wrong suffix, no bytes or too many."""
    suffixes = F.array(*map(F.lit, ["PDF", "jpg", "jpeg", "png", "TIF", "webp", "bmp", "docx", "txt"]))
    rows = table(spark, d, "events").select(F.element_at(suffixes, (F.col("event_id") % 9 + 1).cast("int")).alias("s"), (F.col("event_id") * 4099 % 30_000_000).alias("size_bytes"))
    suffix = F.lower("s")
    right = suffix.isin(*SUFFIXES)
    reason = F.when(~right, "suffix").when(F.col("size_bytes") <= 0, "empty").when(F.col("size_bytes") > MOST_BYTES, "size").otherwise("accepted")
    return rows.groupBy(suffix.alias("suffix"), reason.alias("verdict")).agg(F.count("*").alias("n")).select("suffix", F.coalesce(F.try_element_at(_literal_map(MIME_TYPES), F.col("suffix")), F.lit("image/jpeg")).alias("mime"), "verdict", "n")


def short_date(iso: Column) -> Column:
    """``dd Mon yyyy``; what is no date stays as it is."""
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.coalesce(F.concat_ws(" ", F.date_format(day, "dd"), F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), F.date_format(day, "yyyy")), iso)


def display_dates(spark: SparkSession, d: str) -> DataFrame:
    """Orders by display date; impossible dates are shown as they are."""
    iso = F.when(F.col("o_orderkey") % 50 == 0, F.lit("2024-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    shown = F.when(day.isNull(), iso).otherwise(short_date(iso))
    return table(spark, d, "orders").groupBy(shown.alias("shown")).agg(F.count("*").alias("n"))


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """File names made safe, with _2, _3 and so on where one is taken already."""
    stem = F.regexp_replace(F.regexp_replace(F.concat(F.lit("  "), "c_mktsegment", F.lit(" / "), F.col("c_nationkey").cast("string"), F.lit(".")), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    rows = table(spark, d, "customer").select("c_custkey", F.substring(stem, 1, 80).alias("stem"))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("c_custkey"))
    return rows.select("c_custkey", F.concat("stem", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(".json")).alias("file_name"))


def entry_lookup(spark: SparkSession, d: str, key: str = "ZGI6Ly9leHRyYWN0aW9uX2hpc3RvcnkvNDI") -> DataFrame:
    """The ledger row that a key names; no row for a key that is none."""
    wanted = F.nullif(F.regexp_extract(from_url_key(F.lit(key)), r"^db://extraction_history/(\d+)$", 1), F.lit("")).cast("long")
    return ledger(table(spark, d, "events")).where(F.col("id") == wanted).select("id", "kind", "label", "family", "status", "quality", "n_warnings")


def hist_first_eight(spark: SparkSession, d: str) -> DataFrame:
    """The eight newest rows that are shown."""
    return ledger(table(spark, d, "events")).where("quality is null or quality > 0").orderBy(F.desc("saved_at"), F.desc("id")).limit(8).select("id", "kind", "label", "family", "quality")


COUNTERS = ("documents", "predicted_documents", "valid_json", "classification_expected", "classification_correct", "tp", "fp", "fn", "field_expected", "field_correct")


def all_rates(counts: DataFrame) -> DataFrame:
    """The ten counters with their seven rates, each 0 where it would divide by nothing."""
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    c = {x: F.col(x) for x in COUNTERS}
    return counts.withColumns({
        "coverage": rate(c["predicted_documents"], c["documents"]), "valid_json_rate": rate(c["valid_json"], c["predicted_documents"]),
        "classification_accuracy": rate(c["classification_correct"], c["classification_expected"]), "field_accuracy": rate(c["field_correct"], c["field_expected"]),
        "precision": rate(c["tp"], c["tp"] + c["fp"]), "recall": rate(c["tp"], c["tp"] + c["fn"]), "f1": rate(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
    })


def eval_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters and rates by order status, and of all orders (status null): an order's items predict its priority class and its total."""
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"), F.count("*").alias("items"))
    rows = table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    has, truth = F.col("total").isNotNull(), F.col("o_totalprice").cast("decimal(18,2)")
    hit = has & (F.abs(F.col("total") - truth) * 10 <= truth)
    right = has & (F.substring("o_orderpriority", 1, 1) == F.least(F.col("items"), F.lit(5)).cast("string"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    each = {
        "documents": F.lit(1), "predicted_documents": one(has), "valid_json": one(has & (F.col("items") < 7)), "classification_expected": one(has & F.col("o_orderpriority").isNotNull()),
        "classification_correct": one(right), "tp": one(hit), "fp": one(has & ~hit), "fn": one(~F.coalesce(hit, F.lit(False))), "field_expected": one(has), "field_correct": one(hit),
    }
    rows = rows.select("o_orderstatus", *[v.alias(k) for k, v in each.items()])
    return all_rates(rows.rollup("o_orderstatus").agg(*[F.sum(c).alias(c) for c in COUNTERS])).withColumnRenamed("o_orderstatus", "status")


QUERIES = {f.__name__: f for f in (kind_counts, field_dates, field_amounts, text_scripts, accepted_files, display_dates, unique_names, entry_lookup, hist_first_eight, eval_counters)}

_KINDS_SQL = ", ".join(f"('{k}')" for k in [*KIND_LABELS, "other_kind"])
_LABELS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_LABELS.items())
_NOISY_SQL = r"""b AS (SELECT o_orderkey, o_orderkey AS k, o_orderdate AS day, strftime(o_orderdate + INTERVAL 240 MONTH, '%Y') AS later, o_totalprice FROM orders),
n AS (SELECT o_orderkey, 'Ref 12 du ' || CASE WHEN k % 5 = 0 THEN later || strftime(day, '-%m-%d') WHEN k % 5 = 1 THEN strftime(day, '%-d/%-m/') || later WHEN k % 5 = 2 THEN strftime(day, '%d.%m.%y')
  WHEN k % 5 = 3 THEN '31/02/2024 puis 9' || later[2:4] || strftime(day, '/%m/%d') ELSE '99-99-2024' END || ' net ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS VARCHAR)
  || CASE k % 3 WHEN 0 THEN ',' WHEN 1 THEN ' , ' ELSE '.' END || lpad(CAST(CAST(floor(o_totalprice * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
  || CASE k % 4 WHEN 0 THEN ' dinars 7,5' WHEN 1 THEN ' EUR x' WHEN 2 THEN ' US Dollar' ELSE ' -' END AS line FROM b)"""
_ISO = "CAST(TRY_CAST({0} || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') AS DATE) AS VARCHAR)"
_FIX = "CASE WHEN {0}[1] = '9' THEN '2' || {0}[2:4] ELSE {0} END"
_PARTS = r"regexp_extract_all(line, '{0}')"
_SPLIT = "list_transform({0}, lambda x: regexp_split_to_array(x, '[./-]'))"
_Y, _L, _S = (_SPLIT.format(_PARTS.format(p)) for p in (r"\b[29]0\d{2}[./-]\d{1,2}[./-]\d{1,2}\b", r"\b\d{1,2}[./-]\d{1,2}[./-][29]0\d{2}\b", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2}\b"))
_DATES_SQL = f"""WITH {_NOISY_SQL}, e AS (SELECT o_orderkey, list_filter(list_concat(list_concat(
  list_transform({_Y}, lambda p: {_ISO.format(_FIX.format('p[1]'), 'p[2]', 'p[3]')}),
  list_transform({_L}, lambda p: {_ISO.format(_FIX.format('p[3]'), 'p[2]', 'p[1]')})),
  list_transform({_S}, lambda p: {_ISO.format("CASE WHEN CAST(p[3] AS INTEGER) <= 79 THEN '20' ELSE '19' END || p[3]", 'p[2]', 'p[1]')})), lambda x: x IS NOT NULL) AS f FROM n)
SELECT o_orderkey, f[1] AS first_date, CAST(len(list_distinct(f)) AS INTEGER) AS n_dates FROM e"""
_RATE = "coalesce(round(({0}) / nullif({1}, 0), 4), 0.0)"
_COUNTERS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
ORACLES = {
    "kind_counts": f"""WITH k AS (SELECT kind, row_number() OVER () - 1 AS i FROM (VALUES {_KINDS_SQL}) v(kind)), c AS (SELECT kind, count(*) AS n FROM events JOIN k ON event_id % {len(KIND_LABELS) + 1} = i GROUP BY kind)
        SELECT kind, CASE kind {_LABELS_SQL} ELSE kind END AS label,
          CASE WHEN kind = 'extraction_error' THEN 'Extraction' WHEN ends_with(kind, '_local') THEN 'Pipeline IA local' WHEN kind = 'receipt_test' THEN 'Dataset test annote'
            WHEN ends_with(kind, '_gemini') OR kind IN ('receipt', 'supplier_invoice') THEN 'Gemini API' WHEN ends_with(kind, '_ocr') THEN 'OCR local' ELSE 'Mixte' END AS method,
          CASE WHEN kind = 'extraction_error' THEN 'Erreur' WHEN starts_with(kind, 'steg_') THEN 'Facture STEG' WHEN starts_with(kind, 'medical_') THEN 'Analyse medicale'
            WHEN kind LIKE 'receipt%' THEN 'Ticket de caisse' WHEN kind LIKE 'supplier_invoice%' THEN 'Facture fournisseur' ELSE 'Autre' END AS family,
          CASE WHEN kind = 'extraction_error' THEN 'error' ELSE 'ok' END AS status, n FROM c""",
    "field_dates": _DATES_SQL,
    "field_amounts": rf"""WITH {_NOISY_SQL}, f AS (SELECT o_orderkey, line, list_transform(regexp_extract_all(line, '\b\d{{1,4}}\s*[,.]\s*\d{{3}}\b'), lambda x: regexp_replace(x, '\s+', '', 'g')) AS found FROM n),
        v AS (SELECT *, coalesce(TRY_CAST(replace(replace(replace(found[1], ' ', ''), '.', ''), ',', '.') AS DOUBLE), -1.0) AS amount FROM f)
        SELECT o_orderkey, CAST(len(found) AS INTEGER) AS n_amounts, found[1] AS amount_text, amount, CAST(round(amount * 1000) AS BIGINT) AS thousandths,
          CASE WHEN regexp_matches(lower(line), ' tnd|dt|dinar') THEN 'TND' WHEN regexp_matches(lower(line), ' eur|euro') THEN 'EUR' WHEN regexp_matches(lower(line), ' usd|dollar') THEN 'USD' ELSE '' END AS currency FROM v""",
    "text_scripts": rf"""WITH t AS (SELECT lang, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' فاتورة رقم ٤٢ ۷' ELSE '' END AS t FROM documents),
        c AS (SELECT lang, t, len(regexp_extract_all(t, '[\x{{0600}}-\x{{06ff}}\x{{0750}}-\x{{077f}}\x{{08a0}}-\x{{08ff}}]')) AS a, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM t)
        SELECT lang, count(*) AS docs, round(avg(coalesce(a / nullif(a + l, 0), 0.0)), 6) AS arabic, count(*) FILTER (translate(t, '{EASTERN}', '{LATIN}') <> t) AS eastern FROM c GROUP BY lang""",
    "accepted_files": f"""WITH e AS (SELECT lower(['PDF', 'jpg', 'jpeg', 'png', 'TIF', 'webp', 'bmp', 'docx', 'txt'][event_id % 9 + 1]) AS suffix, event_id * 4099 % 30000000 AS size_bytes FROM events)
        SELECT suffix, CASE suffix WHEN 'png' THEN 'image/png' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime,
          CASE WHEN suffix IN ('docx', 'txt') THEN 'suffix' WHEN size_bytes <= 0 THEN 'empty' WHEN size_bytes > {MOST_BYTES} THEN 'size' ELSE 'accepted' END AS verdict, count(*) AS n FROM e GROUP BY ALL""",
    "display_dates": f"""WITH d AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders)
        SELECT coalesce(strftime(TRY_CAST(iso AS DATE), '%d') || ' ' || {list(MONTHS)!r}[month(TRY_CAST(iso AS DATE))] || ' ' || strftime(TRY_CAST(iso AS DATE), '%Y'), iso) AS shown, count(*) AS n FROM d GROUP BY 1""",
    "unique_names": r"""WITH s AS (SELECT c_custkey, regexp_replace(regexp_replace('  ' || c_mktsegment || ' / ' || c_nationkey || '.', '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:80] AS stem FROM customer),
        r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY c_custkey) AS k FROM s)
        SELECT c_custkey, stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.json' AS file_name FROM r""",
    "entry_lookup": f"WITH {LEDGER_SQL} SELECT id, kind, label, family, status, quality, n_warnings FROM ledger WHERE id = 42",
    "hist_first_eight": f"WITH {LEDGER_SQL} SELECT id, kind, label, family, quality FROM shown ORDER BY saved_at DESC, id DESC LIMIT 8",
    "eval_counters": f"""WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, count(*) AS items FROM lineitem GROUP BY 1),
        r AS (SELECT o_orderstatus AS status, total IS NOT NULL AS has, items, o_orderpriority, coalesce(abs(total - CAST(o_totalprice AS DECIMAL(18,2))) * 10 <= CAST(o_totalprice AS DECIMAL(18,2)), false) AS hit FROM orders LEFT JOIN p ON l_orderkey = o_orderkey),
        e AS (SELECT status, 1 AS documents, has::INT AS predicted_documents, (has AND items < 7)::INT AS valid_json, (has AND o_orderpriority IS NOT NULL)::INT AS classification_expected,
          coalesce(has AND o_orderpriority[1] = CAST(least(items, 5) AS VARCHAR), false)::INT AS classification_correct, hit::INT AS tp, (has AND NOT hit)::INT AS fp, (NOT hit)::INT AS fn, has::INT AS field_expected, hit::INT AS field_correct FROM r),
        c AS (SELECT status, {_COUNTERS_SQL} FROM e GROUP BY ROLLUP (status))
        SELECT *, {_RATE.format('predicted_documents', 'documents')} AS coverage, {_RATE.format('valid_json', 'predicted_documents')} AS valid_json_rate, {_RATE.format('classification_correct', 'classification_expected')} AS classification_accuracy,
          {_RATE.format('field_correct', 'field_expected')} AS field_accuracy, {_RATE.format('tp', 'tp + fp')} AS precision, {_RATE.format('tp', 'tp + fn')} AS recall, {_RATE.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""",
}
