"""Which kind of document a scan is: hints of its name and path first, then weighted terms of its text."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import table

# Terms by kind, parted by "|". Blanks at a term's ends count.
SUPPLIER_STRONG = "invoice no|invoice number|invoice #|credit note|facture n|n° facture|numero facture|seller|supplier|fournisseur|vendor|bill to|sold to|ship to|vat| tva|tva |iban|swift|tax id|due date|amount due|balance due|net price|gross|subtotal|total ttc|montant ttc|ht | ht|رقم الفاتورة|فاتورة|المورد|البائع|العميل|الحريف|الضريبة|الإجمالي|المبلغ|تاريخ الإصدار|ضريبة القيمة المضافة|الأداء على القيمة المضافة"
SUPPLIER_WEAK = "invoice|facture|buyer|client|customer|total|tax|amount|quantity|qty|unit|description|remise|discount|shipping|freight|payment terms|po |purchase order|تاريخ"
SUPPLIER_ANCHOR = "invoice|facture|فاتورة|رقم الفاتورة|seller|supplier|fournisseur|البائع|المورد"
RECEIPT_STRONG = "merci|tva|ttc|t.t.c|reçu|recu|ticket|caisse|paiement|payment|visa|mastercard|carte bancaire|terminal|tpe|transaction|sous-total|sous total|subtotal|remise|discount|articles|quantité|quantite|qty|espèces|especes|rendu|monnaie|bienvenue|tnd|dinars|net à payer|net a payer|total tnd|total dt|total d.t"
RECEIPT_WEAK = "magasin|store|checkout|caissier|vendeur|monoprix|carrefour|geant|géant|zara|achat|courses|euro|eur | eur"
BILL_STRONG = "steg|steg tunisie|facture|facture steg|reference|référence|ref client|ref. client|priere de payer|prière de payer|montant a payer|montant à payer|date limite|date limite paiement|consommation kwh|kwh|kw/h|compteur|abonne|abonné|energie|énergie|tranche|tarif|tnd|dt|الستاغ|الشركة التونسية للكهرباء|الرجاء"
BILL_WEAK = "periode du|période du|periode au|période au|coupon|echeance|échéance|client|code client|index|ancien index|nouvel index"
BILL_HITS = "steg|reference|référence|montant a payer|montant à payer|priere de payer|prière de payer|consommation kwh|kwh|compteur|abonne|abonné|date limite|الرجاء"
LAB_HITS = "laboratoire|laboratoire | hémoglob|hemoglob|glycem|glycém|tsh|vitamine| vn |valeurs normales|compte-rendu|compte rendu|prélèvement|prelevement|biologie|pathologie|formule sanguine|numération|plaquettes|leucocytes|crp|u/l|g/l"
NAME_BILL, PATH_BILL = "steg", "/steg_|/steg/|/electricite/"
NAME_SUPPLIER, PATH_SUPPLIER = "supplier_invoice|facture_fournisseur|fournisseur|supplier|vendor_invoice|purchase_invoice", "supplier_invoice"
NAME_NOT_SUPPLIER = "receipt|ticket|caisse|recu|reçu"
NAME_RECEIPT, PATH_RECEIPT = "ticket|caisse|receipt|recu|reçu|ticket_caisse|ticket-caisse|ticket caisse|achat|courses|shopping", "/ticketscasse/|/receipt/|/receipt_test/"
NAME_LAB, PATH_LAB = "analyse|labo|medical|médical", "/medical/|/analyse_medical/"
SUFFIXES = "jpg|jpeg|png|tif|tiff|pdf"
BILL, SUPPLIER, RECEIPT, LAB = "steg_invoice", "supplier_invoice", "receipt", "medical_lab_report"

#: Score columns: (strong terms, weak terms); a strong term counts twice.
SCORES = {"supplier": (SUPPLIER_STRONG, SUPPLIER_WEAK), "receipt": (RECEIPT_STRONG, RECEIPT_WEAK), "bill": (BILL_STRONG, BILL_WEAK)}
#: The ordered decisions as conditions over columns that Spark and other SQL engines read alike.
DECISIONS = (
    ("name_bill or path_bill", BILL),
    ("name_supplier or path_supplier or (contains(name, 'invoice') and not name_not_supplier)", SUPPLIER),
    ("name_receipt or path_receipt", RECEIPT),
    ("name_lab or path_lab or not known_suffix or blank", LAB),
    ("lab_hits >= 3 and 2 * lab_hits >= receipt", LAB),
    ("bill >= 6 and bill >= receipt", BILL),
    ("bill < 5 and bill_hits < 4 and not contains(txt, 'steg') and supplier >= 5 and supplier > receipt and (anchor or supplier >= 14)", SUPPLIER),
    ("receipt >= 4 and receipt > greatest(2 * bill_hits, bill) and receipt > 2 * lab_hits", RECEIPT),
    ("receipt >= 2 and bill_hits < 2 and bill < 5 and receipt > 2 * lab_hits", RECEIPT),
    ("receipt >= 2 and bill_hits <= 1 and bill < 4 and lab_hits <= 1", RECEIPT),
    ("(bill_hits >= lab_hits and bill_hits >= 2) or bill >= 4", BILL),
)
DECISION_SQL = "case " + " ".join(f"when {c} then '{kind}'" for c, kind in DECISIONS) + f" else '{LAB}' end"


def hits(text: Column, terms: str) -> Column:
    """How many of the terms the text has; each counts once."""
    return reduce(add, [F.contains(text, F.lit(t)).cast("int") for t in terms.split("|")])


def route(scans: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Adds the score columns and ``routed``, the kind of document. A null path or text is an empty one. No shuffle, no UDF."""
    clean = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = scans.withColumns({"path_": F.translate(clean(path), "\\", "/"), "txt": clean(text)}).withColumn("name", F.element_at(F.split("path_", "/"), -1))
    some = lambda c, terms: hits(F.col(c), terms) > 0
    known = {
        "name_bill": some("name", NAME_BILL), "path_bill": some("path_", PATH_BILL), "name_supplier": some("name", NAME_SUPPLIER), "path_supplier": some("path_", PATH_SUPPLIER), "name_not_supplier": some("name", NAME_NOT_SUPPLIER),
        "name_receipt": some("name", NAME_RECEIPT), "path_receipt": some("path_", PATH_RECEIPT), "name_lab": some("name", NAME_LAB), "path_lab": some("path_", PATH_LAB),
        "known_suffix": F.rlike("name", F.lit(rf".\.({SUFFIXES})$")), "blank": ~F.rlike("txt", F.lit(r"\S")), "anchor": some("txt", SUPPLIER_ANCHOR),
        "bill_hits": hits(F.col("txt"), BILL_HITS), "lab_hits": hits(F.col("txt"), LAB_HITS), **{k: 2 * hits(F.col("txt"), strong) + hits(F.col("txt"), weak) for k, (strong, weak) in SCORES.items()},
    }
    return rows.withColumns(known).withColumn("routed", F.expr(DECISION_SQL)).select(*scans.columns, *SCORES, "bill_hits", "lab_hits", "routed")


#: Words of rendered scans: an order's key chooses two of them and a path.
PHRASES = ("invoice no 7 seller total", "merci ticket caisse visa", "laboratoire tsh crp u/l", "kwh compteur tarif index", "facture client tva remise", "total", "date limite abonne", "hello world", "supplier iban swift vat gross subtotal", "", "recu", "plaquettes glycem")
PATHS = ("in/scan.jpg", "in/a.PNG", "in/b.pdf", "in/steg_1.png", "in/vendor_invoice.pdf", "in/my invoice.pdf", "in/invoice ticket.png", "medical/x.jpg", "in/page.docx", "receipt/c.tiff", "in/d.jpeg")


def scans(orders: DataFrame) -> DataFrame:
    """scan_id, path and text of one rendered scan for each order."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    key = F.col("o_orderkey")
    return orders.select(key.alias("scan_id"), pick(PATHS, key).alias("path"), F.concat_ws(" ", pick(PHRASES, key), pick(PHRASES, F.floor(key / len(PHRASES))), F.lower("o_orderpriority")).alias("text"))


def routed_scans(spark: SparkSession, d: str) -> DataFrame:
    return route(scans(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"))).drop("path", "text")


def _listed(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _hits_sql(column: str, terms: str) -> str:
    return f"len(list_filter({_listed(terms.split('|'))}, lambda t: contains({column}, t)))"


QUERIES = {"routed_scans": routed_scans}
ORACLES = {
    "routed_scans": f"""WITH s AS (SELECT o_orderkey AS scan_id, lower({_listed(PATHS)}[o_orderkey % {len(PATHS)} + 1]) AS path_, {_listed(PHRASES)}[o_orderkey % {len(PHRASES)} + 1] || ' ' || {_listed(PHRASES)}[(o_orderkey // {len(PHRASES)}) % {len(PHRASES)} + 1] || ' ' || lower(o_orderpriority) AS txt FROM orders),
        n AS (SELECT *, split_part(path_, '/', -1) AS name FROM s),
        k AS (SELECT *, {", ".join(f"{_hits_sql(c, t)} > 0 AS {a}" for a, c, t in (("name_bill", "name", NAME_BILL), ("path_bill", "path_", PATH_BILL), ("name_supplier", "name", NAME_SUPPLIER), ("path_supplier", "path_", PATH_SUPPLIER), ("name_not_supplier", "name", NAME_NOT_SUPPLIER), ("name_receipt", "name", NAME_RECEIPT), ("path_receipt", "path_", PATH_RECEIPT), ("name_lab", "name", NAME_LAB), ("path_lab", "path_", PATH_LAB), ("anchor", "txt", SUPPLIER_ANCHOR)))},
          regexp_matches(name, '.\\.({SUFFIXES})$') AS known_suffix, trim(txt) = '' AS blank, {_hits_sql("txt", BILL_HITS)} AS bill_hits, {_hits_sql("txt", LAB_HITS)} AS lab_hits,
          {", ".join(f"2 * {_hits_sql('txt', a)} + {_hits_sql('txt', b)} AS {k}" for k, (a, b) in SCORES.items())} FROM n)
        SELECT scan_id, {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in (*SCORES, "bill_hits", "lab_hits"))}, {DECISION_SQL} AS routed FROM k""",
}
