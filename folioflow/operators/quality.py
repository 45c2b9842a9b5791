"""Quality of payloads by kind: weights of what is filled, shares of complete rows, caps by confidence, a penalty for warnings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ledger import table
from .extraction import ticket_number

# Words that count as empty, keys without information, kinds by family, weights of fields, of rows, and caps.
EMPTY_WORDS = ("", "n/a", "na", "none", "null", "non detecte", "non détecté", "inconnu", "inconnue")
TECHNICAL_KEYS = ("_meta", "raw_text", "warnings", "extraction_quality", "extraction_source", "source_file", "file_name", "document_type", "confidence_note", "local_pipeline")
KINDS = {
    "laboratory": ("medical_ocr", "medical_local"), "laboratory_flat": ("medical_gemini",), "bill": ("steg_ocr", "steg_gemini", "steg_local"),
    "receipt": ("receipt", "receipt_local", "receipt_test"), "invoice": ("supplier_invoice", "supplier_invoice_local"),
}
FIELDS = {
    "laboratory": ((8.0, "lab_info.lab_name"), (7.0, "lab_info.doctor_name"), (15.0, "patient_info.patient_name"), (8.0, "patient_info.patient_id"), (10.0, "document_metadata.exam_number", "document_metadata.dossier_number"), (12.0, "document_metadata.sample_date", "document_metadata.report_date")),
    "laboratory_flat": ((20.0, "patient_name"), (15.0, "doctor_name"), (15.0, "date")),
    "bill": ((25.0, "reference"), (25.0, "montant_a_payer"), (15.0, "date_limite_paiement"), (7.5, "periode_du"), (7.5, "periode_au"), (10.0, "coupon_reference_raw"), (10.0, "coupon_montant")),
    "receipt": ((24.0, "store_name"), (18.0, "date"), (24.0, "total"), (16.0, "address")),
    "invoice": ((8.0, "invoice_number"), (7.0, "invoice_date"), (5.0, "due_date"), (10.0, "seller.name", "seller.tax_id"), (10.0, "client.name", "client.tax_id"), (20.0, "summary.total_amount", "summary.amount_due"), (5.0, "currency")),
}
ROWS = {
    "laboratory": ("tests", 40.0, 6, ("raw_test_name", "normalized_name"), ("value", "value_text", "secondary_value")),
    "laboratory_flat": ("analyses", 50.0, 6, ("test_name",), ("value", "unit")),
    "invoice": ("items", 35.0, 5, ("description",), ("net_amount", "gross_amount", "unit_price", "quantity")),
}
TICKET, CAPS, HALF_ROW = 18.0, {"medium": 80.0, "low": 55.0}, 0.45


def meaningful(payload: Column, *paths: str) -> Column:
    """Whether one of the paths of a JSON text has a value that says something. An object or a list does unless it is empty."""
    one = lambda p: F.coalesce(~F.lower(F.trim(F.get_json_object(payload, f"$.{p}"))).isin(*EMPTY_WORDS, "{}", "[]"), F.lit(False))
    out = one(paths[0])
    for p in paths[1:]:
        out = out | one(p)
    return out


def weighted_fields(payload: Column, fields: tuple[tuple, ...]) -> Column:
    """The weights of all groups of paths that have a value."""
    return sum((F.when(meaningful(payload, *paths), weight).otherwise(0.0) for weight, *paths in fields), F.lit(0.0))


def rows_score(payload: Column, rows: str, weight: float, most: int, names: tuple[str, ...], values: tuple[str, ...]) -> Column:
    """``weight`` times the share of complete rows among ``most``; a row with a name or a value only is 0.45 of one."""
    read = F.slice(F.coalesce(F.from_json(F.get_json_object(payload, f"$.{rows}"), "array<string>"), F.array().cast("array<string>")), 1, most)
    units = F.transform(read, lambda x: F.when(meaningful(x, *names) & meaningful(x, *values), 1.0).when(meaningful(x, *names) | meaningful(x, *values), HALF_ROW).otherwise(0.0))
    return F.least(F.lit(1.0), F.aggregate(units, F.lit(0.0), lambda a, u: a + u) / most) * weight


def _share(text: str | None) -> float | None:
    try:
        todo, total, filled = [("", json.loads(text or ""))], 0, 0
    except ValueError:
        return None
    while todo:
        key, value = todo.pop()
        if key in TECHNICAL_KEYS:
            continue
        if isinstance(value, dict):
            todo += value.items()
        elif isinstance(value, list) and value:
            todo += [(key, x) for x in value]
        else:
            total += 1
            filled += value is not None and value != [] and not (isinstance(value, str) and value.strip().casefold() in EMPTY_WORDS)
    return filled / total * 100.0 if total else None


@F.pandas_udf(T.DoubleType())
def filled_share(payloads: pd.Series) -> pd.Series:
    """Filled leaves in percent, without technical keys; an empty list is an empty leaf, an empty object is none. Null where there are no leaves."""
    return payloads.map(_share).astype("float64")


def failed(payload: Column) -> Column:
    """Whether ``error`` is there and neither blank nor false nor zero."""
    return F.coalesce(~F.get_json_object(payload, "$.error").isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def quality_score(payload: Column, kind: Column) -> Column:
    """Quality in percent of a JSON payload of a kind; 0 for errors, null for annotated tests and where nothing can be told.

    Kinds of no family have the share of their filled leaves, else their own ``extraction_quality`` (0 to 1, or 0 to 100) as it stands.
    """
    known = [k for kinds in KINDS.values() for k in kinds]
    score = F.when(~kind.isin(*known), filled_share(F.when(~kind.isin(*known), payload)))
    for family, kinds in KINDS.items():
        one = weighted_fields(payload, FIELDS[family])
        if family in ROWS:
            one = one + rows_score(payload, *ROWS[family])
        if family == "receipt":
            read = ticket_number(F.coalesce(F.get_json_object(payload, "$.raw_text"), F.lit("")))
            one = one + F.when(meaningful(payload, "ticket_number") | ~F.lower(F.trim(read)).isin(*EMPTY_WORDS), TICKET).otherwise(0.0)
        if family == "bill":
            note = F.lower(F.trim(F.coalesce(F.get_json_object(payload, "$.confidence_note"), F.lit(""))))
            for said, cap in CAPS.items():
                one = F.when(note == said, F.least(one, F.lit(cap))).otherwise(one)
        score = F.when(kind.isin(*kinds), one).otherwise(score)
    warnings = F.coalesce(F.json_array_length(F.get_json_object(payload, "$.warnings")), F.lit(0))
    score = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - F.least(warnings * 8.0, F.lit(32.0)))))
    own = F.try_variant_get(F.try_parse_json(payload), "$.extraction_quality", "variant")
    own = F.when(F.schema_of_variant(own).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.get_json_object(payload, "$.extraction_quality").try_cast("double"))
    own = F.when(own.between(0, 1), own * 100).when(own.between(0, 100), own)
    score = F.when(score.isNull(), own).otherwise(score)
    return F.round(F.when(failed(payload), 0.0).when(~kind.endswith("_test"), score), 1)


#: Orders as payloads of six kinds, with fields missing by turns, as SQL that both engines read.
KIND_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'medical_ocr' WHEN 1 THEN 'medical_gemini' WHEN 2 THEN 'steg_local' WHEN 3 THEN 'receipt' WHEN 4 THEN 'supplier_invoice' WHEN 5 THEN 'receipt_test' ELSE 'document_local' END"""
_KEY = "CAST(o_orderkey AS STRING)"
PAYLOAD_SQL = f"""'{{"warnings": ' || CASE WHEN o_orderkey % 3 = 0 THEN '["A", "B"]' WHEN o_orderkey % 3 = 1 THEN '"none"' ELSE '["A"]' END || CASE WHEN o_orderkey % 41 = 0 THEN ', "error": "timeout"' ELSE ', "error": ""' END || CASE o_orderkey % 7
  WHEN 0 THEN ', "lab_info": {{"lab_name": "Lab", "doctor_name": " N/A "}}, "patient_info": {{"patient_name": ' || CASE WHEN o_orderkey % 2 = 0 THEN '"P"' ELSE 'null' END || '}}, "document_metadata": {{"dossier_number": 0, "report_date": "Inconnu"}}, "tests": [{{"raw_test_name": "TSH", "value": 1.5}}, 7, {{"raw_test_name": "", "value_text": "traces"}}]'
  WHEN 1 THEN ', "patient_name": "x", "date": [], "analyses": ' || CASE WHEN o_orderkey % 2 = 0 THEN '{{}}' ELSE '[{{"test_name": "a"}}, {{"test_name": "b", "unit": "g"}}]' END
  WHEN 2 THEN ', "reference": "12", "montant_a_payer": "' || {_KEY} || '", "date_limite_paiement": "d", "periode_du": "p", "periode_au": "q", "confidence_note": "' || CASE o_orderkey % 4 WHEN 0 THEN ' Medium' WHEN 1 THEN 'low' ELSE 'high' END || '"'
  WHEN 3 THEN ', "store_name": "MG", "total": "' || CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE '12,5' END || '", "raw_text": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'merci' ELSE 'caisse no 40' || {_KEY} END || '"'
  WHEN 4 THEN ', "invoice_number": "A1", "seller": {{"name": "na", "tax_id": "99"}}, "client": "c", "summary": {{"amount_due": false}}, "items": [{{"description": "x", "quantity": 2}}, {{"quantity": 1}}, {{}}]'
  WHEN 5 THEN ', "store_name": "MG"'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN ', "a": {{"b": [1, "", {{"c": true}}], "e": {{}}}}, "d": [], "raw_text": "x"' ELSE ', "extraction_quality": 0.5' END END || '}}'"""


def quality_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Quality of orders rendered as payloads of seven kinds."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(KIND_SQL).alias("kind"), F.expr(PAYLOAD_SQL).alias("payload"))
    return rows.select("o_orderkey", "kind", quality_score(F.col("payload"), F.col("kind")).alias("quality"))


QUERIES = {"quality_by_kind": quality_by_kind}
ORACLES = {
    # Points by hand for each kind of payload: fields, rows, caps; then warnings; a document has "error" (blank) as a leaf of its own.
    "quality_by_kind": f"""WITH p AS (SELECT o_orderkey, o_orderkey AS k, {KIND_SQL} AS kind, CASE o_orderkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 0 ELSE 8 END AS penalty FROM orders),
        s AS (SELECT *, CAST(CASE kind WHEN 'medical_ocr' THEN 8 + CASE WHEN k % 2 = 0 THEN 15 ELSE 0 END + 10 + 1.45::DOUBLE / 6 * 40
          WHEN 'medical_gemini' THEN 20 + CASE WHEN k % 2 = 0 THEN 0 ELSE 1.45::DOUBLE / 6 * 50 END WHEN 'steg_local' THEN least(80, CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 55 ELSE 100 END)
          WHEN 'receipt' THEN 24 + CASE WHEN k % 5 = 0 THEN 0 ELSE 24 END + CASE WHEN k % 2 = 0 THEN 0 ELSE 18 END WHEN 'supplier_invoice' THEN 8 + 10 + 20 + 1.45::DOUBLE / 5 * 35
          WHEN 'document_local' THEN CASE WHEN k % 2 = 0 THEN 100.0::DOUBLE * 2 / 5 ELSE 0 END END AS DOUBLE) AS score FROM p)
        SELECT o_orderkey, kind, CASE WHEN k % 41 = 0 THEN 0.0 WHEN kind <> 'receipt_test' THEN round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, score - penalty)), 1) END AS quality FROM s""",
}
