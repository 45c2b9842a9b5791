"""Quality of single payloads, case by case."""

import json

from pyspark.sql import functions as F

from folioflow.operators.quality import quality_score


def test_scores_of_single_payloads(spark):
    cases = [
        ({"error": "x", "reference": "1"}, "steg_ocr", 0.0), ({"store_name": "a"}, "receipt_test", None), ({"error": "x"}, "receipt_test", 0.0),
        ({"reference": "1", "montant_a_payer": 0, "confidence_note": "LOW", "date_limite_paiement": "d"}, "steg_gemini", 55.0), ({"patient_name": "p", "warnings": ["a"] * 9}, "medical_gemini", 0.0),
        ({"store_name": "a", "date": "d", "total": "1", "address": "b", "ticket_number": "n/a", "raw_text": "Receipt # R12"}, "receipt", 100.0),
        ({"items": [{"description": f"d{i}", "quantity": i} for i in range(9)]}, "supplier_invoice", 35.0), ({"items": {"description": "x"}}, "supplier_invoice", 0.0),
        ({}, "document_local", None), ({"extraction_quality": 0.5}, "document_local", 50.0), ({"extraction_quality": 70}, "other", 70.0), ({"extraction_quality": "0.5"}, "other", None), ({"extraction_quality": True}, "other", None),
        ({"a": [], "b": {}, "c": "Inconnue", "d": 0}, "other", 33.3), ({"document_type": "x", "_meta": {"a": 1}, "v": False}, "other", 100.0),
    ]
    rows = [(json.dumps(p), k, want) for p, k, want in cases] + [(None, "other", None), ("{broken", "receipt", 0.0)]
    got = spark.createDataFrame(rows, "p string, k string, want double").select("want", quality_score(F.col("p"), F.col("k")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
