"""Readers of noisy texts on single cases: nulls, empty texts, ties, look-around that SQL of the fixtures cannot show."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import extraction as e


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    (None, None), ("", []), ("1234567,00", []), ("12,3456", []), ("x12,50 et 12,50", ["12,50"]), ("1 234,500", ["1234,500", "234,500"]), ("1.234,50 net", ["1.234"]),
])
def test_money(spark, text, want):
    assert one(spark, text, e.money_texts) == want


@pytest.mark.parametrize(("text", "want"), [
    (None, ""), ("", ""), ("rien", ""), ("a 5,00\ntotal 2,00\nTTC 2.00", "2.00"), ("a 5,00\nb 5,00", "5,00"), ("total\n7,10", "7,10"),
])
def test_best_amount(spark, text, want):
    assert one(spark, text, e.best_amount) == want


@pytest.mark.parametrize(("text", "want"), [
    (None, ""), ("", ""), ("www.abc.tn", "ABC"), ("facebook.com et la-rue . fr", "La Rue"), ("chez Monoprix nord", "MONOPRIX"), ("total 3\n-- l'épi d'or --", "L'Épi D'Or"), ("12 34 ab", ""),
])
def test_store(spark, text, want):
    assert one(spark, text, e.store_name) == want


def test_items(spark):
    items = lambda text, total="9,00", most=lambda c: c: one(spark, text, lambda c: most(e.text_items(c, F.lit(total), e.NO_INVOICE_ITEM, 6, 140)))
    assert items(None) == [] and items("") == []
    assert [tuple(r) for r in items("| pain noir 2,50 5,00 ;\nfacture 3,00\npain 9,00\n7,50 8,50\nlait frais 1 . 20")] == [("pain noir", "2,50", "5,00"), ("lait frais 1 . 20", "", "1.20")]
    assert len(items("\n".join(f"objet rouge {i},50" for i in range(1, 40)))) == e.MOST_ITEMS
    assert len(items("objet rouge 1,50\n" * 3, None)) == 3


def test_numbers(spark):
    assert one(spark, "Facture No: ab\nno : x-12", e.invoice_number) == "X-12"
    assert one(spark, None, e.invoice_number) == "" == one(spark, None, e.ticket_number)
    assert one(spark, "Invoice No: inv-7x", e.ticket_number) == "inv-7x" and one(spark, "trx: ab-1", e.ticket_number) == "AB-1"
    assert [one(spark, x, e.tolerant_number) for x in (None, "", "1 2,5", "x")] == [None, None, 12.5, None]
    assert [tuple(one(spark, x, e.reference_range)) for x in (None, "5", "9 a 3,5", "-1 - 4")] == [(None, None), (None, None), (3.5, 9.0), (1.0, 4.0)]


def test_checks(spark):
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<description:string>>")
    rows = spark.range(1)
    got = rows.select(e.receipt_check(none, none, F.lit(" "), none, empty).alias("x")).first().x
    assert got.warnings == ["MISSING_STORE", "MISSING_TOTAL", "NO_ITEMS"] and got.quality == 0
    got = rows.select(e.bill_check(none, none, none, none, none, none).alias("x")).first().x
    assert len(got.warnings) == 4 and got.quality == pytest.approx(0.086)
    full = F.lit("x")
    half = F.array(F.struct(F.lit("a").alias("description")), F.struct(F.lit(" ").alias("description")))
    assert rows.select(e.invoice_check(*[full] * 9, half).alias("x")).first().x.quality == pytest.approx(round(7.45 / 8.2, 3))
