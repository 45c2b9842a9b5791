"""Every query against its SQL on the smallest tables, and unit tables for column helpers."""

import datetime
import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow import catalog
from folioflow.functions.columns import band, folded, from_url_key, last_amount, url_key
from folioflow.functions.similarity import with_token_set_ratio
from folioflow.operators.datasets import split_by
from folioflow.operators.fields import amount_texts, amount_value, iso_dates
from folioflow.operators.history import page
from folioflow.operators.payloads import leaves, with_match
from folioflow.operators.routing import route
from folioflow.sources.ledger import read_files, read_jsonl
from folioflow.streaming.ingest import daily_counts

DATA = "/root/testdata/sf0.001"


def same(df, sql):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute(sql)
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x
    order = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in con.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLES[name])


def test_columns(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]
    assert one("  Été  À la\tFête ", folded) == "ete a la fete"
    assert float(one("bolt 3 12.50 TND", last_amount)) == 12.5
    assert one("no amount", last_amount) is None
    assert one("db://x/1?", url_key) == "ZGI6Ly94LzE_"
    assert [one(q, lambda c: band(c.cast("double"))) for q in (None, "49", "50", "75")] == ["N/A", "to check", "correct", "reliable"]


def test_pages_part_the_rows(spark):
    rows = spark.range(95).select("id", F.timestamp_seconds(F.col("id") % 7).alias("saved_at"))
    got = [r.id for k in (1, 2) for r in page(rows, k, 500).collect()]
    assert sorted(got) == list(range(95))
    assert page(rows, 99, 50).count() == 45


def test_splits_of_small_groups(spark):
    rows = spark.createDataFrame([(100 * n + i, str(n)) for n in (1, 2, 3, 6) for i in range(n)], "id long, s string")
    got = {(r.s, r.split): r["count"] for r in split_by(rows, "s", "id").groupBy("s", "split").count().collect()}
    assert got == {("1", "train"): 1, ("2", "train"): 1, ("2", "validation"): 1, ("3", "train"): 1, ("3", "validation"): 1, ("3", "test"): 1, ("6", "train"): 4, ("6", "validation"): 1, ("6", "test"): 1}


def test_dates_and_amounts(spark):
    texts = ["le 2024-02-30 puis 9023.1.5", "12/03/99 et 1-1-2001", "12/03/79 12.03.2079", "rien", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_dates(F.col("t"))).collect()]
    assert got == [["2023-01-05"], ["2001-01-01", "1999-03-12"], ["2079-03-12"], [], None]
    rows = spark.createDataFrame([("total 1 234 , 500 et 12.750",)], "t string").select(amount_texts(F.col("t")).alias("a")).select("a", F.transform("a", amount_value).alias("v")).first()
    assert rows.a == ["234,500", "12.750"] and rows.v == [234.5, 12750.0]
    keys = spark.createDataFrame([("db://x/1?",), ("é",), ("",)], "p string").select("p", from_url_key(url_key(F.col("p"))).alias("q")).collect()
    assert all(r.p == r.q for r in keys) and spark.range(1).select(from_url_key(F.lit("*!"))).first()[0] is None


def test_split_sizes(spark):
    rows = spark.range(100).select("id", F.lit("a").alias("s"))
    assert {r.split: r["count"] for r in split_by(rows, "s", "id").groupBy("split").count().collect()} == {"train": 70, "validation": 15, "test": 15}


def test_sources_and_stream(spark, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"id": 1}\n\n[2]\n{"id": 3}\n')
    assert sorted(r.id for r in read_jsonl(spark, str(lines), "id long", strict=False).collect()) == [1, 3]
    (tmp_path / "history" / "bill").mkdir(parents=True)
    (tmp_path / "history" / "bill" / "x.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "history" / "bill" / "y.json").write_text("{broken")
    got = {r.source_filename: (r.kind, r.ok) for r in read_files(spark, str(tmp_path / "history")).select("source_filename", "kind", F.col("payload").isNotNull().alias("ok")).collect()}
    assert got == {"x.json": ("bill", True), "y.json": ("bill", False)}
    source = spark.read.parquet(f"{DATA}/events.parquet")
    source.unionAll(source.limit(5)).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    query = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("days").agg(F.sum("documents")).first()[0] == source.count()


def brute_match(a, b):
    import difflib
    import re

    if not a.strip() or not b.strip():
        return not a.strip() and not b.strip()
    x, y = re.sub("[^a-z0-9]+", " ", a.lower()).strip(), re.sub("[^a-z0-9]+", " ", b.lower()).strip()
    p, q = x.replace(" ", ""), y.replace(" ", "")
    return p == q != "" or (min(len(p), len(q)) >= 6 and (p in q or q in p)) or token_set_ratio(x, y) >= 0.92


def indel(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = [0] + [max(row[j + 1], row[j] + 1 if c == d else 0) for j, d in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def token_set_ratio(a, b):
    if not a or not b:
        return 0.0
    both, x, y = (" ".join(sorted(s)) for s in (set(a.split()) & set(b.split()), set(a.split()) - set(b.split()), set(b.split()) - set(a.split())))
    if both and not (x and y):
        return 1.0
    k = bool(both)
    found = [1 - indel(x, y) / (2 * (len(both) + k) + len(x) + len(y))]
    if both:
        found += [1 - (k + len(z)) / (2 * len(both) + k + len(z)) for z in (x, y)]
    return max(found)


def test_token_set_ratio(spark):
    """Against a plain table of common subsequences; each distinct pair is compared once, nulls and empty texts are unlike everything."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    rows = [(" ".join(word() for _ in range(rng.randrange(5))), " ".join(word() for _ in range(rng.randrange(5)))) for _ in range(300)] + [(None, "a"), ("a", None), ("x", "x"), ("a b", "a b"), ("b a", "a b")]
    got = with_token_set_ratio(spark.createDataFrame(rows * 2, "a string, b string"), "a", "b").collect()
    assert len(got) == 2 * len(rows)
    assert all(abs(r.ratio - (1.0 if r.a == r.b and r.a else token_set_ratio(r.a, r.b))) < 1e-9 for r in got)


def test_matched_names(spark):
    rows = catalog.QUERIES["matched_names"](spark, DATA).collect()
    assert len(rows) == 200 and {r["match"] for r in rows} == {True, False}
    assert all(r["match"] == brute_match(r["expected"], r["actual"] or "") for r in rows)


def test_match_of_amounts_and_blanks(spark):
    rows = [("12,50 TND", "12.5", True), ("12.50", "12.52", False), (None, " ", True), ("x", None, False), ("n/a", "n a", False), ("N/A", None, True)]
    got = with_match(spark.createDataFrame(rows, "a string, b string, want boolean"), "a", "b", amounts=True).collect()
    assert sorted((str(r.a), str(r.b), r.match) for r in got) == sorted((str(a), str(b), m) for a, b, m in rows)


def test_match_of_dates(spark):
    rows = [("2024-05-06", "06/05/2024", True), ("2024-05-06", "2024.05.07", False), ("le 6/5/2024 a Tunis", "2024-05-06", True), ("20240506", "2024 05 06", True), ("demain", "demain", True), ("x", "2024-05-06", False)]
    got = with_match(spark.createDataFrame(rows, "a string, b string, want boolean"), "a", "b", dates=True).collect()
    assert sorted((r.a, r.match) for r in got) == sorted((r[0], r[2]) for r in rows)


def test_leaves_of_odd_payloads(spark):
    rows = [(1, '{"a": {"b": [1, "", {"c": true}]}, "d": []}'), (2, "no json"), (3, None), (4, "{}"), (5, "7")]
    found = leaves(spark.createDataFrame(rows, "id int, p string"), "id", "p").collect()
    assert sorted(map(tuple, found), key=str) == [(1, "a.b[0]", "1"), (1, "a.b[1]", None), (1, "a.b[2].c", "true"), (1, "d", None), (4, "", None), (5, "", "7")]


def test_routes(spark):
    rows = [("C:\\STEG\\x.pdf", "", "steg_invoice"), (None, None, "medical_lab_report"), ("a.jpg", "Invoice No 3, seller, IBAN", "supplier_invoice"), ("a.jpg", "MERCI, caisse, visa", "receipt"), ("invoice-ticket.pdf", "", "receipt"), ("a.txt", "merci caisse visa", "medical_lab_report")]
    assert [r["routed"] for r in route(spark.createDataFrame(rows, "path string, text string, want string")).collect()] == [r[2] for r in rows]
