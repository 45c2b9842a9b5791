"""Records out of rendered documents: line items, amounts, laboratory rows, votes, merges and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import folded, last_amount
from ..sources.ledger import table

MOST_ITEMS = 12
LAB_LINE = r"^(.+?) ([0-9]+[.][0-9]{2}) ([A-Za-z/]+) \(V\.N\.: ([0-9]+[.][0-9]{2})-([0-9]+[.][0-9]{2})\)$"


def invoices(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """An order as a text of one line an item: part, quantity, price."""
    money = lambda c: F.format_string("%.2f", c)
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"), money(F.col("l_extendedprice"))).alias("line")).alias("x"))
    return rows.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])).alias("text"))


def line_items(docs: DataFrame, most: int | None = MOST_ITEMS) -> DataFrame:
    """order_id, position, line, amount of each line with an amount; the first ``most`` of a document."""
    rows = docs.select("order_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).withColumn("amount", last_amount(F.col("line"))).where("amount is not null")
    if most:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("order_id").orderBy("position"))).where(F.col("r") <= most).drop("r")
    return rows


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return invoices(table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name"))


def invoice_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all line amounts that are read back from rendered orders."""
    return line_items(_rendered(spark, d), None).groupBy("order_id").agg(F.count("*").alias("items"), F.sum("amount").cast("double").alias("total"), F.max("amount").cast("double").alias("largest"))


def invoice_items(spark: SparkSession, d: str) -> DataFrame:
    """The first items of each document only."""
    return line_items(_rendered(spark, d)).groupBy("order_id").agg(F.count("*").alias("items"), F.sum("amount").cast("double").alias("total"))


def lab_rows(spark: SparkSession, d: str) -> DataFrame:
    """Laboratory rows read from lines ``name value unit (V.N.: low-high)``, with their status."""
    two = lambda c: F.format_string("%.2f", c)
    lines = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), two(F.col("p_retailprice")), F.lit(" mg/L (V.N.: "), two(F.col("p_size") * 20.0), F.lit("-"), two(F.col("p_size") * 40.0), F.lit(")")).alias("line"))
    part = lambda k: F.regexp_extract("line", LAB_LINE, k)
    read = lines.select("p_partkey", part(1).alias("test"), part(2).cast("double").alias("value"), part(3).alias("unit"), part(4).cast("double").alias("low"), part(5).cast("double").alias("high"))
    return read.withColumn("status", F.when(F.col("value") < F.col("low"), "low").when(F.col("value") > F.col("high"), "high").otherwise("normal"))


def amount_votes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent quantity of each part; of equal counts the one seen first."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("at"))
    counts = rows.groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("votes"), F.min("at").alias("first"))
    best = Window.partitionBy("l_partkey").orderBy(F.desc("votes"), "first")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"), "votes")


def merged_names(spark: SparkSession, d: str) -> DataFrame:
    """The ordered union of two lists of names, distinct by folded name: the first wins, the first list before the second."""
    one = table(spark, d, "customer").select(F.lit(1).alias("list"), F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("name"))
    two = table(spark, d, "part").select(F.lit(2).alias("list"), F.col("p_partkey").alias("place"), F.col("p_type").alias("name"))
    first = Window.partitionBy("key").orderBy("list", "place")
    return one.unionAll(two).withColumn("key", folded(F.col("name"))).where("key <> ''").groupBy("key", "name", "list").agg(F.min("place").alias("place")).withColumn("r", F.row_number().over(first)).where("r = 1").select("key", "name", "list", "place")


def order_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warnings of each order: no items, a total of nothing, an unknown customer; and the penalty they make."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey").distinct()
    customers = table(spark, d, "customer").select("c_custkey")
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    found = F.array_compact(F.array(F.when(F.col("l_orderkey").isNull(), "no items"), F.when(F.coalesce(F.col("o_totalprice"), F.lit(0.0)) <= 0, "no total"), F.when(F.col("c_custkey").isNull(), "unknown customer")))
    return rows.select(F.col("o_orderkey").alias("order_id"), F.array_join(found, ";").alias("warnings"), F.size(found).alias("n"), F.least(8 * F.size(found), F.lit(32)).alias("penalty")).where("n > 0")


QUERIES = {f.__name__: f for f in (invoice_totals, invoice_items, lab_rows, amount_votes, merged_names, order_warnings)}
ORACLES = {
    "invoice_totals": "SELECT l_orderkey AS order_id, count(*) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS largest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "invoice_items": f"""WITH r AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT l_orderkey AS order_id, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS total FROM r WHERE r <= {MOST_ITEMS} GROUP BY 1""",
    "lab_rows": """SELECT p_partkey, p_name AS test, round(p_retailprice, 2) AS value, 'mg/L' AS unit, p_size * 20.0::DOUBLE AS low, p_size * 40.0::DOUBLE AS high,
        CASE WHEN round(p_retailprice, 2) < p_size * 20 THEN 'low' WHEN round(p_retailprice, 2) > p_size * 40 THEN 'high' ELSE 'normal' END AS status FROM part""",
    "amount_votes": """WITH c AS (SELECT l_partkey, l_quantity, count(*) AS votes, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_quantity}) AS first FROM lineitem GROUP BY 1, 2)
        SELECT l_partkey AS partkey, l_quantity AS quantity, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, first) AS r FROM c) WHERE r = 1""",
    "merged_names": r"""WITH u AS (SELECT 1 AS list, c_custkey AS place, c_mktsegment AS name FROM customer UNION ALL SELECT 2, p_partkey, p_type FROM part),
        k AS (SELECT *, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS key FROM u)
        SELECT key, name, list, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list, place) AS r FROM k WHERE key <> '') WHERE r = 1""",
    "order_warnings": """WITH w AS (SELECT o_orderkey AS order_id, list_filter([CASE WHEN l.k IS NULL THEN 'no items' END, CASE WHEN coalesce(o_totalprice, 0) <= 0 THEN 'no total' END, CASE WHEN c_custkey IS NULL THEN 'unknown customer' END], lambda x: x IS NOT NULL) AS f
          FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)
        SELECT order_id, array_to_string(f, ';') AS warnings, CAST(len(f) AS INTEGER) AS n, CAST(least(8 * len(f), 32) AS INTEGER) AS penalty FROM w WHERE len(f) > 0""",
}
