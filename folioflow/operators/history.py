"""History queries over the ledger: filters, search, paging, facets, latest use, keys and clean-up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import folded, url_key
from ..sources.ledger import LEDGER_SQL, displayable, ledger, table


def filtered(rows: DataFrame, kind: str | None = None, query: str | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """Displayable rows of a kind, whose kind, label or family holds the query, within the dates. Undated rows go only if a date is set."""
    rows = displayable(rows)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if query:
        rows = rows.where(folded(F.concat_ws(" ", "kind", "label", "family")).contains(folded(F.lit(query))))
    if first:
        rows = rows.where(F.col("saved_date") >= F.lit(first))
    if last:
        rows = rows.where(F.col("saved_date") <= F.lit(last))
    return rows


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page of the rows, newest first. Sizes are held to 1..50 and the page to those there are. It reads the top rows up to the page only."""
    size = min(50, max(1, size))
    pages = max(1, -(-rows.count() // size))
    number = min(max(1, number), pages)
    return rows.orderBy(F.desc("saved_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def hist_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page, of 20, of January's second half of the commerce and traffic families."""
    rows = filtered(ledger(table(spark, d, "events")), first=date(2024, 1, 15), last=date(2024, 1, 31)).where("family in ('commerce', 'traffic')")
    return page(rows, 3, 20).select("id", "kind", "label", "status", "n_warnings", "quality", "size_bytes")


def hist_search(spark: SparkSession, d: str) -> DataFrame:
    return filtered(ledger(table(spark, d, "events")), query="  TRAFFIC ", first=date(2024, 1, 10)).groupBy("kind", F.col("saved_date").cast("string").alias("saved_date")).agg(F.count("*").alias("n"))


def hist_facets(spark: SparkSession, d: str) -> DataFrame:
    """The distinct kinds and dates that filters can choose from."""
    rows = displayable(ledger(table(spark, d, "events")))
    return rows.select(F.lit("kind").alias("facet"), F.col("kind").alias("value")).distinct().unionAll(rows.select(F.lit("date"), F.col("saved_date").cast("string")).distinct())


def hist_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each kind; of equal times the one with the highest id."""
    newest = Window.partitionBy("kind").orderBy(F.desc("saved_at"), F.desc("id"))
    return ledger(table(spark, d, "events")).withColumn("r", F.row_number().over(newest)).where("r = 1").select("kind", "id", "saved_at", "quality", "n_warnings")


def hist_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key by which a URL names a row."""
    rows = ledger(table(spark, d, "events"))
    return rows.select("id", url_key(F.concat(F.lit("db://extraction_history/"), F.col("id").cast("string"))).alias("entry_key"))


def hist_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a clean-up would remove, and why."""
    rows = ledger(table(spark, d, "events"))
    return rows.where("status = 'error' or quality <= 0").select("id", F.when(F.col("status") == "error", "error").otherwise("quality").alias("reason"))


def hist_part_search(spark: SparkSession, d: str) -> DataFrame:
    """Search by a folded part of a name, over the names of parts."""
    return table(spark, d, "part").where(folded(F.col("p_name")).contains(folded(F.lit("  Widget")))).select("p_partkey", folded(F.col("p_name")).alias("name"))


QUERIES = {f.__name__: f for f in (hist_page, hist_search, hist_facets, hist_latest, hist_keys, hist_cleanup, hist_part_search)}
ORACLES = {
    "hist_page": f"""WITH {LEDGER_SQL} SELECT id, kind, label, status, n_warnings, quality, size_bytes FROM shown
        WHERE saved_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-31' AND family IN ('commerce', 'traffic') ORDER BY saved_at DESC, id DESC LIMIT 20 OFFSET 40""",
    "hist_search": f"WITH {LEDGER_SQL} SELECT kind, CAST(saved_date AS VARCHAR) AS saved_date, count(*) AS n FROM shown WHERE family = 'traffic' AND saved_date >= DATE '2024-01-10' GROUP BY 1, 2",
    "hist_facets": f"WITH {LEDGER_SQL} SELECT DISTINCT 'kind' AS facet, kind AS value FROM shown UNION ALL SELECT DISTINCT 'date', CAST(saved_date AS VARCHAR) FROM shown",
    "hist_latest": f"WITH {LEDGER_SQL} SELECT kind, id, saved_at, quality, n_warnings FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY saved_at DESC, id DESC) AS r FROM ledger) WHERE r = 1",
    "hist_keys": "SELECT event_id AS id, rtrim(translate(to_base64(encode('db://extraction_history/' || event_id)), '+/', '-_'), '=') AS entry_key FROM events",
    "hist_cleanup": f"WITH {LEDGER_SQL} SELECT id, CASE WHEN status = 'error' THEN 'error' ELSE 'quality' END AS reason FROM ledger WHERE status = 'error' OR quality <= 0",
    "hist_part_search": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name FROM part WHERE lower(p_name) LIKE '%widget%'",
}
