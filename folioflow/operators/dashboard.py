"""Dashboard aggregates over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import band
from ..sources.ledger import LEDGER_SQL, displayable, ledger, table

TOP = 5


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return displayable(ledger(table(spark, d, "events")))


def overview(rows: DataFrame) -> DataFrame:
    """One row: counts, success rate, warnings and mean quality; zeros for an empty ledger."""
    ok = F.count_if(F.col("status") == "ok")
    total = F.count("*")
    rate = lambda x: F.coalesce(F.round(F.try_divide(x, total), 2), F.lit(0.0))
    return rows.agg(
        total.alias("total"), ok.alias("ok"), (total - ok).alias("errors"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("warnings"),
        rate(100 * ok).alias("success_pct"), rate(F.sum("n_warnings")).alias("warnings_per_document"), F.coalesce(F.round(F.avg("quality"), 2), F.lit(0.0)).alias("mean_quality"),
    )


def dash_overview(spark: SparkSession, d: str) -> DataFrame:
    return overview(_shown(spark, d))


def dash_overview_all(spark: SparkSession, d: str) -> DataFrame:
    return overview(ledger(table(spark, d, "events")))


def dash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Counts by label, family and status, in one pass."""
    rows = _shown(spark, d).groupingSets([["label"], ["family"], ["status"]], "label", "family", "status").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return rows.select(F.when(F.col("g") == 3, "label").when(F.col("g") == 5, "family").otherwise("status").alias("dimension"), F.coalesce("label", "family", "status").alias("name"), "n")


def dash_daily(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).where("saved_date is not null").groupBy("saved_date").agg(F.count("*").alias("documents"), F.sum("n_warnings").cast("long").alias("warnings")).withColumn("saved_date", F.col("saved_date").cast("string"))


def dash_trend(spark: SparkSession, d: str) -> DataFrame:
    """Documents a day of the five most frequent labels, days without any as 0. Ties go to the label seen first."""
    daily = _shown(spark, d).where("saved_date is not null").groupBy("label", "saved_date").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = daily.groupBy("label").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(TOP).select("label")
    days = daily.select("saved_date").distinct()
    grid = top.withColumn("one", F.lit(1)).join(days.withColumn("one", F.lit(1)), "one").drop("one")  # TOP rows a day
    return grid.join(daily.select("label", "saved_date", "n"), ["label", "saved_date"], "left").select("label", F.col("saved_date").cast("string").alias("saved_date"), F.coalesce("n", F.lit(0)).alias("documents"))


def dash_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each kind over all rows, hidden ones included."""
    return ledger(table(spark, d, "events")).groupBy("kind").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "error").alias("errors"))


def dash_donut(spark: SparkSession, d: str) -> DataFrame:
    """Each label's share of all documents, where its arc begins, and its bar relative to the highest."""
    counts = _shown(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    order, every = Window.orderBy(F.desc("n"), "label"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(every)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("label", "n", F.round(100 * F.col("n") / total, 2).alias("share_pct"), F.round(100 * before / total, 2).alias("offset_pct"), F.round(100 * F.col("n") / F.max("n").over(every), 2).alias("bar_pct"))


def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(table(spark, d, "events"))
    return rows.groupBy("kind", band(F.col("quality")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 1).alias("mean_quality"))


QUERIES = {f.__name__: f for f in (dash_overview, dash_overview_all, dash_groups, dash_daily, dash_trend, dash_coverage, dash_donut, quality_bands)}

_OVERVIEW = """SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS errors, CAST(coalesce(sum(n_warnings), 0) AS BIGINT) AS warnings,
  coalesce(round(100.0 * count(*) FILTER (status = 'ok') / nullif(count(*), 0), 2), 0.0) AS success_pct, coalesce(round(sum(n_warnings) / nullif(count(*), 0), 2), 0.0) AS warnings_per_document,
  coalesce(round(avg(quality), 2), 0.0) AS mean_quality FROM """
ORACLES = {
    "dash_overview": f"WITH {LEDGER_SQL} {_OVERVIEW} shown",
    "dash_overview_all": f"WITH {LEDGER_SQL} {_OVERVIEW} ledger",
    "dash_groups": f"""WITH {LEDGER_SQL} SELECT 'label' AS dimension, label AS name, count(*) AS n FROM shown GROUP BY label
        UNION ALL SELECT 'family', family, count(*) FROM shown GROUP BY family UNION ALL SELECT 'status', status, count(*) FROM shown GROUP BY status""",
    "dash_daily": f"WITH {LEDGER_SQL} SELECT CAST(saved_date AS VARCHAR) AS saved_date, count(*) AS documents, CAST(sum(n_warnings) AS BIGINT) AS warnings FROM shown WHERE saved_date IS NOT NULL GROUP BY saved_date",
    "dash_trend": f"""WITH {LEDGER_SQL}, top AS (SELECT label FROM shown WHERE saved_date IS NOT NULL GROUP BY label ORDER BY count(*) DESC, min(id) LIMIT {TOP}),
        days AS (SELECT DISTINCT saved_date FROM shown WHERE saved_date IS NOT NULL)
        SELECT top.label, CAST(days.saved_date AS VARCHAR) AS saved_date, count(s.id) AS documents FROM top CROSS JOIN days LEFT JOIN shown s ON s.label = top.label AND s.saved_date = days.saved_date GROUP BY 1, 2""",
    "dash_coverage": f"WITH {LEDGER_SQL} SELECT kind, count(*) AS documents, count(*) FILTER (status = 'error') AS errors FROM ledger GROUP BY kind",
    "dash_donut": f"""WITH {LEDGER_SQL}, c AS (SELECT label, count(*) AS n FROM shown GROUP BY label)
        SELECT label, n, round(100 * n / sum(n) OVER (), 2) AS share_pct, round(100 * coalesce(sum(n) OVER (ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 2) AS offset_pct,
        round(100 * n / max(n) OVER (), 2) AS bar_pct FROM c""",
    "quality_bands": f"""WITH {LEDGER_SQL} SELECT kind, CASE WHEN quality IS NULL THEN 'N/A' WHEN quality < 50 THEN 'to check' WHEN quality < 75 THEN 'correct' ELSE 'reliable' END AS band,
        count(*) AS n, round(avg(quality), 1) AS mean_quality FROM ledger GROUP BY 1, 2""",
}
