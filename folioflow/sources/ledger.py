"""The ledger of processed documents: scans, and the view that all history and dashboard queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = {"view": "traffic", "click": "traffic", "purchase": "commerce", "signup": "account", "error": "Error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON lines file. Strict: a broken line raises; else it is dropped. Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """One row for each *.json file below ``root``: its kind is its folder, an unreadable payload is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.col("modificationTime").alias("saved_at"),
        F.try_parse_json(F.decode("content", "UTF-8")).alias("payload"), F.col("length").alias("size_bytes"),
    )


def _family(kind: Column) -> Column:
    out = F.lit("Other")
    for k, v in FAMILIES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def ledger(events: DataFrame) -> DataFrame:
    """id, kind, label, family, status, saved_at, saved_date, n_warnings, quality, size_bytes of each ledger row.

    Quality is 0 for errors. Else it is a fifth of the value, 100 at most, less 8 for each warning and 32 in all at most.
    """
    warnings = F.coalesce(F.get_json_object("props", "$.k").cast("int") % 5, F.lit(0))
    failed = F.col("event_type") == "error"
    quality = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value") / 5) - F.least(8 * warnings, F.lit(32))), 1)
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.initcap("event_type").alias("label"), _family(F.col("event_type")).alias("family"), F.when(failed, "error").otherwise("ok").alias("status"),
        F.col("ts").alias("saved_at"), F.to_date("ts").alias("saved_date"), warnings.alias("n_warnings"), F.when(failed, 0.0).otherwise(quality).alias("quality"), F.octet_length("props").alias("size_bytes"),
    )


def displayable(rows: DataFrame) -> DataFrame:
    """Rows of unknown or positive quality. Errors have 0 and so are hidden."""
    return rows.where("quality is null or quality > 0")


#: The ledger view as DuckDB SQL, for the oracles.
LEDGER_SQL = """ledger AS (
  SELECT event_id AS id, event_type AS kind, upper(event_type[1]) || event_type[2:] AS label,
    CASE event_type WHEN 'view' THEN 'traffic' WHEN 'click' THEN 'traffic' WHEN 'purchase' THEN 'commerce' WHEN 'signup' THEN 'account' WHEN 'error' THEN 'Error' ELSE 'Other' END AS family,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts AS saved_at, CAST(ts AS DATE) AS saved_date,
    coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5, 0) AS n_warnings,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE round(greatest(0.0, least(100.0, value / 5) - least(8 * coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5, 0), 32)), 1) END AS quality,
    strlen(props) AS size_bytes
  FROM events
), shown AS (SELECT * FROM ledger WHERE quality IS NULL OR quality > 0)"""
