"""A ledger that is written to: batches of rows and of deletions in a shared folder, merged when it is read.

Every batch has a folder of its own, so a batch that is run again replaces itself and adds nothing. Deletions are rows as well: nothing
that was written is changed, and the trash is what they point at. Both fit ``foreachBatch`` of a stream.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the ledger; the last five came later, so older files lack them.
OLD_COLUMNS = "id long, kind string, source_filename string, saved_at timestamp, relative_path string, payload_json string"
NEW_COLUMNS = "status string, error_message string, detected_kind string, source_mime string, source_size long"
DELETED = "id long, trashed_at timestamp"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folioflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Writes a batch of ledger rows: the columns of OLD_COLUMNS and any of NEW_COLUMNS. A repeated batch takes the place of its first run."""
    rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")


def delete(ids: DataFrame, folder: str, batch_id: int) -> None:
    """Writes a batch of deletions (id, trashed_at). Ids that the ledger lacks, or that are deleted already, change nothing."""
    ids.write.mode("overwrite").parquet(f"{folder}/deleted/batch={batch_id}")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema + ", batch long")
    return spark.read.schema(schema + ", batch long").parquet(folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, f"{folder}/rows", f"{OLD_COLUMNS}, {NEW_COLUMNS}").drop("batch")
    return rows.withColumn("status", F.coalesce("status", F.lit("ok")))


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/deleted", DELETED).groupBy("id").agg(F.min("trashed_at").alias("trashed_at"))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that are not deleted. Rows of files without the later columns have the status ``ok`` and nulls. Rows without an id stay."""
    return _rows(spark, folder).join(_deleted(spark, folder), "id", "left_anti")


def trash(spark: SparkSession, folder: str) -> DataFrame:
    """Deleted rows, the time of their first deletion, and the path that they had."""
    return _rows(spark, folder).join(_deleted(spark, folder), "id").withColumnRenamed("relative_path", "original_relative_path")
