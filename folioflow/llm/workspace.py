"""Shared scratch tables, the one place where operators cut lineage, and bounded lookups and classes for scans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup has at most so many bits (16 MB), however many keys it is made of.
MOST_BITS = 1 << 27
_PAGE = 1 << 15
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan in use refers to: it does so for what the driver's garbage collector finds, which a driver with memory to spare may not run for long."""
    spark._jvm.java.lang.System.gc()


class Workspace:
    """Parquet tables in a new folder below ``spark.checkpoint.dir``.

    Every executor reaches that folder, so a table written here outlives the executors
    that wrote it. Where the setting is unset a temporary folder serves, on a local master only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="folioflow-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table as written. Shuffle files of the job are deleted as soon as it ends: its plan is run for this only."""
        path, kept = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, kept)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        free_shuffles(self.spark)

    def drop(self, *names: str) -> None:
        """Frees tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: Iterable[str], name: str) -> str:
    """A column name like ``name`` that is none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Lookup:
    """Bits of some 64-bit keys, so that scans can let go of most rows that have none of the keys.

    Rows that have one always pass. Others pass with a chance that rises with the number of keys, so a join must follow.
    """

    def __init__(self, keys: DataFrame):
        """``keys``: one long column."""
        keys = keys.toDF("key")
        self.spark, n = keys.sparkSession, keys.count()
        self.bits = min(MOST_BITS, max(_PAGE, 1 << (16 * n + 1).bit_length()))
        slot = F.pmod("key", F.lit(self.bits)) + 1
        found = keys.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # MOST_BITS bits at most
        self.words = np.zeros((self.bits // _PAGE, _PAGE // 64), np.int64)
        for r in found:
            self.words[r.page - 1] = np.frombuffer(bytes(r.bits), "<i8")

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows that may have one of the keys, and rows that have none."""
        page, words, slot = (unused(df.columns, c) for c in ("_page", "_words", "_slot"))
        pages = self.spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(self.words) if w.any()] or [(-1, [0])], f"{page} long, {words} array<long>")
        marked = df.withColumn(slot, F.pmod(key, F.lit(self.bits))).withColumn(page, F.floor(F.col(slot) / _PAGE))
        told = marked.join(F.broadcast(pages), page, "left")  # 16 MB at most
        bit = F.coalesce(F.expr(f"bit_get(element_at({words}, CAST({slot} % {_PAGE} DIV 64 AS INT) + 1), CAST({slot} % 64 AS INT))"), F.lit(0))
        return told.where(bit == 1).select(*df.columns), told.where(bit == 0).select(*df.columns)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which int64 keys may be among the keys."""
        slot = np.mod(keys, self.bits)
        return (self.words.ravel()[slot >> 6] >> (slot & 63)) & 1 == 1

    def __getstate__(self):
        return {"bits": self.bits, "words": self.words}


class Classes:
    """Which class each 64-bit key is in, for rows all of whose keys are known, so that scans can tell most of them without a join.

    A row is told its class where no key of another class shares its slot. What is told is right; the other rows, whose share rises with the number of keys, must be joined.
    """

    def __init__(self, keys: DataFrame, n: int):
        """``keys``: a long, and its class from 0 to ``n`` - 1."""
        keys = keys.toDF("key", "class")
        self.spark, self.n, k = keys.sparkSession, n, keys.count()
        most = max(_PAGE, 1 << (2 * MOST_BITS // n).bit_length() - 1)  # all classes together take twice what a lookup may
        self.bits = min(most, max(_PAGE, 1 << (16 * k + 1).bit_length()))
        slot = F.pmod("key", F.lit(self.bits)) + 1
        found = keys.groupBy("class", F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # 2 * MOST_BITS bits at most
        self.pages = {page: k for k, page in enumerate(sorted({r.page for r in found}))}
        self.words = np.zeros((n, len(self.pages), _PAGE // 64), np.int64)
        for r in found:
            self.words[r["class"], self.pages[r.page]] = np.frombuffer(bytes(r.bits), "<i8")

    def told(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with the class as ``name``, -1 where it is not told."""
        page, slot, *words = (unused([*df.columns, name], c) for c in ("_page", "_slot", *(f"_words_{c}" for c in range(self.n))))
        ends = pa.array(np.arange(len(self.pages) + 1, dtype=np.int32) * (_PAGE // 64))
        table = pa.table({page: pa.array([p - 1 for p in self.pages], pa.int64())} | {w: pa.ListArray.from_arrays(ends, pa.array(self.words[c].ravel())) for c, w in enumerate(words)})
        pages = self.spark.createDataFrame(table)
        marked = df.withColumn(slot, F.pmod(key, F.lit(self.bits))).withColumn(page, F.floor(F.col(slot) / _PAGE))
        told = marked.join(F.broadcast(pages), page, "left")  # 32 MB at most
        bits = [F.coalesce(F.expr(f"bit_get(element_at({w}, CAST({slot} % {_PAGE} DIV 64 AS INT) + 1), CAST({slot} % 64 AS INT))").cast("int"), F.lit(0)) for w in words]
        alone = F.when(sum(bits[1:], bits[0]) == 1, sum((k * b for k, b in enumerate(bits[1:], 1)), F.lit(0))).otherwise(-1)
        return told.select(*df.columns, alone.cast("int").alias(name))
