"""A training corpus from raw documents: toxic and poor documents go, near copies go, sources are mixed, the rest is packed.

All stages but the last give the columns of what they read, whatever their names. Null ids and sources are values like others, a null text
is an empty one, texts are used whole, and an empty table stays empty. What becomes of ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.jaccard_join import one_of_each
from folioflow.llm.line_rules import without_rejected
from folioflow.llm.mixing import copies
from folioflow.llm.packing import pack_documents
from folioflow.llm.toxicity import fit, without_toxic
from folioflow.llm.workspace import Workspace, free_shuffles


#: Rows that a Python worker is given at once: documents are long, and a worker holds several batches.
BATCH_ROWS = 1000


def _prepare(spark: SparkSession) -> None:
    """Short batches from here on; shuffle files of earlier stages go."""
    free_shuffles(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic. Equal texts have equal scores, so repeated rows stay or go together; without toxic labels all stay."""
    _prepare(spark)
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a base rule or are depleted by the removal of common lines; those lines go from the others.

    The first document of a common line (least id, nulls last) keeps it, and so do rows that repeat that document. Empty texts fail.
    """
    _prepare(spark)
    return without_rejected(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of least id, nulls last, then of least text hash. Of repeated rows one stays; texts without words link with nothing."""
    _prepare(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or leaves out documents so that sources come to their target weights. Copies are whole rows; texts without words are left out."""
    _prepare(spark)
    return copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. Each row is a document of its own, also one that the mix has repeated."""
    _prepare(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("n-gram jaccard join", jaccard_join), ("mixing", mixing), ("packing", packing)]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each but the last is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs, f"stage-{k}")
    return docs
