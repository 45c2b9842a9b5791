"""Datasets and evaluation: eligibility, stratified split, chat export, rates, domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.ledger import table

LEAST_CHARS = 80


def eligible(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verified documents with enough text."""
    return docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").where(F.length(F.trim("text")) >= LEAST_CHARS)


def training_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents used and skipped, by language."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    used = eligible(docs, table(spark, d, "labels")).groupBy("lang").agg(F.count("*").alias("used"))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(used, "lang", "left").select("lang", F.coalesce("used", F.lit(0)).alias("used"), (F.col("n") - F.coalesce("used", F.lit(0))).alias("skipped"))


def split_by(rows: DataFrame, stratum: str, key: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """A stratified split in the order of a hash of the key, so reruns agree.

    One row goes to train, two go to train and validation; more keep at least one row in each of the three parts.
    """
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    placed = rows.withColumn("r", F.row_number().over(order)).join(sizes, stratum)
    n = F.col("n")
    a, b = F.greatest(F.lit(1), F.floor(n * train)), F.greatest(F.lit(1), F.floor(n * validation))
    full = a + b >= n
    a, b = F.when(n <= 2, 1).when(full, n - 2).otherwise(a), F.when(n <= 2, n - 1).when(full, 1).otherwise(b)
    return placed.withColumn("split", F.when(F.col("r") <= a, "train").when(F.col("r") <= a + b, "validation").otherwise("test")).drop("r", "n")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_by(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn with the user turn before it, as a JSON list of messages."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"before_role": F.lag("role").over(turns), "before": F.lag("text").over(turns)}).where("role = 'assistant' and before_role = 'user'")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select("conv_id", "turn", F.to_json(F.array(message("user", F.col("before")), message("assistant", F.col("text")))).alias("messages"))


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = lambda x: F.coalesce(F.round(x, 4), F.lit(0.0))
    return {"precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)), "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn))}


def eval_rates(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of predicted totals by order status; the prediction is the sum of the order's items, within a tenth."""
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("predicted"))
    rows = table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("truth", F.col("o_totalprice").cast("decimal(18,2)"))
    hit = F.abs(F.col("predicted") - F.col("truth")) * 10 <= F.col("truth")
    counts = rows.groupBy("o_orderstatus").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("predicted").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("predicted").isNull() | ~hit).alias("fn"))
    return counts.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"))).withColumnRenamed("o_orderstatus", "status")


def page_domains(spark: SparkSession, d: str) -> DataFrame:
    """Pages by domain, without scheme, port and a leading www."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    return table(spark, d, "pages").select("page_id", host.alias("domain")).groupBy("domain").agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (training_filter, stratified_split, chat_export, eval_rates, page_domains)}
ORACLES = {
    "training_filter": f"""WITH u AS (SELECT lang, count(*) AS used FROM documents WHERE length(trim(text)) >= {LEAST_CHARS} AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang)
        SELECT d.lang, coalesce(u.used, 0) AS used, d.n - coalesce(u.used, 0) AS skipped FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d LEFT JOIN u USING (lang)""",
    "stratified_split": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
        , c AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS a0, greatest(1, floor(n * 0.15::DOUBLE)) AS b0 FROM r),
        x AS (SELECT *, CASE WHEN n <= 2 THEN 1 WHEN a0 + b0 >= n THEN n - 2 ELSE a0 END AS a, CASE WHEN n <= 2 THEN n - 1 WHEN a0 + b0 >= n THEN 1 ELSE b0 END AS b FROM c)
        SELECT doc_id, lang, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM x""",
    "chat_export": """WITH t AS (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, CAST(to_json([{'role': 'user', 'content': before}, {'role': 'assistant', 'content': text}]) AS VARCHAR) AS messages FROM t WHERE role = 'assistant' AND before_role = 'user'""",
    "eval_rates": """WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS predicted FROM lineitem GROUP BY 1),
        r AS (SELECT o_orderstatus AS status, predicted, abs(predicted - CAST(o_totalprice AS DECIMAL(18,2))) * 10 <= CAST(o_totalprice AS DECIMAL(18,2)) AS hit FROM orders LEFT JOIN p ON l_orderkey = o_orderkey),
        c AS (SELECT status, count(*) FILTER (hit) AS tp, count(*) FILTER (predicted IS NOT NULL AND NOT hit) AS fp, count(*) FILTER (predicted IS NULL OR NOT hit) AS fn FROM r GROUP BY status)
        SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 4), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0.0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0.0) AS f1 FROM c""",
    "page_domains": "SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1",
}
