"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every document starts with a rate of one. Of all rates that are MOST at most and meet the token constraint of its source (the rated
words come to the target) the balanced ones are nearest to the start in relative entropy, summed over documents. They are exponential tilts, min(MOST, exp(tilt * z)) with z a
document's size over its source's mean, and the tilt is the minimum of a convex dual: of conjugates that are exponential below the bound and linear
beyond it. Newton steps find it, kept inside a bracket that the signs of the gradient narrow; a step that would leave it halves it instead. A source below its target so repeats its longer
documents first, one above it gives up the longer ones first, and short ones stay near one.
Each step is an aggregation over (source, size) counts, whose number doesn't grow with copies.

Rates are rounded into copies by systematic rounding in a random but fixed order of documents
(hash of id), within blocks of bounded size. What is then missing from a source's target, or too much, is
settled by partial copies of few documents in the same order, found by prefix sums over blocks.

A null text has no words and nothing is taken. A very long text is counted whole, and no tie changes a result. A null source is a source, last. Repeated
rows count each. Other columns are ignored. An empty table gives no rows. Sources without words have a target of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Classes, Workspace, unused

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: Newton steps are taken STEPS at a time until every source's dual gradient is below GAP of its target, MOST_STEPS at most.
STEPS, MOST_STEPS, GAP = 4, 64, 1e-7
BLOCK_ROWS = 20_000
#: Rates are fixed-point numbers of this scale, so that reruns round alike.
SCALE = 1_000_000


def n_words(text: Column) -> Column:
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \x09-\x0D]+")
    return (F.size(words) - F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, source_size).

    Weights go by rank. Targets share ``share`` of all words by weight, none above ``most`` times its source:
    sources are capped in the order of their capacity for each unit of weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    return rows.withColumn("water", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", F.coalesce(F.least(F.col("water") * F.col("weight"), (most * F.col("source_size")).cast("double")), (most * F.col("source_size")).cast("double")).alias("target")
    )


def tilts(counts: DataFrame, goals: DataFrame, work: Workspace, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """source, mean, tilt, gap: the dual solution of each source and the relative gradient that is left. ``counts`` has source, size, k."""
    base = counts.where("size > 0")
    ends = base.groupBy("source").agg((F.sum(F.col("k") * F.col("size")) / F.sum("k")).alias("mean"), F.min("size").alias("least"))
    # at ``low`` the rated words are no more than the target, since x * exp(-t * x) is 1 / (e * t) at most; at ``high`` every rate is at its bound
    low, high = -F.col("source_size") / (F.exp(F.lit(1.0)) * F.col("target")), math.log(most) * F.col("mean") / F.col("least")
    state = ["source", "target", "mean", "low", "high", "tilt"]
    now = (
        goals.where("source_size > 0").alias("g").join(ends.alias("m"), F.expr("g.source <=> m.source")).select("g.source", "source_size", "target", "mean", "least")
        .withColumns({"low": low, "high": high, "tilt": F.when(F.col("target") >= most * F.col("source_size"), high).otherwise(F.lit(0.0)), "gap": F.lit(None).cast("double")}).select(*state, "gap")
    )
    for k in range(MOST_STEPS):
        u = F.col("tilt") * F.col("size") / F.col("mean")
        words = F.col("k") * F.col("size") * F.exp(F.least(u, F.lit(math.log(most))))
        free = F.when(u < math.log(most), words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = base.alias("d").join(now.alias("t"), F.expr("d.source <=> t.source")).select(*(f"t.{c}" for c in state), "size", "k").groupBy(*state).agg(F.sum(words).alias("words"), F.sum(free).alias("slope"))
        gradient = F.col("words") - F.col("target")
        gap = F.abs(gradient) / F.col("target")
        told = sums.select(
            *(c for c in state if c not in ("low", "high")), F.when(gradient <= 0, F.col("tilt")).otherwise(F.col("low")).alias("low"), F.when(gradient >= 0, F.col("tilt")).otherwise(F.col("high")).alias("high"),
            gap.alias("gap"), (F.col("tilt") - gradient / F.when(F.col("slope") > 0, F.col("slope"))).alias("newton"),
        )
        step = F.when(F.col("gap") < GAP, F.col("tilt")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        now = told.select("source", "target", "mean", "low", "high", step.alias("tilt"), "gap")
        if k % steps == steps - 1:
            now = work.save(now, f"steps-{k}")
            if (now.agg(F.max("gap").alias("gap")).first().gap or 0.0) < GAP:
                break
    return now


def mix_sources(docs: DataFrame, work: Workspace | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST, number: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, taken, dual_gap (what Newton left of its source's gradient) for each row of ``docs`` (doc_id, text, source), and its number ``row``."""
    work = work or Workspace(docs.sparkSession, "mix")
    rows = docs.select((F.monotonically_increasing_id() if number is None else number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = work.save(rows, "sizes")
    counts = work.save(rows.groupBy("source", "size").agg(F.count("*").alias("k")), "counts")
    goals = work.save(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.sum("k").alias("docs")), weights, share, most), "targets")
    solved = tilts(counts, goals, work, most).select("source", "mean", "tilt", "gap")
    rates = (
        counts.alias("c").join(goals.alias("g"), F.expr("c.source <=> g.source")).join(solved.alias("t"), F.expr("c.source <=> t.source"), "left")
        .select("c.source", "size", "source_size", "target", F.coalesce("gap", F.lit(0.0)).alias("gap"), F.when(F.col("size") > 0, F.round(SCALE * F.exp(F.least(F.lit(math.log(most)), F.col("tilt") * F.col("size") / F.col("mean")))).cast("long")).otherwise(0).alias("micro"))
    )
    parts = counts.groupBy("source").agg(F.ceil(F.sum("k") / BLOCK_ROWS).alias("parts"))
    rates = work.save(rates.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source")).select("r.*", "parts"), "rates")

    rows = rows.alias("d").join(rates.alias("r"), F.expr("d.source <=> r.source") & (F.col("d.size") == F.col("r.size"))).select("row", "doc_id", "d.source", "d.size", "source_size", "target", "gap", "micro", F.xxhash64("doc_id", F.lit(5)).alias("h"), F.pmod(F.xxhash64(F.coalesce("doc_id", "row"), F.lit(6)), F.col("parts")).alias("block"))
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum("micro").over(inside)
    whole = lambda c: F.floor((c + SCALE // 2) / F.lit(SCALE))
    rows = rows.withColumn("passed", passed).withColumn("copies", F.least(F.lit(most), whole(F.col("passed")) - whole(F.col("passed") - F.col("micro"))))
    rows = work.save(rows.withColumn("most", most * F.col("size")).drop("passed"), "copies")

    taken = F.col("copies") * F.col("size")
    sums = rows.groupBy("source", "block").agg(F.sum(taken).alias("taken"), F.sum(F.col("most") - taken).alias("free"), F.first("target").alias("target"))
    whole_source = Window.partitionBy("source")
    before = whole_source.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({
        "missing": F.round("target").cast("long") - F.sum("taken").over(whole_source),
        "free_before": F.coalesce(F.sum("free").over(before), F.lit(0)), "taken_before": F.coalesce(F.sum("taken").over(before), F.lit(0)),
    }).select("source", "block", "missing", "free_before", "taken_before")
    rows = rows.alias("d").join(sums.alias("s"), F.expr("d.source <=> s.source and d.block = s.block")).select("d.*", "missing", "free_before", "taken_before")
    earlier = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("free_before") + F.coalesce(F.sum(F.col("most") - taken).over(earlier), F.lit(0))
    held = F.col("taken_before") + F.coalesce(F.sum(taken).over(earlier), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("missing") - free, F.col("most") - taken))
    less = F.greatest(F.lit(0), F.least(-F.col("missing") - held, taken))
    return rows.withColumn("taken", (taken + more - less).cast("long")).select("row", "doc_id", "source", "size", "source_size", "target", (F.col("micro") / SCALE).alias("rate"), "taken", F.col("gap").alias("dual_gap"))


def copies(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, a partial copy rounded to a whole one or none.

    Rows that are alike in id, source and text may stand for one another. No text is cut. At most one document of each source and block is taken in part, so sources stay near their targets.
    """
    work = work or Workspace(docs.sparkSession, "mix")
    key, times, rows, kind = (unused(docs.columns, c) for c in ("_mix_key", "_mix_times", "_mix_rows", "_mix_kind"))
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("source").cast("string"), F.col("source").isNull(), F.col("text").cast("string")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = mix_sources(marked, work, number=F.col(key)).groupBy(F.col("row").alias(key)).agg(F.sum(whole).cast("int").alias(times), F.count("*").alias(rows))
    plan = work.save(plan, "plan")
    # texts stay where they are read: most rows are told how often they are taken, only the others are joined
    classes = Classes(plan.select(key, F.when(F.col(rows) > 1, MOST + 1).otherwise(F.col(times))), MOST + 2)
    told = classes.told(marked, F.col(key), kind)
    sure = told.where(F.col(kind).between(1, MOST)).withColumn(times, F.col(kind))
    several = told.where(~F.col(kind).between(0, MOST)).join(plan.where(F.col(times) > 0), key)
    # rows that are alike share their copies, so one of them stands for all
    several = several.where(F.col(rows) == 1).unionByName(several.where(F.col(rows) > 1).dropDuplicates([key]))
    columns = [*docs.columns, times]
    return sure.select(*columns).unionByName(several.select(*columns)).withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "dual_gap")
