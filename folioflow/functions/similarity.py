"""Likeness of short texts, computed over distinct pairs: with array functions only, or pair by pair inside tasks that hold both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_length(one: Column, two: Column) -> Column:
    """Length of the longest common subsequence of two texts. Both should be columns, not expressions: they are read for each character."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def step(row: Column, c: Column) -> Column:
        # a row of the table is the running maximum of what its cells could be
        cells = F.zip_with(F.slice(row, F.lit(1), F.length(two)), F.zip_with(F.slice(row, F.lit(2), F.length(two)), chars(two), lambda up, d: F.struct(up.alias("up"), (d == c).alias("same"))), lambda left, x: F.when(x["same"], left + 1).otherwise(x["up"]))
        return F.aggregate(cells, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), v))))

    return F.when((one == "") | (two == ""), 0).otherwise(F.element_at(F.aggregate(chars(one), F.array_repeat(F.lit(0), F.length(two) + 1), step), -1))


def with_token_set_ratio(rows: DataFrame, one: str, two: str, out: str = "ratio") -> DataFrame:
    """Adds the token-set ratio of two normalised texts, from 0 to 1: words that both have, put together with what each has besides, compared by insertions and deletions.

    1 for equal texts and for a text whose words the other has all; 0 if either is empty or null. Each distinct pair is compared once.
    """
    pairs = rows.select(F.col(one).alias("a_"), F.col(two).alias("b_")).where("a_ <> '' and b_ <> '' and a_ <> b_").distinct()
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda x: x != "")))
    text = lambda ws: F.array_join(F.array_sort(ws), " ")
    told = pairs.withColumns({"wa_": words("a_"), "wb_": words("b_")}).select("a_", "b_", text(F.array_intersect("wa_", "wb_")).alias("both_"), text(F.array_except("wa_", "wb_")).alias("da_"), text(F.array_except("wb_", "wa_")).alias("db_"))
    told = told.withColumn("away_", F.length("da_") + F.length("db_") - 2 * common_length(F.col("da_"), F.col("db_")))
    some = F.when(F.col("both_") != "", 1).otherwise(0)
    n, x, y = F.length("both_"), F.length("da_"), F.length("db_")
    share = lambda away, size: 1 - away / size
    best = F.greatest(share(F.col("away_"), 2 * (n + some) + x + y), F.when(n > 0, F.greatest(share(some + x, 2 * n + some + x), share(some + y, 2 * n + some + y))))
    told = told.select("a_", "b_", F.when((n > 0) & ((x == 0) | (y == 0)), F.lit(1.0)).otherwise(best).alias("ratio_"))
    a, b = F.col(one), F.col(two)
    out_ = F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.col("ratio_"))
    return rows.join(told, (a == F.col("a_")) & (b == F.col("b_")), "left").select(*rows.columns, out_.alias(out))


def common_length_of(one: str, two: str) -> int:
    """``common_length`` of two texts; a row of the table is one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for c in two:
        same = row & places.get(c, 0)
        row = (row + same | row - same) & full
    return len(one) - row.bit_count()


def token_set_ratio_of(one: str, two: str) -> float:
    """The ratio of ``with_token_set_ratio`` for two texts."""
    if not one or not two:
        return 0.0
    if one == two:
        return 1.0
    a, b = set(one.split(" ")) - {""}, set(two.split(" ")) - {""}
    da, db, n = " ".join(sorted(a - b)), " ".join(sorted(b - a)), len(" ".join(a & b))
    x, y, some = len(da), len(db), int(n > 0)
    if n and not (x and y):
        return 1.0
    best = 1 - (x + y - 2 * common_length_of(da, db)) / (2 * (n + some) + x + y)
    return max(best, 1 - (some + x) / (2 * n + some + x), 1 - (some + y) / (2 * n + some + y)) if n else best


def lcs_sql(pairs: str) -> str:
    """CTEs of the same lengths for DuckDB: ``lcs`` (x, y, n) of the distinct pairs that ``pairs`` (x, y) has."""
    return f"""lp AS (SELECT DISTINCT x, y FROM {pairs} WHERE x <> '' AND y <> ''),
lr(x, y, i, r) AS (
  SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda j: 0) FROM lp
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(c[1:j])) FROM (
    SELECT x, y, i, list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN 0 WHEN y[j] = x[i + 1] THEN r[j] + 1 ELSE r[j + 1] END) AS c FROM lr WHERE i < length(x)
  )
), lcs AS (SELECT x, y, r[length(y) + 1] AS n FROM lr WHERE i = length(x))"""


def ratio_sql(pairs: str) -> str:
    """CTEs for DuckDB: ``tsr`` (a, b, ratio) of the distinct pairs that ``pairs`` (a, b) has, both not empty and not equal."""
    text = "array_to_string(list_sort({}), ' ')"
    words = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
    return f"""dp AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '' AND a <> b),
dw AS (SELECT a, b, {words.format('a')} AS wa, {words.format('b')} AS wb FROM dp),
dd AS (SELECT a, b, {text.format('list_filter(wa, lambda w: list_contains(wb, w))')} AS s, {text.format('list_filter(wa, lambda w: NOT list_contains(wb, w))')} AS x, {text.format('list_filter(wb, lambda w: NOT list_contains(wa, w))')} AS y FROM dw),
{lcs_sql('dd')},
da AS (SELECT dd.*, length(dd.x) + length(dd.y) - 2 * coalesce(n, 0) AS away, CASE WHEN s <> '' THEN 1 ELSE 0 END AS k FROM dd LEFT JOIN lcs ON lcs.x = dd.x AND lcs.y = dd.y),
tsr AS (SELECT a, b, CASE WHEN s <> '' AND (x = '' OR y = '') THEN 1.0::DOUBLE ELSE greatest(1 - away::DOUBLE / (2 * (length(s) + k) + length(x) + length(y)),
  CASE WHEN s <> '' THEN 1 - (k + length(x))::DOUBLE / (2 * length(s) + k + length(x)) END, CASE WHEN s <> '' THEN 1 - (k + length(y))::DOUBLE / (2 * length(s) + k + length(y)) END) END AS ratio FROM da)"""
