"""Free-form JSON payloads, usable text, and whether two values of a field agree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ACCENTED, PLAIN
from ..functions.json_tree import json_leaves
from ..functions.similarity import ratio_sql, token_set_ratio_of, with_token_set_ratio
from ..sources.ledger import table
from .fields import iso_dates

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\r\n|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD, DIGIT = r"[\p{L}\p{N}_]+", r"\p{Nd}"


def leaves_of(payload: Column) -> Column:
    """Path and value of the leaves of a JSON text by path. Blank text, null, {} and [] are leaves without a value; what is no JSON has none."""
    blank = lambda x: F.regexp_replace(x, SPACE, F.lit("")) == ""
    found = F.transform(json_leaves(payload), lambda x: F.struct(x["path"].alias("path"), F.when(~blank(x["value"]), x["value"]).alias("value")))
    return F.array_sort(F.coalesce(found, F.array().cast("array<struct<path: string, value: string>>")))


def leaves(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, path and value of every leaf."""
    return rows.select(key, F.explode(leaves_of(F.col(payload))).alias("leaf")).select(key, "leaf.path", "leaf.value")


def completeness(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Filled leaves of each payload, all leaves, and the filled share in percent; null if there is none."""
    found = rows.select(key, leaves_of(F.col(payload)).alias("leaves"))
    filled = F.size(F.filter("leaves", lambda x: x["value"].isNotNull()))
    return found.select(key, filled.alias("filled"), F.size("leaves").alias("leaves")).withColumn("share", F.round(F.try_divide(100.0 * F.col("filled"), F.col("leaves")), 1))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "k int")["k"]
    payload = F.to_json(F.struct(F.struct(F.col("user_id").alias("id"), F.lit(" ").alias("note")).alias("user"), F.array(F.struct(F.when(props % 2 == 0, props).alias("k")), F.struct((props + 1).alias("k"))).alias("items"), F.expr("array()").cast("array<int>").alias("tags")), {"ignoreNullFields": "false"})
    return table(spark, d, "events").select("event_id", payload.alias("payload"))


def payload_leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaves(_payloads(spark, d), "event_id", "payload")


def payload_completeness(spark: SparkSession, d: str) -> DataFrame:
    return completeness(_payloads(spark, d), "event_id", "payload")


def text_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, score (0 to 100), usable and reasons of each text; null is an empty text. Noise is the share of U+FFFD."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    rows = docs.withColumn("t_", t).withColumn("lines_", F.filter(F.split("t_", BREAK), lambda x: F.regexp_replace(x, SPACE, F.lit("")) != ""))
    rows = rows.withColumns({
        "characters": F.length("t_"), "words": F.regexp_count("t_", F.lit(WORD)), "lines": F.size("lines_"), "digits": F.regexp_count("t_", F.lit(DIGIT)),
        "table_lines": F.size(F.filter("lines_", lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)),
        "noise": (F.length("t_") - F.length(F.replace("t_", F.lit("\ufffd"), F.lit("")))) / F.greatest(F.length("t_"), F.lit(1)),
    })
    return rows.withColumn("score", F.expr(SCORE_SQL)).withColumns({"usable": F.expr(USABLE_SQL), "reasons": F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in REASONS])), ";")}).select(*docs.columns, "characters", "words", "lines", "digits", "table_lines", "score", "usable", "reasons")


#: What counts for a text, as SQL over its counts.
SCORE_SQL = """round(greatest(cast(0 as double), least(cast(100 as double), cast(case when characters >= 250 then 25 when characters >= 80 then 12 else 0 end + case when words >= 45 then 25 when words >= 15 then 12 else 0 end
  + case when lines >= 6 then 15 when lines >= 3 then 7 else 0 end + case when table_lines > 0 then 20 else 0 end + case when digits >= 8 then 10 else 0 end as double)
  + case when noise <= 0.04 then cast(5 as double) else -least(cast(20 as double), noise * 100) end)), 1)"""
USABLE_SQL = "score >= 55 and characters >= 120 and words >= 25"
REASONS = (("short", "characters < 120"), ("few words", "words < 25"), ("noisy", "noise > 0.08"), ("no table", "table_lines = 0"))


def usable_texts(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents").select("doc_id", "text")).drop("text")


def _plain(value: Column, between: str) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(value, F.lit(""))), ACCENTED, PLAIN), "[^a-z0-9]+", between))


_FOLDED = str.maketrans(ACCENTED, PLAIN)
# Texts that count as empty in comparisons.
EMPTY_VALUES = ("", "null", "none", "n/a", "na", "non detecte", "inconnu")


def with_match(rows: DataFrame, expected: str, actual: str, amounts: bool = False, dates: bool = False, least: float = 0.92) -> DataFrame:
    """Adds ``match``: both empty; amounts within 0.01; the same date; equal letters and digits; one within the other (six of them at least); or a token-set ratio of ``least``.

    Texts are compared for pairs that the other rules leave open, each distinct pair once.
    """
    a, b = _plain(F.col(expected), ""), _plain(F.col(actual), "")
    number = lambda c: F.try_element_at(F.regexp_extract_all(F.regexp_replace(F.col(c), r"[\s\x{A0}]", ""), F.lit(r"[0-9]+(?:[,.][0-9]+)?"), F.lit(0)), F.lit(-1))
    value = lambda c: F.replace(number(c), F.lit(","), F.lit(".")).cast("double")
    day = lambda c: F.coalesce(F.get(iso_dates(F.col(c)), F.lit(0)), F.nullif(F.regexp_replace(F.col(c), "[^0-9]+", ""), F.lit("")))
    blank = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin(*EMPTY_VALUES)
    known = F.when(blank(expected) | blank(actual), blank(expected) & blank(actual))
    if amounts:
        known = known.when(value(expected).isNotNull() & value(actual).isNotNull(), F.abs(value(expected) - value(actual)) <= 0.01)
    if dates:
        known = known.when(day(expected).isNotNull() & day(actual).isNotNull(), day(expected) == day(actual))
    known = known.when((a != "") & (a == b), True).when((F.length(a) >= 6) & (F.length(b) >= 6) & (F.contains(a, b) | F.contains(b, a)), True)
    out = rows.withColumn("known_", known)
    open_ = lambda c: F.when(F.col("known_").isNull(), _plain(F.col(c), " "))
    out = with_token_set_ratio(out.withColumns({"one_": open_(expected), "two_": open_(actual)}), "one_", "two_", "ratio_")
    return out.withColumn("match", F.coalesce("known_", F.col("ratio_") >= least)).drop("known_", "one_", "two_", "ratio_")


def texts_match(expected: str | None, actual: str | None, amounts: bool = False, least: float = 0.92) -> bool:
    """The ``match`` of ``with_match`` without dates, for two texts inside a task."""
    both = expected or "", actual or ""
    blank = [x.strip(" ").lower() in EMPTY_VALUES for x in both]
    if any(blank):
        return all(blank)
    if amounts:
        numbers = [re.findall(r"[0-9]+(?:[,.][0-9]+)?", re.sub(r"[ \t\n\x0b\f\r\xa0]", "", x)) for x in both]
        if all(numbers):
            one, two = (float(x[-1].replace(",", ".")) for x in numbers)
            return abs(one - two) <= 0.01
    a, b = (plain_of(x, "") for x in both)
    if (a and a == b) or (len(a) >= 6 and len(b) >= 6 and (a in b or b in a)):
        return True
    return token_set_ratio_of(*(plain_of(x, " ") for x in both)) >= least


def plain_of(value: str | None, between: str) -> str:
    return re.sub("[^a-z0-9]+", between, (value or "").lower().translate(_FOLDED)).strip(" ")


def matched_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names against spoiled readings of them: another case, a lost letter, half of it, another name, words in another order, nothing."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 6
    read = F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(F.substring(name, 1, 3), F.expr("substr(p_name, 5)"))).when(kind == 2, F.expr("substr(p_name, 1, cast(length(p_name) / 2 as int))")).when(kind == 3, F.col("p_type")).when(kind == 4, F.concat(F.regexp_replace(name, r"^(\S+) (.*)$", "$2 $1"), F.lit(" n/a "), F.col("p_type")))
    return with_match(table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), name.alias("expected"), read.alias("actual")), "expected", "actual")


QUERIES = {f.__name__: f for f in (payload_leaves, payload_completeness, usable_texts, matched_names)}
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
ORACLES = {
    "payload_leaves": f"""SELECT event_id, 'user.id' AS path, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'user.note', NULL FROM events UNION ALL SELECT event_id, 'tags', NULL FROM events
        UNION ALL SELECT event_id, 'items[0].k', CASE WHEN {_K} % 2 = 0 THEN CAST({_K} AS VARCHAR) END FROM events UNION ALL SELECT event_id, 'items[1].k', CAST({_K} + 1 AS VARCHAR) FROM events""",
    "payload_completeness": f"""WITH f AS (SELECT event_id, CAST((user_id IS NOT NULL)::INT + coalesce({_K} % 2 = 0, false)::INT + ({_K} IS NOT NULL)::INT AS INTEGER) AS filled FROM events)
        SELECT event_id, filled, CAST(5 AS INTEGER) AS leaves, round(100.0::DOUBLE * filled / 5, 1) AS share FROM f""",
    "matched_names": f"""WITH RECURSIVE m AS (
          SELECT p_partkey AS part_id, p_name AS expected, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name[1:3] || p_name[5:] WHEN 2 THEN p_name[1 : length(p_name) // 2] WHEN 3 THEN p_type
            WHEN 4 THEN regexp_replace(p_name, '^(\\S+) (.*)$', '\\2 \\1') || ' n/a ' || p_type END AS actual FROM part),
        n AS (SELECT *, trim(regexp_replace(lower(expected), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(coalesce(actual, '')), '[^a-z0-9]+', ' ', 'g')) AS b FROM m), {ratio_sql('n')}
        SELECT part_id, expected, actual, CASE WHEN actual IS NULL THEN false WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN true
          WHEN length(replace(a, ' ', '')) >= 6 AND length(replace(b, ' ', '')) >= 6 AND (contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', ''))) THEN true
          ELSE coalesce(ratio, 0) >= 0.92 END AS match FROM n LEFT JOIN tsr USING (a, b)""",
    "usable_texts": f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM documents),
        l AS (SELECT *, list_filter(regexp_split_to_array(t, '{BREAK}'), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS ls FROM t),
        c AS (SELECT doc_id, CAST(length(t) AS INTEGER) AS characters, CAST(len(regexp_extract_all(t, '{WORD}')) AS INTEGER) AS words, CAST(len(ls) AS INTEGER) AS lines, CAST(len(regexp_extract_all(t, '{DIGIT}')) AS INTEGER) AS digits,
          CAST(len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) AS INTEGER) AS table_lines, (length(t) - length(replace(t, chr(65533), '')))::DOUBLE / greatest(length(t), 1) AS noise FROM l),
        s AS (SELECT *, {SCORE_SQL} AS score FROM c)
        SELECT doc_id, characters, words, lines, digits, table_lines, score, {USABLE_SQL} AS usable, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REASONS)}], lambda x: x IS NOT NULL), ';') AS reasons FROM s""",
}
