"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

Every rule is a regular expression over host and path, with literal tokens that any URL it
matches must hold. A rule is filed under the token that the fewest URLs hold; a URL's own tokens fetch
the rules filed under them, and only those run their expression. A rule without a literal token is run on every URL.
Of rules of equal rank the one that sorts last by name, then by verdict, wins.

Null URLs and URLs without ``://`` have an empty host and path and match no rule. Equal URLs are
judged once. Repeated rows stay repeated, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules are broadcast up to this count and size; beyond them they are joined by a shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 50_000, 32 << 20
RULE_SCHEMA = "rule string, verdict string, rank long, regex string, tokens array<string>"
#: Host words of gambling and adult sites, blocked where no site rule fits.
BLOCKED_WORDS = ["adult", "bet", "bets", "betting", "casino", "casinos", "escort", "gambling", "poker", "porn", "roulette", "slots", "viagra", "xxx"]
SITE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def site_rule(rule: str, verdict: str) -> tuple:
    """A rule like ``example.net/en/``: the host and its subdomains, paths that start so. Longer ones rank higher.

    A last token that may go on in the URL is not one to file the rule by.
    """
    host, slash, path = rule.partition("/")
    literal = f"{host.lower()}{slash}{path}"
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", literal.translate(str.maketrans(UPPER, LOWER)))
    return (rule, verdict, 1000 + len(rule), r"(?s)^(?:[^/]*\.)?" + "".join(c if c.isalnum() else "\\" + c for c in literal), tokens)


def word_rule(word: str, verdict: str = "block") -> tuple:
    """A rule for hosts with this word between characters other than letters and digits. It has no name in the result."""
    return (None, verdict, len(word), rf"(?s)^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", [word])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url). ``rules`` has RULE_SCHEMA; the highest rank wins."""
    host, path = host_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    keys = rows.where("key <> ''").select("key").distinct()
    told = rules.agg(F.count("*").alias("n"), F.sum(F.length("regex") + F.length(F.concat_ws("", "tokens")) + 100).alias("bytes"), F.max(F.size(F.coalesce("tokens", F.array())) == 0).alias("bare")).first()
    # every URL speaks the empty token where some rule has no other
    said = F.array_distinct(F.split(F.translate("key", UPPER, LOWER), "[^a-z0-9]+"))
    said = F.array_union(F.filter(said, lambda t: t != ""), F.array(F.lit("")) if told.bare else F.array().cast("array<string>"))
    spoken = keys.withColumn("token", F.explode(said))
    filed = rules.select("*", F.explode(F.when(F.size(F.coalesce("tokens", F.array())) > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    few = told.n <= BROADCAST_RULES and (told.bytes or 0) <= BROADCAST_BYTES
    small = F.broadcast if few else (lambda x: x)
    used = spoken.join(small(filed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    index = (
        filed.join(used, "token", "left").groupBy("rule", "verdict", "rank", "regex")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("least")).select("rule", "verdict", "rank", "regex", "least.token")
    )
    best = (
        spoken.join(small(index), "token").where(F.expr("regexp_like(key, regex)"))
        .groupBy("key").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    )
    return rows.join(best, "key", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(lines: DataFrame) -> DataFrame:
    """RULE_SCHEMA rows from ``lines`` (rule, verdict), such as a list read from a file.

    ``host/path`` is a site rule, ``*word*`` one for hosts with the word, ``/expression/`` one for host and path, run as it stands on every URL. Blank rules and those
    that start with ``#`` are left out. Site rules outrank words, longer ones shorter ones; expressions rank between.
    """
    text = F.trim("rule")
    rows = lines.select(text.alias("rule"), "verdict").where("rule is not null and rule <> '' and not startswith(rule, '#')")
    host, path = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER), F.regexp_extract("rule", "(?s)/(.*)$", 1)
    literal = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")
    site = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), literal(F.concat(host, F.lit("/"), path)))
    word = F.regexp_extract("rule", r"^\*([A-Za-z0-9]+)\*$", 1)
    is_word, is_expression = word != "", F.col("rule").rlike("(?s)^/.*/$")
    # a last token that may go on in the URL is not one to file the rule by
    own = F.regexp_extract_all(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), F.lit(r"([a-z0-9]+)(?=[^a-z0-9])"), 1)
    return rows.select(
        F.when(~is_word & ~is_expression, F.col("rule")).alias("rule"), "verdict", F.when(is_word, F.length(word)).when(is_expression, 500).otherwise(1000 + F.length("rule")).cast("long").alias("rank"),
        F.when(is_word, F.concat(F.lit("(?s)^(?:[^/]*[^a-z0-9/])?"), F.translate(word, UPPER, LOWER), F.lit("(?:[^a-z0-9]|$)"))).when(is_expression, F.expr("substring(rule, 2, length(rule) - 2)")).otherwise(site).alias("regex"),
        F.when(is_word, F.array(F.translate(word, UPPER, LOWER))).when(is_expression, F.array().cast("array<string>")).otherwise(own).alias("tokens"),
    )


def standard_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*(site_rule(*x) for x in SITE_RULES), *(word_rule(w) for w in BLOCKED_WORDS)], RULE_SCHEMA)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), standard_rules(spark))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages
), r(rule, verdict, h, q) AS (VALUES {", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in SITE_RULES)}),
m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC) AS k
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, CASE WHEN regexp_matches(p.host, '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON m.k = 1 AND m.page_id = p.page_id AND m.host = p.host AND m.path = p.path
"""
