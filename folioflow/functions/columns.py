"""Column helpers with one meaning everywhere: presence, folded text, amounts, dates and quality bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def present(value: Column) -> Column:
    """Null and empty text count as missing."""
    return F.nullif(F.trim(value), F.lit(""))


def folded(value: Column) -> Column:
    """Lower case, Latin accents dropped, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(value), ACCENTED, PLAIN), r"\s+", " "))


def last_amount(line: Column) -> Column:
    """The last number with two decimals in a line, or null."""
    return F.nullif(F.regexp_extract(line, r"(-?[0-9]+[.][0-9]{2})[^0-9]*$", 1), F.lit("")).cast("decimal(18,2)")


def band(quality: Column) -> Column:
    return F.when(quality.isNull(), "N/A").when(quality < 50, "to check").when(quality < 75, "correct").otherwise("reliable")


def url_key(path: Column) -> Column:
    """A path as base64 that URLs can hold, without padding."""
    return F.rtrim(F.translate(F.base64(path.cast("binary")), "+/", "-_"), F.lit("="))


def from_url_key(key: Column) -> Column:
    """The path that a key names; null for what is no key."""
    padded = F.concat(F.translate(key, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(key), F.lit(4))))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
