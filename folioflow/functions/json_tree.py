"""Whole JSON texts of any depth as column expressions: members taken out by name, and leaves with their paths.

A text is cut into its tokens and these are folded from left to right, so a row needs no other row and no Python. Tokens are folded in
blocks, as each step copies what its block has given so far. Texts that are no JSON, null and blank ones among them, give null; so do
objects that name a key twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
_STRING = r'"(?:[^"\\]++|\\.)*+"'
#: A key with the value or the bracket that follows it, or one of these without a key. Commas say nothing that the order does not.
_TOKEN = rf'(?s)(?:({_STRING})\s*+:\s*+)?({_STRING}|[{{}}\[\]]|[^{{}}\[\],:"\s]++)'
_OBJECT = -1


def _tokens(text: Column) -> Column:
    part = lambda group: F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(group))
    return F.zip_with(part(1), part(2), lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _decoded(quoted: Column) -> Column:
    """What a quoted string says. Escapes are rare, so most strings are only cut."""
    return F.when(F.contains(quoted, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"k":'), quoted, F.lit("}")), "$.k")).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def valid_json(text: Column) -> Column:
    """The text if it is one JSON value, else null. The parser minds nothing after a value, so the text is put between both kinds of brackets: no rest closes both."""
    between = lambda one, other: F.concat(F.lit(one), text, F.lit(other))
    return F.when((F.json_array_length(between("[", "]")) == 1) & F.try_parse_json(between('{"v":', "}")).isNotNull(), text)


def _fold(text: Column, begin: Callable[[Column | None], Column], step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], last: Callable[[Column], Column]) -> Column:
    """``begin`` gives a block's state after that of another, ``step`` takes a token in, ``join`` adds a block's result to all before it."""
    blocks = let(_tokens(text), lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(all_, i + 1, BLOCK)))
    return F.aggregate(blocks, begin(None), lambda s, b: F.aggregate(b, begin(s), step, lambda r: join(s, r)), last)


def without_keys(text: Column, everywhere: Sequence[str] = (), root: Sequence[str] = (), only: Sequence[str] | None = None, any_case: bool = False) -> Column:
    """The text without the members named in ``everywhere`` at any depth, nor those of the root in ``root`` or not in ``only``.

    What is left keeps its order and its spelling; blanks between tokens go. ``any_case``: for ``everywhere`` the case of a key is nothing.
    """
    start = lambda out, depth, skip, opened: F.struct(out.alias("out"), depth.alias("depth"), skip.alias("skip"), opened.alias("opened"))

    def begin(s):
        return start(F.lit(""), F.lit(0), F.lit(-1), F.lit(True)) if s is None else start(F.lit(""), s["depth"], s["skip"], s["opened"])

    def hidden(key, depth):
        out = (F.lower(key) if any_case else key).isin(*everywhere) if everywhere else F.lit(False)
        out = out | ((depth == 1) & key.isin(*root)) if root else out
        return out | ((depth == 1) & ~key.isin(*only)) if only is not None else out

    def step(a, t):
        key, value, depth, inside = t["key"], t["value"], a["depth"], a["skip"] >= 0
        opens = value.isin("{", "[")
        deeper = F.when(opens, depth + 1).otherwise(depth)
        member = F.concat(a["out"], F.when(a["opened"], "").otherwise(","), F.when(key != "", F.concat(key, F.lit(":"))).otherwise(""), value)
        return (
            F.when(value.isin("}", "]"), F.when(inside, start(a["out"], depth - 1, F.when(depth - 1 == a["skip"], -1).otherwise(a["skip"]), a["opened"])).otherwise(start(F.concat(a["out"], value), depth - 1, F.lit(-1), F.lit(False))))
            .when(inside, start(a["out"], deeper, a["skip"], a["opened"]))
            .when((key != "") & hidden(_decoded(key), depth), start(a["out"], deeper, F.when(opens, depth).otherwise(-1), a["opened"]))
            .otherwise(start(member, deeper, F.lit(-1), opens))
        )

    join = lambda s, r: start(F.concat(s["out"], r["out"]), r["depth"], r["skip"], r["opened"])
    return let(text, lambda x: F.when(valid_json(x).isNotNull(), _fold(x, begin, step, join, lambda s: s["out"])))


def json_leaves(text: Column) -> Column:
    """path, kind and value of each leaf in the order of the text. kind: text, other (numbers, booleans), null, and object or list for empty ones.

    Paths join keys by dots and number the items of lists from 0, ``a.b[2]``; the root of a text that is a single value has the path "".
    Texts are decoded, numbers stand as they are spelt.
    """
    level = lambda path, n: F.struct(path.alias("path"), n.alias("n"))
    leaf = lambda path, kind, value: F.struct(path.alias("path"), kind.alias("kind"), value.alias("value"))
    text_or_null = F.lit(None).cast("string")

    none = F.array().cast("array<struct<path: string, kind: string, value: string>>")
    state = lambda out, stack, fresh: F.struct(out.alias("out"), stack.alias("stack"), fresh.alias("fresh"))

    def begin(s):
        return state(none, F.array().cast("array<struct<path: string, n: int>>"), F.lit(False)) if s is None else state(none, s["stack"], s["fresh"])

    def step(a, t):
        key, value, stack = t["key"], t["value"], a["stack"]
        top = F.try_element_at(stack, F.lit(-1))
        below = F.slice(stack, F.lit(1), F.size(stack) - 1)
        here = F.when(key != "", F.concat(top["path"], F.when(top["path"] != "", ".").otherwise(""), _decoded(key))).when(top.isNull(), "").otherwise(F.concat(top["path"], F.lit("["), top["n"].cast("string"), F.lit("]")))
        counted = F.when((key != "") | top.isNull(), stack).otherwise(F.concat(below, F.array(level(top["path"], top["n"] + 1))))
        empty = leaf(top["path"], F.when(top["n"] >= 0, "list").otherwise("object"), text_or_null)
        is_text = F.startswith(value, F.lit('"'))
        one = leaf(here, F.when(is_text, "text").when(value == "null", "null").otherwise("other"), F.when(is_text, _decoded(value)).when(value != "null", value))
        return (
            F.when(value.isin("}", "]"), state(F.when(a["fresh"], F.concat(a["out"], F.array(empty))).otherwise(a["out"]), below, F.lit(False)))
            .when(value.isin("{", "["), state(a["out"], F.concat(counted, F.array(level(here, F.when(value == "[", 0).otherwise(_OBJECT)))), F.lit(True)))
            .otherwise(state(F.concat(a["out"], F.array(one)), counted, F.lit(False)))
        )

    join = lambda s, r: state(F.concat(s["out"], r["out"]), r["stack"], r["fresh"])
    return let(text, lambda x: F.when(valid_json(x).isNotNull(), _fold(x, begin, step, join, lambda s: s["out"])))
