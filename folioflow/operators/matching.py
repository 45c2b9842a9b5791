"""Expected rows against predicted ones: exact names first, then the likest name, with counters for each document.

A document's predicted rows stand for their names, the first of a name for all of them. An expected row takes the predicted one of its name, else the one of the highest likeness, from LEAST on, the
earliest of equal ones; several expected rows may take the same one, as counters expect it. Rows without a name are left out. Names meet within their document only: documents are dealt out once, and a task takes many whole ones at a
time; each distinct pair of names that could be alike is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import group_starts, whole_groups
from ..functions.similarity import ratio_sql, token_set_ratio_of
from ..sources.ledger import table
from .fields import all_rates
from .payloads import EMPTY_VALUES, plain_of, texts_match

LEAST = 0.90
# Rows that a task takes at a time (a document is never cut), pairs of names at a time, rows that it hands back at a time, texts or pairs that it remembers.
BLOCK, PAIRS, BATCH, MOST_KNOWN = 200_000, 1_000_000, 10_000, 300_000
LETTER = np.zeros(256, np.int64)  # of names as they are compared: a to z, 0 to 9 and blank
LETTER[[*b"abcdefghijklmnopqrstuvwxyz0123456789 "]] = np.arange(37)


class _Known:
    """What a task remembers of texts: keys and words of names, ratios of pairs, matches of values and units. All can be found again, so it forgets when it knows too much."""

    def __init__(self) -> None:
        self.names: dict[str | None, tuple[str, str]] = {}
        self.ratios: dict[tuple[str, str], float] = {}
        self.values: dict[tuple[str | None, str | None], bool] = {}
        self.units: dict[tuple[str | None, str | None], bool] = {}

    def forget(self) -> None:
        for known in (self.names, self.ratios, self.values, self.units):
            if len(known) > MOST_KNOWN:
                known.clear()

    def name(self, x: str | None) -> tuple[str, str]:
        return self.names.get(x) or self.names.setdefault(x, (plain_of(x, ""), plain_of(x, " ")))

    def ratio(self, *x: str) -> float:
        out = self.ratios.get(x)
        return self.ratios.setdefault(x, token_set_ratio_of(*x)) if out is None else out

    def value_ok(self, *x: str | None) -> bool:
        out = self.values.get(x)
        return self.values.setdefault(x, texts_match(*x, amounts=True)) if out is None else out

    def unit_ok(self, *x: str | None) -> bool:
        """Units agree, or none is expected."""
        out = self.units.get(x)
        return self.units.setdefault(x, (x[0] or "").strip(" ").lower() in EMPTY_VALUES or texts_match(*x)) if out is None else out


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str | None]]:
    """Numbers of the distinct texts of a column, and these; null is the last."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), [*coded.dictionary.to_pylist(), None]


def _numbered(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Each text's place among the distinct ones, and these in order."""
    distinct = sorted(set(texts))
    place = {t: i for i, t in enumerate(distinct)}
    return np.array([place[t] for t in texts]), distinct


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter, digit and blank stands in each text's distinct words, put together by blanks; and their lengths."""
    plain = [" ".join(set(t.split(" "))).encode() for t in texts]
    sizes = np.array([len(p) for p in plain])
    at = np.repeat(np.arange(len(plain)), sizes) * 37 + LETTER[np.frombuffer(b"".join(plain), np.uint8)]
    counts = np.bincount(at, minlength=37 * len(plain)).reshape(-1, 37)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32), sizes


def _likest(one: np.ndarray, doc: np.ndarray, first_doc: np.ndarray, other: np.ndarray, order: np.ndarray, texts: list[str], known: _Known) -> np.ndarray:
    """For each name (text ``one`` in ``doc``) the place of the likest of its document's names from LEAST on, or -1. ``order``: which of equally like ones comes first.

    Letters in common bound a ratio from above, so most pairs are told without comparing them; the others are compared once each. Pairs are taken some PAIRS at a time.
    """
    out = np.full(len(one), -1)
    low, high = np.searchsorted(first_doc, doc), np.searchsorted(first_doc, doc, "right")
    ends = np.cumsum(high - low)
    letters, sizes = _letters(texts)
    begin = 0
    while begin < len(one):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        counts = (high - low)[begin:end]
        which = np.repeat(np.arange(begin, end), counts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - low[begin:end], counts)
        a, b = one[which], other[at]
        shared = np.minimum(letters[a], letters[b]).sum(1, dtype=np.int64)
        near = np.flatnonzero(2 * shared >= LEAST * (np.minimum(sizes[a], sizes[b]) + shared) - 1e-6)
        pairs, back = np.unique(a[near] * len(texts) + b[near], return_inverse=True)
        ratios = np.array([known.ratio(texts[p // len(texts)], texts[p % len(texts)]) for p in pairs.tolist()])[back] if len(pairs) else np.zeros(0)
        best = np.flatnonzero(ratios >= LEAST)
        which, at, ratios = which[near[best]], at[near[best]], ratios[best]
        best = np.lexsort((order[at], -ratios, which))
        which, first = np.unique(which[best], return_index=True)
        out[which] = at[best][first]
        begin = end
    return out


def _matched(block: pa.Table, known: _Known) -> dict[str, np.ndarray]:
    """Matches of the whole documents of a block (doc, predicted, n, name, value, unit).

    starts: of the documents. doc, row: document and row of each expected row with a name. hit: the row of the predicted one that stands for the name it takes, or -1.
    loose: documents of the predicted rows whose name none took.
    """
    known.forget()
    starts = group_starts(block.column("doc"))
    doc = np.repeat(np.arange(len(starts)), np.diff(starts, append=block.num_rows))
    n = block.column("n").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
    code, names = _coded(block.column("name"))
    told = [known.name(x) for x in names]
    key, keys = _numbered([t[0] for t in told])
    text, texts = _numbered([t[1] for t in told])
    key, text = key[code], text[code]
    named = key != keys.index("") if "" in keys else np.ones(len(key), bool)
    named &= block.column("doc").is_valid().to_numpy()
    predicted = block.column("predicted").to_numpy()
    left, right = np.flatnonzero(named & ~predicted), np.flatnonzero(named & predicted)
    both = doc * len(keys) + key
    right = right[np.lexsort((n[right], both[right]))]
    first = right[np.unique(both[right], return_index=True)[1]]
    at = np.searchsorted(both[first], both[left])
    hit = np.where(np.append(both[first], -1)[at] == both[left], np.append(first, -1)[at], -1)
    rest = np.flatnonzero(hit < 0)
    asked, back = np.unique(doc[left[rest]] * len(texts) + text[left[rest]], return_inverse=True)
    order = np.empty(len(first), np.int64)
    order[np.lexsort((key[first], n[first]))] = np.arange(len(first))
    best = _likest(asked % len(texts), asked // len(texts), doc[first], text[first], order, texts, known)[back]
    hit[rest] = np.where(best < 0, -1, np.append(first, -1)[best])
    loose = doc[right[~np.isin(both[right], both[hit[hit >= 0]])]]
    return {"starts": starts, "doc": doc[left], "row": left, "hit": hit, "loose": loose}


def _agree(one: np.ndarray, two: np.ndarray, texts: list[str | None], ask) -> np.ndarray:
    """``ask`` of each pair of texts, each distinct one once."""
    pairs, back = np.unique(one * len(texts) + two, return_inverse=True)
    return np.array([ask(texts[p // len(texts)], texts[p % len(texts)]) for p in pairs.tolist()], bool)[back]


def _count_block(block: pa.Table, known: _Known) -> pa.Table:
    m = _matched(block, known)
    taken = m["hit"] >= 0
    one, two = m["row"][taken], m["hit"][taken]
    right = np.zeros(len(taken), bool)
    (value, values), (unit, units) = _coded(block.column("value")), _coded(block.column("unit"))
    right[taken] = _agree(value[one], value[two], values, known.value_ok) & _agree(unit[one], unit[two], units, known.unit_ok)
    count = lambda docs: np.bincount(docs, minlength=len(m["starts"]))
    correct, wrong = count(m["doc"][right]), count(m["doc"][taken & ~right])
    return pa.table([block.column("doc").take(pa.array(m["starts"])), count(m["doc"]), correct, correct, wrong + count(m["loose"]), wrong + count(m["doc"][~taken])], ["doc", "expected", "correct", "tp", "fp", "fn"])


def _match_block(block: pa.Table, known: _Known) -> pa.Table:
    m = _matched(block, known)
    keys = [known.name(block.column("name")[int(i)].as_py())[0] if i >= 0 else None for i in m["hit"]]
    rows = pa.array(m["row"])
    return pa.table([block.column("doc").take(rows), block.column("n").take(rows), pa.array(keys, pa.string())], ["doc", "n", "key"])


def _in_blocks(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for block in whole_groups(batches, "doc", BLOCK):
            yield from f(block, known).to_batches(max_chunksize=BATCH)

    return run


def _dealt(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows of both frames as ROW, the documents dealt out once."""
    rows = lambda frame, kind: frame.select("doc", F.lit(kind).alias("predicted"), F.col("n").cast("long").alias("n"), "name", *(F.col(c) if c in frame.columns else F.lit(None).cast("string").alias(c) for c in ("value", "unit")))
    return rows(expected, False).unionByName(rows(predicted, True)).repartition("doc").sortWithinPartitions("doc")


def matched_rows(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc, n, key (of the predicted name that the row takes, or null) of each expected row with a name; both frames have doc, n (order in the document) and name."""
    rows = _dealt(expected, predicted)
    return rows.mapInArrow(_in_blocks(_match_block), f"doc {rows.schema['doc'].dataType.simpleString()}, n long, key string")


def row_counters(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc, expected, correct, tp, fp, fn of each document of either frame (doc, n, name, value, unit).

    A matched row is right if its value agrees, and its unit where one is expected; a wrong one is both a false positive and a false negative. Predicted rows whose name no expected row took
    are false positives, each of them.
    """
    return counters(_dealt(expected, predicted))


def counters(rows: DataFrame) -> DataFrame:
    """The same of rows (doc, predicted, n, name, value, unit) of which a document's lie in one partition, one after another."""
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_in_blocks(_count_block), f"doc {kind}, expected long, correct long, tp long, fp long, fn long")


# Fixture: an order's items as laboratory rows, and readings of them with spoiled names, values and units.
def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Expected and predicted rows; lines are dealt out by order once they have their names."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"))
    rows = rows.join(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").repartition("l_orderkey")
    n = (F.col("l_linenumber").cast("long") * 10**6 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    value, unit = F.col("quantity").cast("string"), F.when(F.col("l_suppkey") % 3 > 0, "g/l")
    rows = rows.groupBy(F.col("l_orderkey").alias("doc"), n.alias("n")).agg(F.min(F.struct(name.alias("name"), value.alias("value"), unit.alias("unit"), "l_partkey", "l_suppkey")).alias("r")).select("doc", "n", "r.*").sortWithinPartitions("doc")
    kind = F.col("l_partkey") % 7
    spoiled = (
        F.when(kind == 0, F.upper("name")).when(kind == 1, F.regexp_replace("name", r"^(\S+) (.*)$", "$2 $1")).when(kind == 2, F.regexp_replace("name", "e", "é")).when(kind == 3, F.concat(F.substring("name", 1, 3), F.expr("substr(name, 5)")))
        .when(kind == 4, F.lit(" - ")).otherwise(F.col("name"))
    )
    got = F.when(F.col("l_suppkey") % 5 == 0, F.concat("value", F.lit(",004 mg"))).when(F.col("l_suppkey") % 5 == 1, F.concat(F.lit("1"), "value")).otherwise(F.col("value"))
    row = lambda predicted, name, value, unit: F.struct(F.lit(predicted).alias("predicted"), name.alias("name"), value.alias("value"), unit.alias("unit"))
    read = F.when(F.col("l_partkey") % 11 > 0, row(True, spoiled, got, F.when(F.col("l_suppkey") % 4 > 0, "G / L")))
    return rows.select("doc", "n", F.explode(F.array(row(False, F.col("name"), F.col("value"), F.col("unit")), read)).alias("r")).where("r is not null").select("doc", "r.predicted", "n", "r.name", "r.value", "r.unit")


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counters of all orders whose items were read again with faults."""
    return counters(_rows(spark, d))


def eval_row_rates(spark: SparkSession, d: str) -> DataFrame:
    """The counters and rates of all orders by status, and of all of them (status null)."""
    counts = eval_rows(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("status")), "doc")
    long = lambda c, name: c.cast("long").alias(name)
    counts = counts.select(
        "status", long(F.lit(1), "documents"), long(F.col("tp") + F.col("fp") > 0, "predicted_documents"), long(F.col("tp") + F.col("fp") > 0, "valid_json"), long(F.lit(0), "classification_expected"), long(F.lit(0), "classification_correct"),
        "tp", "fp", "fn", F.col("expected").alias("field_expected"), F.col("correct").alias("field_correct"),
    )
    return all_rates(counts.rollup("status").agg(*(F.sum(c).alias(c) for c in counts.columns[1:])))


QUERIES = {f.__name__: f for f in (eval_rows, eval_row_rates)}
_NAME = "regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^a-z0-9]+', '{}', 'g')"
_BLANK = "lower(trim(coalesce({}, ''))) IN ({})".format("{}", ", ".join(f"'{x}'" for x in EMPTY_VALUES))
_NUMBER = "CAST(replace(regexp_extract_all(regexp_replace({}, '\\s', '', 'g'), '[0-9]+(?:[,.][0-9]+)?')[-1], ',', '.') AS DOUBLE)"
_COUNTERS_SQL = f"""
e AS MATERIALIZED (
  SELECT doc, n, r.name AS name, r.value AS value, r.unit AS unit, r.pk AS pk, r.sk AS sk FROM (
    SELECT l_orderkey AS doc, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS n,
      min(struct_pack(name := p_name || ' ' || lower(p_type), value := CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR), unit := CASE WHEN l_suppkey % 3 > 0 THEN 'g/l' END, pk := l_partkey, sk := l_suppkey)) AS r
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
), p AS MATERIALIZED (
  SELECT doc, n, CASE pk % 7 WHEN 0 THEN upper(name) WHEN 1 THEN regexp_replace(name, '^(\\S+) (.*)$', '\\2 \\1') WHEN 2 THEN replace(name, 'e', 'é') WHEN 3 THEN name[1:3] || name[5:] WHEN 4 THEN ' - ' ELSE name END AS name,
    CASE sk % 5 WHEN 0 THEN value || ',004 mg' WHEN 1 THEN '1' || value ELSE value END AS value, CASE WHEN sk % 4 > 0 THEN 'G / L' END AS unit FROM e WHERE pk % 11 > 0
), ek AS (SELECT *, {_NAME.format('')} AS k, trim({_NAME.format(' ')}) AS a FROM e),
pk AS (SELECT *, {_NAME.format('')} AS k, trim({_NAME.format(' ')}) AS b FROM p WHERE {_NAME.format('')} <> ''),
pf AS MATERIALIZED (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY doc, k ORDER BY n) = 1),
op AS MATERIALIZED (SELECT ek.doc, ek.n, ek.a, pf.b, pf.k, pf.n AS m FROM ek JOIN pf ON pf.doc = ek.doc WHERE NOT EXISTS (SELECT 1 FROM pf x WHERE x.doc = ek.doc AND x.k = ek.k)),
{ratio_sql('op')},
nr AS (SELECT op.doc, op.n, op.k FROM op LEFT JOIN tsr USING (a, b) WHERE CASE WHEN a = b THEN 1 ELSE ratio END >= 0.90 QUALIFY row_number() OVER (PARTITION BY op.doc, op.n ORDER BY CASE WHEN a = b THEN 1 ELSE ratio END DESC, m) = 1),
mt AS (SELECT ek.doc, ek.n, ek.value AS want, ek.unit AS want_unit, coalesce(x.k, nr.k) AS k FROM ek LEFT JOIN pf x ON x.doc = ek.doc AND x.k = ek.k LEFT JOIN nr ON nr.doc = ek.doc AND nr.n = ek.n),
ok AS (
  SELECT mt.doc, mt.k, mt.k IS NOT NULL AND abs({_NUMBER.format('want')} - {_NUMBER.format('pf.value')}) <= 0.01
    AND ({_BLANK.format('want_unit')} OR coalesce(NOT {_BLANK.format('pf.unit')} AND regexp_replace(lower(want_unit), '[^a-z0-9]', '', 'g') = regexp_replace(lower(pf.unit), '[^a-z0-9]', '', 'g'), false)) AS good
  FROM mt LEFT JOIN pf ON pf.doc = mt.doc AND pf.k = mt.k
), c AS (SELECT doc, count(*) AS expected, count(*) FILTER (WHERE good) AS correct, count(*) FILTER (WHERE k IS NOT NULL AND NOT good) AS wrong, count(*) FILTER (WHERE k IS NULL) AS missed FROM ok GROUP BY doc),
l AS (SELECT doc, count(*) AS loose FROM pk WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc = pk.doc AND ok.k = pk.k) GROUP BY doc),
rc AS (SELECT doc, expected, correct, correct AS tp, wrong + coalesce(loose, 0) AS fp, wrong + missed AS fn FROM c LEFT JOIN l USING (doc))"""
_rate = lambda a, b: f"coalesce(round({a}::DOUBLE / nullif({b}, 0), 4), 0.0)"
ORACLES = {
    "eval_rows": f"WITH RECURSIVE {_COUNTERS_SQL} SELECT doc, expected, correct, tp, fp, fn FROM rc",
    "eval_row_rates": f"""WITH RECURSIVE {_COUNTERS_SQL},
s AS (
  SELECT o_orderstatus AS status, count(*) AS documents, count(*) FILTER (WHERE tp + fp > 0) AS predicted_documents, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    CAST(sum(expected) AS BIGINT) AS field_expected, CAST(sum(correct) AS BIGINT) AS field_correct FROM rc JOIN orders ON o_orderkey = doc GROUP BY ROLLUP (o_orderstatus)
)
SELECT status, documents, predicted_documents, predicted_documents AS valid_json, 0::BIGINT AS classification_expected, 0::BIGINT AS classification_correct, tp, fp, fn, field_expected, field_correct,
  {_rate('predicted_documents', 'documents')} AS coverage, {_rate('predicted_documents', 'predicted_documents')} AS valid_json_rate, 0.0::DOUBLE AS classification_accuracy, {_rate('field_correct', 'field_expected')} AS field_accuracy,
  {_rate('tp', 'tp + fp')} AS precision, {_rate('tp', 'tp + fn')} AS recall, {_rate('2 * tp', '2 * tp + fp + fn')} AS f1 FROM s""",
}
