"""Quality rules: lines that too many documents of a host share go, and documents left with little are rejected.

Lines are normalised (A-Z lower-cased, digits alike, white space runs alike) and hashed. For each
host the distinct documents of a line are counted: copies too, but rows that repeat id, host and text only once. A line in over LINE_DOCS documents is removed, whatever the size of the host, from all of
them but the first (least doc_id, nulls last, then text hash; rows that repeat it count as the same), so that one copy of what is repeated
stays. A document is rejected if it fails a base rule or if less than MIN_LEFT of its words are left.

A null text is empty: it has no words and fails. A null host is a host like others. A null id is a row like
others. Repeated rows stay repeated, other columns are ignored, an empty table gives no rows. A very long text is measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import _BYTE, _FOLDED, blocks, mix, powers, returns_memory
from .workspace import Classes, Lookup, Workspace, unused

#: A line is removed where it is in over LINE_DOCS documents of a host.
LINE_DOCS = 20
#: Up to so many common lines are known to all tasks (16 bytes each); if there are more, rows to be cut are joined with their lines.
COMMON_LIMIT = 1 << 20
MIN_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEATED = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCHEMA = "row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur two times or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k):
        equal = k[1:] == k[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


@returns_memory
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch["text"]):
            yield _block(block, batch["row"].slice(block.first, len(block)))


def _lines(block, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lines with a word: their first and last word, the text they are of, their number in the block and their normalised hash; also where lines end."""
    ends_of_lines = np.flatnonzero(block.data == 10)
    line_of_word = np.searchsorted(ends_of_lines, starts)
    first = np.flatnonzero(np.concatenate([[True], (line_of_word[1:] != line_of_word[:-1]) | (text[1:] != text[:-1])])) if len(starts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    # a polynomial over their words' hashes
    folded = block.hashes(starts, ends, _FOLDED)
    p, inverse = powers(len(folded))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * p[: len(folded)], dtype=np.uint64)])
    hashes = mix((total[last + 1] - total[first]) * inverse[first] + (last + 1 - first).astype(np.uint64)).view(np.int64)
    return first, last, text[first], line_of_word[first], ends_of_lines, hashes


def _block(block, row) -> pa.RecordBatch:
    starts, ends, before = block.words()
    n = np.diff(before)
    text = np.repeat(np.arange(len(block)), n)
    exact = block.hashes(starts, ends, _BYTE)
    inner = np.zeros(len(block.data) + 1, np.int64)  # characters, white space left out: bytes that don't continue one
    np.cumsum((block.data & 0xC0) != 0x80, out=inner[1:])
    chars = inner[ends] - inner[starts]

    # three-word windows
    repeated = np.zeros(len(starts) + 2, bool)
    if len(starts) >= 3:
        whole = text[:-2] == text[2:]
        at = np.flatnonzero(whole)
        keys = mix(exact[at] + exact[at + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(exact[at + 2]) * np.uint64(3) + mix(text[at].astype(np.uint64) + np.uint64(99)) * np.uint64(5))
        at = at[_twice(keys)]
        for k in range(3):
            repeated[at + k] = True

    first, last, line_text, k, ends_of_lines, lines = _lines(block, starts, ends, text)
    begin = np.maximum(np.where(k > 0, ends_of_lines[np.maximum(k - 1, 0)] + 1 if len(ends_of_lines) else 0, 0), block.bounds[line_text])
    close = np.where(k < len(ends_of_lines), ends_of_lines[np.minimum(k, max(len(ends_of_lines) - 1, 0))] if len(ends_of_lines) else len(block.data), len(block.data))
    close = np.minimum(close, block.bounds[line_text + 1])
    plain = block.hashes(begin, close, _BYTE)
    keys = mix(plain ^ mix(line_text.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    if len(keys):
        again[order[1:]] = keys[order][1:] == keys[order][:-1]
    bounds = np.searchsorted(line_text, np.arange(len(block) + 1)).astype(np.int32)

    return pa.record_batch(
        [
            row, pa.array(n.astype(np.int64)), pa.array(_per_word(chars, before)), pa.array(_per_text(_SYMBOL[block.data], block.bounds)),
            pa.array(_per_text(again, bounds)), pa.array(_per_word(repeated[: len(starts)].astype(np.int64), before)),
            pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(lines), pa.array((last + 1 - first).astype(np.int32))], ["line", "words"])),
        ],
        ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
    )


def _per_word(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[before[1:]] - total[before[:-1]]


def _without(column: pa.Array, gone: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[str | None]:
    """The texts without the lines that are ``gone`` (of the number of each line's text and its hash); None for those that have none."""
    out = []
    for block in blocks(column):
        starts, ends, before = block.words()
        text = np.repeat(np.arange(len(block)), np.diff(before))
        _, _, line_text, k, ends_of_lines, hashes = _lines(block, starts, ends, text)
        bounds = np.searchsorted(line_text, np.arange(len(block) + 1))
        number = k - np.searchsorted(ends_of_lines, block.bounds[line_text])
        cut = gone(line_text + block.first, hashes)
        for i in range(len(block)):
            mine = slice(bounds[i], bounds[i + 1])
            if cut[mine].any():
                lines = set(number[mine][cut[mine]].tolist())
                out.append("\n".join(x for j, x in enumerate(column[block.first + i].as_py().split("\n")) if j not in lines))
            else:
                out.append(None)
    return out


def _cleaned(batch: pa.RecordBatch, some: pa.Array, gone: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The batch without the lines that are ``gone`` of ``some`` rows' texts, and n_chars to match."""
    column = batch["text"]
    new = pa.array(_without(column.filter(some), gone), column.type)
    at = some.to_numpy(zero_copy_only=False).copy()
    at[at] = new.is_valid().to_numpy(zero_copy_only=False)
    at, new = pa.array(at), new.drop_null()
    changed = {"text": pc.replace_with_mask(column, at, new)}
    if "n_chars" in batch.schema.names:
        changed["n_chars"] = pc.replace_with_mask(batch["n_chars"], at, pc.utf8_length(new).cast(batch["n_chars"].type))
    return pa.record_batch([changed.get(n, batch[n]) for n in batch.schema.names], batch.schema.names)


def _without_listed(name: str):
    """Cuts the lines whose hashes a row lists."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped = batch[name]
            batch, some = batch.drop_columns([name]), pc.is_valid(dropped)
            lists = [np.array(x, np.int64) for x in dropped.filter(some).to_pylist()]

            def gone(text: np.ndarray, lines: np.ndarray, lists=lists) -> np.ndarray:
                bounds = np.searchsorted(text, np.arange(len(lists) + 1))
                return np.concatenate([np.isin(lines[x:y], own) for x, y, own in zip(bounds[:-1], bounds[1:], lists, strict=True)] or [np.zeros(0, bool)])

            yield _cleaned(batch, some, gone) if some.true_count else batch

    return run


def _code(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(host.view(np.uint64)) + line.view(np.uint64))


def _without_common(common, host: str, key: str):
    """Cuts the lines that are common at a row's host; ``common``: their codes, sorted, and the keys of the documents that keep them."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, firsts = common.value
        for batch in batches:
            hosts, keys = batch[host].to_numpy(), batch[key].to_numpy()

            def gone(text: np.ndarray, lines: np.ndarray, hosts=hosts, keys=keys) -> np.ndarray:
                code = _code(hosts[text], lines)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                return (codes[at] == code) & (firsts[at] != keys[text])

            batch = batch.drop_columns([host, key])
            yield _cleaned(batch, pa.array(np.ones(len(batch), bool)), gone) if len(batch) and len(codes) else batch

    return run


def _key(doc_id, host, same):
    """What documents of a host are told apart by: repeated rows have the same."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), F.coalesce(host, F.lit("")), host.isNull(), same)


def line_rules(docs: DataFrame, work: Workspace | None = None, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, n_words_left, dropped (hashes of the lines that go), row, host and key (the same for repeated rows) for each row of ``docs`` (doc_id, text and ``host``)."""
    return _judged(docs, work or Workspace(docs.sparkSession, "lines"), host)[0]


def _judged(docs: DataFrame, work: Workspace, host: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``line_rules``, and the common lines (host, line and the key of the document that keeps it)."""
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one pass over the texts: the id columns ride along as one packed column
    ids = ids.withColumn("key", _key(F.col("doc_id"), F.col("host"), F.xxhash64("text")))
    measured = ids.select(F.struct("row", "doc_id", "host", "key").alias("row"), "text").mapInArrow(_measure, _SCHEMA.replace("row long", "row struct<row:long,doc_id:long,host:string,key:long>", 1))
    measured = work.save(measured.select("row.*", *[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines")]), "measured")

    lines = measured.select("row", "doc_id", "host", "key", F.explode("lines").alias("l")).select("row", "doc_id", "host", "key", "l.line", "l.words")
    # a document counts a line once: repeats within it and rows that repeat it are gone before lines are counted
    again = work.save(measured.groupBy("key").agg(F.count("*").alias("k"), F.min("row").alias("one")).where(F.col("k") > 1).select("key", "one"), "again")
    doubtful, single = Lookup(again.select("key")).split(measured, F.col("key"))
    firsts = doubtful.join(again, "key", "left").where(F.coalesce(F.col("one") == F.col("row"), F.lit(True))).select(*measured.columns)
    once = single.unionByName(firsts).select("doc_id", "host", "key", F.explode(F.array_distinct("lines.line")).alias("line"))
    common = once.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).where(F.col("docs") > LINE_DOCS)
    common = work.save(common.select("host", "line", F.col("first.key").alias("first")), "common")
    removed = (
        lines.alias("l").join(common.alias("c"), (F.col("l.line") == F.col("c.line")) & F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.key") != F.col("c.first")))
        .groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("l.line").alias("dropped"))
    )
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = (
        measured.drop("lines").join(removed, "row", "left")
        .withColumns({"n_words_left": left, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= MIN_LEFT * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", "dropped", "row", "host", "key")
    )
    return judged, common


def without_rejected(docs: DataFrame, work: Workspace | None = None, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, common lines cut out of their texts and n_chars, if there, to match.

    What is cut are the lines that n_words_left leaves out. Where all tasks can know the common lines, only rows whose key alone does not tell whether they stay are
    shuffled, else those to be cut too. All columns stay, whatever their names.
    """
    work = work or Workspace(docs.sparkSession, "lines")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    key, kept, dropped, kind, at = (unused(docs.columns, c) for c in ("_rule_key", "_rule_kept", "_rule_dropped", "_rule_kind", "_rule_host"))
    judged, common = _judged(docs, work, host)
    known = common.count() <= COMMON_LIMIT
    verdicts = judged.groupBy(F.col("key").alias(key)).agg(F.first("kept").alias(kept), F.first(F.col("dropped").isNotNull()).alias(at), F.first(F.lit(None) if known else F.array_sort("dropped")).cast("array<long>").alias(dropped))  # repeated rows have the same
    verdicts = work.save(verdicts, "verdicts")
    # 0: stays as it is, 1: goes, 2: may be cut
    told = Classes(verdicts.select(key, F.when(~F.col(kept), 1).when(F.col(at), 2).otherwise(0)), 3).told(docs.withColumn(key, _key(F.col("doc_id").cast("long"), F.col(host).cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))))), F.col(key), kind)
    whole, cut, doubtful = told.where(F.col(kind) == 0).select(*docs.columns), told.where(F.col(kind) == 2), told.where(F.col(kind) == -1)
    good = verdicts.where(kept)
    if not known:
        cut = cut.unionByName(doubtful).join(good.select(key, dropped), key)
        return whole.unionByName(cut.select(*docs.columns, dropped).mapInArrow(_without_listed(dropped), docs.schema))
    lines = common.select(F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull()).alias("host"), "line", "first").toArrow()  # at most COMMON_LIMIT
    codes = _code(lines["host"].to_numpy(), lines["line"].to_numpy())
    order = np.argsort(codes)
    shared = docs.sparkSession.sparkContext.broadcast((codes[order], lines["first"].to_numpy()[order]))
    cut = cut.unionByName(doubtful.join(good.select(key), key, "left_semi")).withColumn(at, F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")), F.col(host).isNull()))
    return whole.unionByName(cut.select(*docs.columns, at, key).mapInArrow(_without_common(shared, at, key), docs.schema))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("dropped", "row", "host", "key")


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), t AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS o FROM t WHERE c > 1) GROUP BY r),
ln AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM w),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ln),
lx AS (SELECT r, doc_id, host, text, line, len(ws) AS words, regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm FROM lw WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lx GROUP BY r),
bad AS (SELECT host, norm, min(doc_id) AS first FROM lx GROUP BY host, norm HAVING count(DISTINCT hash(doc_id, text)) > 20),
rm AS (SELECT lx.r, sum(lx.words) AS n FROM lx JOIN bad ON lx.norm = bad.norm AND lx.host IS NOT DISTINCT FROM bad.host AND lx.doc_id IS DISTINCT FROM bad.first GROUP BY lx.r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(rm.n, 0) AS BIGINT) AS n_words_left
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rm USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 0.3 * n_words AS kept, n_words_left FROM m
"""
