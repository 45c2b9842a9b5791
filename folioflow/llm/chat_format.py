"""Chat formatting: conversations become training text with a loss mask, assembled column by column.

Template: each turn is ``### <role>: <text></turn>`` and a line feed. Inside roles and texts a backslash is
put before every backslash, before ``#`` after ``#``, before ``/`` after ``<``, and in roles before ``:``. So no text holds a
control string, and dropping each backslash (keeping what follows it) gives the text back. The loss mask covers the texts of
assistant turns, without their closing marks.

Turns are shuffled by conversation, sorted by (turn, role, text) and formatted batch by
batch. A batch's output is one preallocated byte buffer: segment lengths give cumulative offsets, and headers,
contents and marks are scattered into it by index arrays. A conversation that goes on over a batch's end
gives several pieces, in order, so that no conversation has to fit in memory.

A null role or text counts as empty. A null turn comes first. Rows with a null conv_id make one
conversation with a null id. Repeated rows are repeated turns. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import returns_memory, strings

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
LEARNED = b"assistant"
PIECES = "conv_id long, piece int, text string, loss_starts array<int>, loss_ends array<int>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
EXAMPLE = (-7, r"\### Assistant: </turn> ok")


def _escapes(data: np.ndarray, bounds: np.ndarray, role: bool) -> np.ndarray:
    """Which bytes get a backslash before them."""
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    before[first] = 0
    out = (data == 0x5C) | ((data == 0x23) & (before == 0x23)) | ((data == 0x2F) & (before == 0x3C))
    return out | (data == 0x3A) if role else out


def _scatter(out: np.ndarray, data: np.ndarray, bounds: np.ndarray, escaped: np.ndarray, at: np.ndarray) -> None:
    """Copies every segment of ``data`` to ``out`` from ``at`` on, with its backslashes."""
    shift = np.cumsum(escaped, dtype=np.int64)
    base = np.concatenate([[0], shift])[bounds[:-1]]
    n = np.diff(bounds)
    index = np.arange(len(data)) + np.repeat(at - bounds[:-1] - base, n) + shift
    out[index] = data
    out[index[escaped] - 1] = 0x5C


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns, the bounds of the turns, and the bounds of their escaped texts."""
    (r, rb), (t, tb) = strings(roles), strings(texts)
    re_, te = _escapes(r, rb, True), _escapes(t, tb, False)
    extra = lambda e, b: np.diff(np.concatenate([[0], np.cumsum(e, dtype=np.int64)])[b])
    role_size, text_size = np.diff(rb) + extra(re_, rb), np.diff(tb) + extra(te, tb)
    bounds = np.concatenate([[0], np.cumsum(role_size + text_size + len(OPEN) + len(MIDDLE) + len(CLOSE))])
    out = np.empty(bounds[-1], np.uint8)
    role_at = bounds[:-1] + len(OPEN)
    text_at = role_at + role_size + len(MIDDLE)
    for mark, at in ((OPEN, bounds[:-1]), (MIDDLE, role_at + role_size), (CLOSE, text_at + text_size)):
        for k, byte in enumerate(mark):
            out[at + k] = byte
    _scatter(out, r, rb, re_, role_at)
    _scatter(out, t, tb, te, text_at)
    return out, bounds, text_at, text_at + text_size


@returns_memory
def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted pieces of conversations; spans of the loss mask are in bytes from the piece's start."""
    last, piece = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        out, bounds, begin, end = assemble(batch["role"], batch["text"])
        ids = batch["conv_id"]
        values, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (null[1:] != null[:-1])]))
        pieces = np.zeros(len(starts), np.int32)
        if ids[0].as_py() == last:
            pieces[0] = piece + 1
        last, piece = ids[len(ids) - 1].as_py(), int(pieces[-1])
        edges = np.append(starts, len(ids))
        text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds[edges].astype(np.int32)), pa.py_buffer(out))
        learned = np.array([x == "assistant" for x in batch["role"].to_pylist()], bool)
        origin = np.repeat(bounds[starts], np.diff(edges))
        spans = np.concatenate([[0], np.cumsum(learned)])[edges].astype(np.int32)
        lists = [pa.ListArray.from_arrays(spans, (x - origin)[learned].astype(np.int32)) for x in (begin, end)]
        yield pa.record_batch([ids.take(pa.array(starts)), pa.array(pieces), text, *lists], ["conv_id", "piece", "text", "loss_starts", "loss_ends"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, piece, text and loss spans (bytes). A conversation's pieces are in one partition, in order."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))]
    sorted_rows = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(_format, PIECES)


_TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)


class _Reader:
    """Reads one conversation's pieces back."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        data, at = text.encode(), 0
        self.chars += len(text)
        while at < len(data):
            m = _TURN.match(data, at)
            if m is None:
                raise ValueError(f"conversation {self.conv_id}: no turn at byte {at}")
            for part in m.groups():
                self.all.update(_ESCAPE.sub(rb"\1", part) + b"\n")
            self.turns, at = self.turns + 1, m.end()
        for a, b in zip(starts, ends, strict=True):
            plain = _ESCAPE.sub(rb"\1", data[a:b])
            self.loss.update(plain)
            self.loss_chars += len(plain.decode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


@returns_memory
def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if x["piece"] == 0:
                if now is not None:
                    done.append(now.row())
                now = _Reader(x["conv_id"])
            now.add(x["text"], x["loss_starts"], x["loss_ends"])
        yield pa.record_batch([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
    if now is not None:
        yield pa.record_batch([pa.array([now.row()[k]], t) for k, t in enumerate(types)], names)


def read_back(pieces: DataFrame) -> DataFrame:
    """DIGEST of each conversation, from its formatted pieces as format_conversations leaves them."""
    return pieces.mapInArrow(_read_back, DIGEST)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXAMPLE[0], 0, "user", EXAMPLE[1]), (EXAMPLE[0], 1, "assistant", EXAMPLE[1])], "conv_id long, turn int, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, role || chr(10) || text || chr(10) AS block,
    length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+'))) + (length(text) - length(replace(text, '</', '<')))
    + length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, ':', ''))) + (length(role) - length(replace(role, '#', '')) - len(regexp_extract_all(role, '#+'))) + (length(role) - length(replace(role, '</', '<'))) + 14 AS chars
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(block, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
