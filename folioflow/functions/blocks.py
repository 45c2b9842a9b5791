"""Rows that lie group by group, taken as Arrow blocks of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal keys begins; nulls equal each other."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    one, two = keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))
    changed = pc.coalesce(pc.not_equal(one, two), pc.not_equal(pc.is_null(one), pc.is_null(two)))
    return np.flatnonzero(np.append(len(keys) > 0, changed.to_numpy(zero_copy_only=False)))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """The rows in tables of some ``rows``, cut only where ``key`` changes. A group larger than that is a table of its own size."""
    held: list[pa.RecordBatch] = []
    size, most = 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        block = pa.Table.from_batches(held)
        last = int(group_starts(block.column(key))[-1])
        if last == 0:  # one group so far
            most *= 2
            continue
        yield block.slice(0, last)
        held = block.slice(last).combine_chunks().to_batches()
        size, most = size - last, rows
    if size:
        yield pa.Table.from_batches(held)
