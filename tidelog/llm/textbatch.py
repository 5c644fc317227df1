"""Arrow string columns as flat numpy byte buffers, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled by one numpy step. A longer single text is handled whole, alone.
PIECE_BYTES = 2 << 20


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of len+1, is-null mask) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], null


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut by rows so that `column` holds about `limit` bytes in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets, _ = flat_text(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def spans(batches: Iterator[pa.RecordBatch], limit: int, column: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together, or cut by rows, so that the text of `column` has about `limit` bytes in each; a longer text stands alone."""
    held, size = [], 0

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets, _ = flat_text(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit - size, side="right")) - 1
            if end <= start and held:
                yield whole()
                held, size = [], 0
                continue
            end = min(max(end, start + 1), batch.num_rows)
            held.append(batch.slice(start, end - start))
            size += int(offsets[end] - offsets[start])
            start = end
    if held:
        yield whole()


def ragged_range(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; an empty segment gives 0."""
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def list_array(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
