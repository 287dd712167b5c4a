"""Numpy helpers for columns of variable-length byte strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    used = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]
    return used, starts - starts[0]


def span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def strings_from_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string column of the byte spans [start, end) of ``data``."""
    lengths = np.maximum(ends - starts, 0)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    taken = np.ascontiguousarray(data[span_index(starts, lengths)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(taken))
