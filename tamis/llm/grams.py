"""Hashed byte n-grams of whole Arrow batches, without a Python loop over grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000):
    """Slices of the batch with about most_bytes of text each, one row at least."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def hashed(texts: pa.Array, width: int = WIDTH, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all grams, first gram of each row and the end): a text of n bytes has max(0, n - width + 1) grams."""
    raw = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    count = np.maximum(size - width + 1, 0)
    first = np.r_[0, np.cumsum(count)]
    data = np.frombuffer(b"".join([*raw, b"\0" * 8]), np.uint8)
    grams = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) & np.uint64((1 << 8 * width) - 1)
    buckets = ((grams * _MIX) >> np.uint64(64 - bits)).astype(np.int32)
    skip = np.repeat(np.cumsum(size - count) - (size - count), count)
    return buckets[np.arange(first[-1]) + skip], first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]
