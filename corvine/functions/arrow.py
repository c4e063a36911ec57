"""Arrow arrays of texts and vectors as numpy arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each starts and the last ends."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def ranges(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The whole numbers of all [a, z), one range after the other."""
    size = z - a
    return np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())


def matrix(vectors: pa.Array) -> np.ndarray:
    """An array of lists of one length, none null, a line each."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def lists(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The lines of a matrix as lists, null where ``missing``."""
    keep = np.ones(len(rows), bool) if missing is None else ~missing
    off = np.append(0, np.cumsum(keep * rows.shape[1])).astype(np.int32)
    bits = None if missing is None else pa.py_buffer(np.packbits(keep, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.list_(pa.float64()), len(rows), [bits, pa.py_buffer(off)], children=[pa.array(rows[keep].reshape(-1))])


def spread(values: np.ndarray | pa.Array, at: pa.Array) -> pa.Array:
    """The values in the places where ``at`` is true, null elsewhere."""
    k = np.cumsum(at.to_numpy(zero_copy_only=False)) - 1
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return values.take(pa.array(k, mask=~at.to_numpy(zero_copy_only=False)))
