"""Numeric helpers that run inside Arrow tasks on one batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows of one batch multiplied at once, which bounds the temporary matrices (2 MB, so that they stay in the cache).
SLICE_ROWS = 512


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as an (n, d) matrix; every row must hold d values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("vector column holds nulls")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vectors hold null entries")
    lengths = np.diff(np.asarray(column.offsets))
    if lengths.min() != lengths.max():
        raise ValueError("vectors have different lengths")
    return np.asarray(flat, dtype=np.float64).reshape(n, int(lengths[0]))


def vector_array(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d) if d else np.zeros(n + 1), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), type=pa.float64()))


def packed_array(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as one binary value."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * (rows.shape[1] * rows.itemsize)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)]
    return pa.Array.from_buffers(pa.binary(), len(rows), buffers)


def packed(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """The (n, d) matrix of ``packed_array``, read only."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([packed(c, kind) for c in column.chunks]) if column.num_chunks else np.zeros((0, 0), kind)
    n, size = len(column), np.dtype(kind).itemsize
    if n == 0:
        return np.zeros((0, 0), kind)
    large = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(flat.tobytes() if offsets[0] % size else flat, kind).reshape(n, -1)


def unit_rows(x: np.ndarray, eps: float = 1e-8, mode: str = "max") -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / (np.maximum(size, eps) if mode == "max" else size + eps)


def row_slices(n: int, step: int = SLICE_ROWS):
    for start in range(0, n, step):
        yield slice(start, min(start + step, n))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances; near-equal pairs are recomputed without cancellation."""
    squares = (
        np.einsum("ij,ij->i", x, x)[:, None]
        + np.einsum("ij,ij->i", points, points)[None, :]
    )
    d2 = squares - 2.0 * (x @ points.T)
    rows, cols = np.nonzero(d2 < 1e-4 * np.maximum(squares, 1e-300))
    if len(rows):
        gap = x[rows] - points[cols]
        d2[rows, cols] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(np.maximum(d2, 0.0))


def nearest_distance(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for part in row_slices(len(x)):
        out[part] = distances(x[part], points).min(axis=1)
    return out


def best_rows(score: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the ``limit`` best rows by score descending, then id ascending."""
    n = len(score)
    if n > limit:
        edge = np.partition(score, n - limit)[n - limit]
        keep = np.flatnonzero(score >= edge)
    else:
        keep = np.arange(n)
    order = np.lexsort((ids[keep], -score[keep]))
    return keep[order][:limit]


def id_values(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return np.asarray(column)
