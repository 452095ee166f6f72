"""Vectors in Arrow columns as numpy matrices, without Python lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each row; 0 for null."""
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are proper vectors of `dims` components, their float64 values): not zero, all parts finite, none null."""
    rows = np.flatnonzero(lengths(column) == dims) if dims else np.zeros(0, np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null parts become NaN
    starts = column.offsets.to_numpy()[rows].astype(np.int64)
    x = values[starts[:, None] + np.arange(dims)]
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], x[ok]


def lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    ends = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
