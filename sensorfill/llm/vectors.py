"""Vectors as matrices of whole numbers, one length at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_length(column: pa.Array):
    """Yield (length, row numbers, matrix) for the vectors of each length. No nulls."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        yield int(length), rows, flat[start[rows][:, None] + np.arange(length)]


def largest(x: np.ndarray) -> float:
    """The largest absolute value."""
    return float(np.abs(x.astype(float)).max(initial=0.0))


def column_sums(weight: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact weighted sums of the columns."""
    kind = np.int64 if largest(x) * float(weight.sum(dtype=float)) < 2.0**62 else object
    return [int(v) for v in weight.astype(kind) @ x.astype(kind)]


def decimals(values: list[int]) -> pa.Array:
    """Whole numbers of up to 38 digits."""
    return pa.array([str(v) for v in values], pa.string()).cast(pa.decimal128(38, 0))
