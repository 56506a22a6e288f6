"""Vectors of Arrow list columns as NumPy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the column's vectors.

    A null, an empty vector and a vector with a null or non-finite component are left out.
    """
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False) if pa.types.is_floating(flat.type) else flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        found = values[start[rows][:, None] + np.arange(n)]
        fine = np.isfinite(found).all(axis=1)
        if fine.any():
            yield rows[fine], found[fine]
