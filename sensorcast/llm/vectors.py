"""Embeddings as NumPy matrices, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.ListArray) -> list[tuple[int, np.ndarray]]:
    """(row, vector as doubles) of the rows whose vector is not null or empty and whose components are
    neither null nor non-finite."""
    out = []
    for n, value in enumerate(column):
        if not value.is_valid or not len(value.values) or value.values.null_count:
            continue
        vector = np.asarray(value.values, dtype=np.float64)
        if np.isfinite(vector).all():
            out.append((n, vector))
    return out


def matrix(cells, dim: int, kind: str) -> np.ndarray:
    """Rows from their bytes."""
    return np.frombuffer(b"".join(cells), kind).reshape(-1, dim)
