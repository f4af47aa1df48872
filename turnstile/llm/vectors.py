"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def dimension(rows: DataFrame, vector: str = "v") -> int:
    return max(rows.agg(F.max(F.size(vector))).first()[0] or 0, 1)


def matrix(column: pa.ChunkedArray | pa.Array, d: int, kind=np.float64) -> np.ndarray:
    """Rows of ``d`` components; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d).astype(kind)
    out = np.zeros((len(sizes), d), dtype=kind)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
