"""Vectors of doubles as vectors of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite; true for one without any."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))), F.lit(False))


def floors(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def check_sizes(vectors: DataFrame, vector: str, scale: int, times: int) -> None:
    """Raise where ``times`` the square of a component, for each component, could leave 64 bits."""
    size = F.array_max(F.transform(vector, lambda c: F.abs(c.cast("double") * scale) + 1))
    most = vectors.agg(F.max(size * size * F.size(vector))).head()[0]
    if most is not None and most * times >= 1 << 62:
        raise OverflowError(f"components of {vector} are too large for whole numbers of 64 bits")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers each."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    return np.array(column.flatten(), np.int64).reshape(len(column), dim)
