"""Vectors as integers: which rows of a table take part, and their components floored in blocks of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest size of an integer component. Products of two, summed over MOST_PARTS components, stay inside 63 bits.
MOST = 1 << 26
MOST_PARTS = 1 << 10


def usable(vector: str) -> Column:
    """True where the vector and all its components are there and finite; an empty vector is usable."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def kept_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(usable(vector))


def longest(vectors: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, most components) by one aggregate."""
    n, most = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    return n, most or 0


def integers(column, scale: int, width: int) -> np.ndarray:
    """``floor(scale * x)``, x as double, of a list column without nulls: (rows, width) int64; missing components are zero.

    Raises ArithmeticError where a component is beyond ``MOST``, since sums of its products might wrap around.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > MOST:
        raise ArithmeticError(f"a component of {np.abs(flat).max():.0f} is beyond {MOST}")
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat.astype(np.int64)
    return out
