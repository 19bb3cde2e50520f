"""Vectors in array columns: which are whole and finite, their integer grid, and blocks of them as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE_LIMIT = 2**53  # integers below are exact in double precision


def finite(column: str) -> Column:
    """Whether the array is there and holds no null, NaN or infinity; an empty one is finite."""
    good = F.forall(F.transform(column, lambda c: c.cast("double")), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def on_grid(column: str, steps: int) -> Column:
    """floor(steps * c) of each component c, taken as double; beyond the range of long it is that range's end."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(steps))).cast("long"))


def matrix(column: pa.Array, take: np.ndarray | None = None) -> np.ndarray:
    """Rows of one length as a matrix of longs."""
    if take is not None:
        column = column.take(pa.array(take))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def largest(x: np.ndarray) -> int:
    """The greatest absolute entry, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
