"""Rows of numbers on their way into tasks: many columns go as one array, which costs a third of as many columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def vector(names) -> Column:
    """The named columns of a row as an array of doubles."""
    return F.array(*[F.col(n).cast("double") for n in names]).alias("v")


def columns_of(rows: pa.Array, size: int) -> np.ndarray:
    """Numbers by (column, row) out of such arrays; a null is NaN."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.ascontiguousarray(flat.reshape(-1, size).T)


def filled(rows: pa.Array, size: int) -> np.ndarray:
    """Which numbers by (column, row) are not null."""
    return np.ascontiguousarray(rows.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).T)
