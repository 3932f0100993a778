"""Vectors as columns and as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether the vector is there and every entry is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """(rows, dims) of a list column of integers; shorter lists are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.asarray(column.offsets)
    sizes = np.diff(ends)
    if len(flat) == len(column) * dims and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out
