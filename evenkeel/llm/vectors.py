"""Helpers for tables of vectors: which are usable, and matrices out of Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(vector: Column) -> Column:
    """True for a vector without NULL, NaN or infinite entries; false for a NULL vector."""

    def finite(entry: Column) -> Column:
        value = entry.cast("double")
        return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of list in a batch the rows that have it, and their entries as a matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        if len(rows) == len(lengths):
            yield rows, flat.reshape(len(rows), width)
        else:
            yield rows, flat[(ends[rows] - width)[:, None] + np.arange(width)]


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(matrix.ravel(), kind))
