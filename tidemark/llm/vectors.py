"""Vector tables: which rows take part, by dimension, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.forall(column, finite) & F.exists(column, lambda x: x != 0))


def by_dimension(rows: DataFrame, column: str = "embedding") -> list[DataFrame]:
    """A frame for each dimension that occurs; cosines are defined within one only.  The
    driver gets the dimensions, of which a table has as many as it mixes models."""
    found = sorted(r[0] for r in rows.select(F.size(column)).distinct().collect())
    return [rows.where(F.size(column) == d) for d in found]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
