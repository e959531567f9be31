"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: str) -> Column:
    """Vectors that are there, not zero, and hold finite numbers only."""
    real = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & real & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column whose lists all have one length."""
    flat = column.flatten()
    return np.asarray(flat).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def lists(values: np.ndarray, kind) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, added up from the first component to the last."""
    p = a.astype(np.float64) * b.astype(np.float64)
    return np.add.accumulate(p, axis=-1)[..., -1]
