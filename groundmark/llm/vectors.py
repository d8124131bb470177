"""Tables of vectors: which rows count, and their matrices inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(column: str) -> Column:
    """Whether a vector is there, not empty, and without null, NaN or infinite entries."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad, F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The most common length of the vectors (the larger of equally common ones); 0 for an empty table."""
    found = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return int(found["d"]) if found else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))
