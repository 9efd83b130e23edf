"""Integer vectors for the operators that score exactly: every component x is floor(256 * x)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components from here on take no part: their exact products would leave 64 bits.
LIMIT = 1 << 18


def whole_vectors(vectors: DataFrame, *columns: Column) -> DataFrame:
    """The columns and vec (doubles) of rows whose vector has only finite components below LIMIT.  NaN compares as larger than any."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float(LIMIT)), F.lit(False)))
    return vectors.select(*columns, vec.alias("vec")).where(F.col("vec").isNotNull() & sound)


def by_dimension(lists):
    """Arrow lists of doubles (no nulls) -> pairs (places, integer matrix), one for each dimension that occurs."""
    dims = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(dims)])
    for dim in np.unique(dims):
        own = np.nonzero(dims == dim)[0]
        yield own, np.floor(256 * flat[starts[own][:, None] + np.arange(dim)]).astype(np.int64)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of equally long binaries of 32-bit integers -> matrix of 64-bit ones."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim).astype(np.int64)
