"""What the two operators on vectors share: checked vectors, pivots and sizes of cells."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell aims at so many rows; small tables get smaller ones so that there are about MIN_CELLS.
CELL_ROWS = 4096
MIN_CELLS = 40
SMALLEST_CELL = 128
#: Pivots are sent to every task, so there are never more.
MAX_PIVOTS = 1024


class Sizes(NamedTuple):
    rows: int
    dim: int
    largest: float
    cell_rows: int
    pivots: int


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def sizes(vectors: DataFrame) -> Sizes:
    """Counts over all rows of ``vector``."""
    n, dim, largest = vectors.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    cell = min(CELL_ROWS, max(SMALLEST_CELL, math.ceil(n / MIN_CELLS)))
    return Sizes(n, dim or 0, largest or 0.0, cell, min(MAX_PIVOTS, math.ceil(n / cell)))


def pivot_rows(vectors: DataFrame, n: int) -> list:
    """Rows of the ``n`` ids with the smallest hashes, one of each id: a bounded sample of places, not of results."""
    ids = vectors.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)
    return vectors.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; a short vector is filled up with zeros."""
    values, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    if len(vectors) and (np.diff(at) == dim).all():
        return values[at[0] : at[-1]].reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(vectors), dim))
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[k, : b - a] = values[a:b]
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    data = x.tobytes()
    return pa.array([data[k * width : (k + 1) * width] for k in range(len(x))], pa.binary())


def unpacked(rows: pa.Array | pa.ChunkedArray, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), dtype).reshape(len(rows), dim)
