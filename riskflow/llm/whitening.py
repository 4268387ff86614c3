"""Whitening of vectors by polarised covariances.

Every covariance comes from variances: 2 cov(a, b) = var(a + b) - var(a) - var(b). So all that is aggregated are exact sums of
squared centred integers, one for each dimension and each sum of two dimensions; their number depends on the dimensions
alone. The matrix they give is decomposed once, and each vector is projected on the leading components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, few, materialise
from .vectors import usable

#: Integers are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components returned for each vector.
COMPONENTS = 8
#: Rows centred and squared at once.
ROWS = 1024
#: Squares are added up in limbs of so many bits: ROWS products of two limbs fit into 64 bits.
LIMB_BITS = 26
#: Components whose eigenvalue is below this share of the largest can't be told from rounding; they aren't whitened.
LEAST_SHARE = 1e-12


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def rows_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The x-vectors of a batch; missing places of a short vector hold OFFSET, as zeros do."""
    x = column(batch, "x")
    out = np.full((len(x), dim), OFFSET, np.int64)
    values, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    n = np.diff(at)
    row = np.repeat(np.arange(len(x)), n)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], n)] = values[at[0] : at[-1]]
    return out


def square_sums(u: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column."""
    sign, limbs = np.sign(u), []
    rest = np.abs(u)
    while rest.any() or not limbs:
        limbs.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
        rest = rest >> LIMB_BITS
    out = [0] * u.shape[1]
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for k, s in enumerate((a * b).sum(0).tolist()):
                out[k] += s << (LIMB_BITS * (i + j))
    return out


def dimension_sums(dim: int):
    """For each task the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in few(batches, ROWS):
            total = [t + s for t, s in zip(total, rows_of(batch, dim).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([str(t) for t in total])], ["a", "v"])

    return run


class Centred:
    """x-vectors as integers y = n x - S, and as x - S/n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, near = n, [s // n for s in sums]
        rest = [s - m * n for s, m in zip(sums, near, strict=True)]
        self.near, self.rest, self.share = np.array(near, np.int64), np.array(rest, np.int64), np.array([r / n for r in rest])

    def exact(self, x: np.ndarray) -> np.ndarray:
        z = x - self.near
        if self.n * (int(np.abs(z).max(initial=0)) + 1) >= 1 << 60:
            z = z.astype(object)  # whole numbers of any size
        return self.n * z - self.rest

    def rounded(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.share


#: Sums of squares travel as two decimals, so that they can't overflow.
HALF = 10**18


def polarised(dim: int, centred: Centred):
    """For each task the exact sums of y^2 of every dimension (a = b) and of every sum of two dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[int]] = [[0] * (dim - a) for a in range(dim)]
        for batch in few(batches, ROWS):
            y = centred.exact(rows_of(batch, dim))
            for a in range(dim):
                own = np.concatenate([y[:, a : a + 1], y[:, a : a + 1] + y[:, a + 1 :]], 1)
                found[a] = [p + q for p, q in zip(found[a], square_sums(own), strict=True)]
        for a in range(dim):
            places = pa.array(np.full(dim - a, a, np.int32)), pa.array(np.arange(a, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*places, pa.array([str(v // HALF) for v in found[a]]), pa.array([v % HALF for v in found[a]], pa.int64())], ["a", "b", "high", "low"])

    return run


def covariance(squares: dict[tuple[int, int], int], dim: int, n: int) -> np.ndarray:
    """The covariance of x from the sums of squares of y = n x - S: each entry is an exact fraction, rounded once."""
    out = np.empty((dim, dim))
    for (a, b), s in squares.items():
        cross = Fraction(s) if a == b else Fraction(s - squares[a, a] - squares[b, b], 2)
        out[a, b] = out[b, a] = float(cross / n**3)
    return out


def projected(dim: int, centred: Centred, basis: np.ndarray):
    """deviation and the products of x - S/n with the columns of ``basis``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, ROWS):
            x = rows_of(batch, dim)
            deviation = [v if v < 1 << 63 else None for v in square_sums(centred.exact(x).T)]
            w = centred.rounded(x) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whiten all vectors by the leading components of their covariance.

    Args:
        embeddings: vec_id (long) and embedding (array of numbers); further columns may have any name and are not read.
    Returns:
        A row for each usable vector and component: vec_id, component (from 1 by falling eigenvalue), n (vectors fitted),
        deviation (sum over dimensions of (n x - S)^2; null where that is beyond a long, from some 10^6 vectors of far
        spread on), whitened, explained (the eigenvalue's share of the trace) and identity_error (largest absolute entry
        of whitened's covariance minus the identity). Vectors that are null or hold null or non-finite entries take no
        part; missing places of shorter vectors count as zeros; repeated rows count each time. Where a component has no
        variance (one row, equal rows, fewer distinct rows than components) whitened is null, and it is left out of
        identity_error, which is null if no component is left; explained is 0 then, and null if nothing varies at all. Of
        equal eigenvalues, the order and the components are the decomposition's. Vectors without any place, and an empty
        table, give an empty one. Entries are to be below 2^52 in size.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding").alias("x"), usable(F.col("embedding")).alias("ok")).where("ok").select("vec_id", "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, dim = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dim:
        return embeddings.sparkSession.createDataFrame([], schema)
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = dict(vectors.mapInArrow(dimension_sums(dim), "a int, v string").groupBy("a").agg(whole("v")).collect())  # a row for each dimension
    centred = Centred(n, [int(sums[k]) for k in range(dim)])
    parts = vectors.mapInArrow(polarised(dim, centred), "a int, b int, high string, low long")
    squares = {(a, b): int(high) * HALF + int(low) for a, b, high, low in parts.groupBy("a", "b").agg(whole("high"), whole("low")).collect()}  # a row for each pair of dimensions
    values, directions = np.linalg.eigh(covariance(squares, dim, n))
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
    m = min(components, dim)
    kept = [k for k in range(m) if values[k] > LEAST_SHARE * max(values[0], 0)]
    basis = directions[:, :m] / np.sqrt(np.where(values[:m] > 0, values[:m], 1))
    rows = materialise(vectors.mapInArrow(projected(dim, centred, basis), "vec_id long, deviation long, w array<double>"), "whitened")
    error = None
    if kept:
        means = rows.agg(*(F.avg(F.col("w")[k]) for k in kept)).first()
        off = [F.col("w")[k] - F.lit(mean) for k, mean in zip(kept, means, strict=True)]
        pairs = [(i, j) for i in range(len(kept)) for j in range(i, len(kept))]
        spread = rows.agg(*(F.avg(off[i] * off[j]) for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(spread, pairs, strict=True))
    trace = float(values.sum())
    of_component = F.array(*(F.lit(float(v) / trace if trace else None).cast("double") for v in values[:m]))
    whitened = F.when(F.array(*(F.lit(k in kept) for k in range(m)))[F.col("at")], F.col("c"))
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), of_component[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
