"""Exact top-k search by inner product, as a Voronoi join.

Pivots cut the data into cells. For a query q the products with the pivots, which are rows too, give a score that k
rows reach at least; a cell with pivot p and radius r holds no product above ``q.p + |q| r``, so only cells beyond
that score are looked at. Cells stand on shelves: a task holds one shelf's rows while the queries sent to it stream by.
A query goes to its own cell's shelf first, then, with the score reached there, to the others that it still needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise
from .vectors import Sizes, matrix, packed, pivot_rows, sizes, unpacked, usable

SCALE = 1024
K = 10
EVERY = 100
#: Queries that are worked on at once, and rows that they are multiplied with at once.
TOGETHER, ROWS = 256, 16_384
#: A task holds the rows of one shelf of cells. There are about so many shelves, as each may get every query, but for tables
#: whose shelves would hold fewer than SHELF_LEAST rows or more than SHELF_MOST.
SHELVES, SHELF_LEAST, SHELF_MOST = 256, 1 << 14, 1 << 18


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def place(vectors: DataFrame, size: Sizes, pivots: np.ndarray, dtype: str) -> DataFrame:
    """vec_id, cell of the nearest pivot, radius (the distance to it), salt (a number of the row) and the packed vector."""

    def make():
        task, rows = TaskContext.get().partitionId(), 0
        half = (pivots * pivots).sum(1) / 2

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal rows
            x = quantised(matrix(column(batch, "vector"), size.dim))
            cell = np.argmax(x @ pivots.T - half, axis=1)
            radius = np.linalg.norm(x - pivots[cell], axis=1)
            salt = (task << 32) + rows + np.arange(len(x))
            rows += len(x)
            return pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(salt), packed(x.astype(dtype))], ["vec_id", "cell", "radius", "salt", "v"])

        return each

    return map_arrow(vectors, make, "vec_id long, cell int, radius double, salt long, v binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def longest(x: np.ndarray) -> float:
    """The greatest length of a row."""
    return math.sqrt(float(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)).max(initial=0))) * (1 + 1e-9)


def kind_of(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest numbers that hold all products of rows and whatever is summed up on the way: no sum exceeds the lengths' product."""
    bound = longest(q) * longest(x)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def shelves(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shelf of each cell and how many it takes: small cells share one of at most ``most`` rows, a larger cell has several of its own."""
    first, parts = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // most))
    shelf, full = 0, 0
    for c, n in enumerate(rows.tolist()):
        if full and full + n > most:
            shelf, full = shelf + 1, 0
        first[c] = shelf
        if parts[c] > 1:
            shelf, full = shelf + int(parts[c]), 0
        else:
            full += n
    return first, parts


class Stock:
    """A shelf's rows by cell."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        cells, self.ids, self.x = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int32), np.zeros(0, np.int64), None)
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        self.runs = [(int(cells[a]), lo, min(b, lo + ROWS)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b for lo in range(a, b, ROWS)]

    def find(self, asked: np.ndarray, q: np.ndarray, floor: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row and score of the k best rows of each query, of those that reach its floor; only cells that ``near`` marks are looked at."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for cell, lo, hi in self.runs:
            at = np.flatnonzero(near[:, cell])
            if not len(at):
                continue
            some, x, ids = q[at], self.x[lo:hi], self.ids[lo:hi]
            kind = kind_of(some, x)
            scores = some.astype(kind) @ x.astype(kind).T
            ok = (scores >= floor[at][:, None]) & (ids != asked[at][:, None])
            if ok.sum() <= 4 * k * len(at):
                i, j = np.nonzero(ok)
                out.append((at[i], ids[j], scores[i, j].astype(np.int64)))
                continue
            for place, row, fit in zip(at.tolist(), scores, ok, strict=True):
                j = np.flatnonzero(fit)
                j = j[best(row[j], ids[j], k)]
                out.append((np.full(len(j), place), ids[j], row[j].astype(np.int64)))
        place, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.lexsort((ids, -scores, place))
        place, ids, scores = place[by], ids[by], scores[by]
        ahead = np.arange(len(place)) - np.searchsorted(place, place)
        return asked[place[ahead < k]], ids[ahead < k], scores[ahead < k]


def exact_topk(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by ``every``.

    Args:
        embeddings: vec_id and embedding; other columns are ignored.
    Returns:
        query_id, rank (int, from 1), vec_id, score: the inner product of ``floor(1024 * x)``.

    Vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part. Vectors
    of unequal lengths count as filled up with zeros. Equal scores go by smaller vec_id. Of rows that share a vec_id
    all are candidates, except for their own query, and one is asked. With fewer than k others all are returned; an
    empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = sizes(vectors)
    if not size.rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dtype = "<i4" if size.largest < 2**20 else "<i8"
    chosen = pivot_rows(vectors, size.pivots)
    pivots = np.zeros((len(chosen), size.dim))
    for row, p in zip(chosen, pivots, strict=True):
        p[: len(row["vector"])] = row["vector"]
    pivots = quantised(pivots)
    placed = materialise(place(vectors, size, pivots, dtype), "placed")

    radius, rows = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for s in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect():
        radius[s["cell"]], rows[s["cell"]] = s["r"], s["n"]
    first, parts = shelves(rows, min(SHELF_MOST, max(SHELF_LEAST, math.ceil(size.rows / SHELVES))))
    n_shelves = int((first + parts).max())
    cells_of = [np.flatnonzero((first <= k) & (k < first + parts) & (rows > 0)) for k in range(n_shelves)]

    inexact = np.linalg.norm(pivots, axis=1).max() * size.dim * 1e-15  # of a product in doubles, as a share of the query's length

    def reach(q: np.ndarray) -> np.ndarray:
        """No product of a query with a row of a cell lies above this."""
        return (q @ pivots.T + np.linalg.norm(q, axis=1)[:, None] * np.maximum(radius, 0)) * (1 + 1e-9) + 1

    def make_floor():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            q = unpacked(column(batch, "v"), dtype, size.dim).astype(np.float64)
            to_pivots = q @ pivots.T - np.linalg.norm(q, axis=1)[:, None] * inexact
            if len(pivots) > k:  # pivots are of different ids, so that one of them at most is left out for the query's id
                reached = np.partition(to_pivots, len(pivots) - k - 1, axis=1)[:, len(pivots) - k - 1]
            else:
                reached = np.full(batch.num_rows, -np.inf)
            return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("vec_id", "cell", "v")), pa.array(reached)], ["vec_id", "cell", "v", "reached"])

        return each

    def send(queries: DataFrame, home: bool) -> DataFrame:
        """Queries to the shelves of their own cell, or to all others that may hold one of their k best."""

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                cell = column(batch, "cell").to_numpy()
                shelf = np.arange(n_shelves)
                own = (first[cell][:, None] <= shelf) & (shelf < (first + parts)[cell][:, None])
                if home:
                    to = own
                else:
                    near = reach(unpacked(column(batch, "v"), dtype, size.dim).astype(np.float64)) >= column(batch, "reached").to_numpy()[:, None]
                    to = np.stack([near[:, c].any(1) for c in cells_of], axis=1) & ~own
                at, shelf = np.nonzero(to)
                at = pa.array(at)
                return pa.RecordBatch.from_arrays([pa.array(shelf.astype(np.int32)), *(column(batch, c).take(at) for c in ("vec_id", "reached", "v"))], ["shelf", "vec_id", "reached", "v"])

            return each

        sent = map_arrow(queries, make, "shelf int, vec_id long, reached double, v binary", rows=TOGETHER)
        return sent.select("shelf", F.lit(1).alias("kind"), F.lit(0).alias("cell"), "vec_id", "reached", "v")

    def search(sent: DataFrame) -> DataFrame:
        """The k best of each shelf for the queries sent to it: a task holds one shelf's rows, and its queries stream by."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shelf, held, stock = None, [], None
            for batch in batches:
                keys = column(batch, "shelf").to_numpy() * 2 + column(batch, "kind").to_numpy()
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if lo == hi:
                        continue
                    piece, key = batch.slice(lo, hi - lo), int(keys[lo])
                    if key // 2 != shelf:
                        shelf, held, stock = key // 2, [], None
                    if key % 2 == 0:
                        held.append((column(piece, "cell").to_numpy(), column(piece, "vec_id").to_numpy(), unpacked(column(piece, "v"), dtype, size.dim)))
                        continue
                    if stock is None:
                        stock, held = Stock(held), []
                    for at in range(0, piece.num_rows, TOGETHER):
                        some = piece.slice(at, TOGETHER)
                        q, floor = unpacked(column(some, "v"), dtype, size.dim), column(some, "reached").to_numpy()
                        near = reach(q.astype(np.float64)) >= floor[:, None]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stock.find(column(some, "vec_id").to_numpy(), q, floor, near, k)], ["query_id", "vec_id", "score"])

        both = data.unionByName(sent).repartition("shelf").sortWithinPartitions("shelf", "kind", "cell")
        return both.mapInArrow(run, "query_id long, vec_id long, score long")

    per_cell = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(pivots))], "cell int, first int, parts int")
    spread = placed.join(F.broadcast(per_cell), "cell")  # at most MAX_PIVOTS rows
    data = spread.select((F.col("first") + F.pmod("salt", "parts")).cast("int").alias("shelf"), F.lit(0).alias("kind"), "cell", "vec_id", F.lit(None).cast("double").alias("reached"), "v")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("cell", "v")).alias("q")).select("vec_id", "q.*")
    asked = materialise(map_arrow(asked, make_floor, "vec_id long, cell int, v binary, reached double", rows=TOGETHER), "asked")

    # The own cell's rows come first: what they reach leaves most others out.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = materialise(ranked(search(send(asked, True))), "near")
    better = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * 1e-15).alias("better"))
    raised = asked.join(better, "vec_id", "left").select("vec_id", "cell", "v", F.greatest("reached", F.col("better")).alias("reached"))
    far = search(send(raised, False))
    return ranked(near.drop("rank").unionByName(far)).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
