"""Connected components of an edge table, by alternating large and small stars.

Each round moves every vertex to the smallest neighbour it knows; the rounds end when all vertices of a component
hang on its smallest one, or no more edges are left than a task contracts at once, which ends them. Tasks first
contract the edges they hold, so that dense groups arrive as stars. A vertex with very many neighbours is only ever
the key of an aggregation with partial sums or of a join whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def local_stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(vertex, smallest vertex of its component) for all vertices of ``edges`` but the smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(v, root(v)) for v in parent if root(v) != v]


#: Edges that a task contracts at once.
CONTRACTED = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, with the same components, at most one for each vertex and batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            stars = local_stars(held)
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= CONTRACTED:
                yield out()
                held = []
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _smallest(edges: DataFrame) -> DataFrame:
    """For each vertex in column a the smallest vertex in column b, written, so that joins with it can be split."""
    return materialise(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "smallest")


def ended(stars: DataFrame) -> DataFrame:
    """Each vertex with the one it hangs on, which hangs on itself."""
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every vertex that has an edge.

    Args:
        edges: a, b long; loops, repeats and either direction are fine.
    Returns:
        id, component_id: the smallest vertex reachable. An empty table gives an empty one.
    """
    stars = materialise(contracted(edges.where("a <> b")), "stars")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return ended(stars)
        if state[0] <= CONTRACTED:  # no more than a task contracts at once: it makes the components whole
            stars = materialise(contracted(stars.coalesce(1)), "last")
            return ended(stars)
        before = state
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = _smallest(both)
        large = both.where("b > a").join(small, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.least("m", "u").alias("b"))
        stars = materialise(contracted(large), "large")
        small = _smallest(stars)
        joined = stars.join(small, F.col("a") == F.col("u"))
        stars = materialise(
            joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(),
            "small",
        )
