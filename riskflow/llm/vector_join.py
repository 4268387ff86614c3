"""Near-duplicate embeddings by an exact metric range join.

Equal vectors are one class first. On the unit sphere a cosine bound is a distance ``e``. Pivots cut the classes into
cells; by the triangle inequality a vector within ``e`` of one in another cell lies within ``e`` of the plane between
both pivots and within the cell's radius plus ``e`` of its pivot, and only then is it copied there. Each cell joins
its own vectors and the copies in blocks, apart from all other cells, and gives sums of links and a forest of links,
never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise
from .components import connected_components
from .vectors import Sizes, matrix, packed, pivot_rows, sizes, unpacked, usable

COSINE = 0.95
#: Vectors that look for links in one block of a cell, as a multiple of the block's rows.
PROBES = 8
#: Rows compared at once.
STRIP = 1024

BOTH = "cell int, block long, side long, id long, own boolean, n long, v binary"


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place(classes: DataFrame, size: Sizes, pivots: np.ndarray) -> DataFrame:
    """id, n, cell of the nearest pivot, distance to it, salt and the packed vector of each class."""

    def make():
        task, rows = TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal rows
            x = matrix(column(batch, "vector"), size.dim)
            cosines = directions(x) @ pivots.T
            cell = np.argmax(cosines, axis=1)
            away = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(x)), cell]))
            salt = (task << 32) + rows + np.arange(len(x))
            rows += len(x)
            return pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "n"), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(salt), packed(x)], ["id", "n", "cell", "away", "salt", "v"])

        return each

    return map_arrow(classes, make, "id long, n long, cell int, away double, salt long, v binary")


def copies(placed: DataFrame, size: Sizes, pivots: np.ndarray, radius: np.ndarray, limit: float) -> DataFrame:
    """A row (id, n, cell, salt, v) for each cell of a lower number that may hold a link of the vector."""

    def make():
        between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
        lower = np.tri(len(pivots), k=-1, dtype=bool)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = unpacked(column(batch, "v"), "<f8", size.dim)
            home = column(batch, "cell").to_numpy()
            square = np.maximum(0, 2 - 2 * (directions(x) @ pivots.T))
            beyond = square - square[np.arange(len(x)), home][:, None] <= 2 * limit * between[home] + 1e-9
            near = np.sqrt(square) <= radius + limit + 1e-9
            row, cell = np.nonzero(lower[home] & beyond & near)
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([column(batch, "id").take(at), column(batch, "n").take(at), pa.array(cell.astype(np.int32)), pa.array(column(batch, "salt").to_numpy()[row]), column(batch, "v").take(at)], ["id", "n", "cell", "salt", "v"])

        return each

    return map_arrow(placed, make, "id long, n long, cell int, salt long, v binary")


def block_links(members: tuple, probes: tuple, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a block's members and probes as (id, links, smallest id known to be connected), strip by strip.

    A copy's link counts for both ends; a probe that lives in the cell counts for itself, as its partner is a probe
    of the cell too.
    """
    ids, n, x = members
    probe_ids, own, weight, y = probes
    norm = np.linalg.norm(x, axis=1)
    for k in range(0, len(y), STRIP):
        part, part_ids = y[k : k + STRIP], probe_ids[k : k + STRIP]
        linked = part @ x.T >= cosine * (np.linalg.norm(part, axis=1)[:, None] * norm)
        linked &= part_ids[:, None] != ids
        if not linked.any():
            continue
        copied = ~own[k : k + STRIP]
        to_probes = linked @ n
        to_members = (weight[k : k + STRIP] * copied) @ linked
        of_probes, of_members = part_ids.copy(), ids.copy()
        while True:  # the smallest id within the strip's links
            p = np.minimum(of_probes, np.where(linked, of_members, np.iinfo(np.int64).max).min(1))
            m = np.minimum(of_members, np.where(linked, p[:, None], np.iinfo(np.int64).max).min(0))
            if (p == of_probes).all() and (m == of_members).all():
                break
            of_probes, of_members = p, m
        keep = to_probes > 0
        yield part_ids[keep], to_probes[keep], of_probes[keep]
        keep = linked.any(0)
        yield ids[keep], to_members[keep], of_members[keep]


def embedding_links(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links of every vector with the vectors of at least that cosine.

    Args:
        embeddings: vec_id and embedding; other columns, labels among them, are ignored.
    Returns:
        vec_id, n_links, component_id, kept, for every row.

    Cosines are in double precision. Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor do rows with a null vec_id (whose component is null, and which are kept). Vectors of unequal lengths
    count as filled up with zeros. Repeated rows, and rows that share a vec_id, are rows of their own, which link with
    each other as their vectors do; an empty table gives an empty one.
    """
    limit = math.sqrt(2 - 2 * cosine)
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = source.withColumn("vector", F.when(good, F.col("vector")))
    classes = materialise(rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "classes")
    size = sizes(classes)
    rest = {"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.lit(True)}
    if not size.rows:
        return rows.select("vec_id").withColumns(rest)

    chosen = pivot_rows(classes.select(F.col("id").alias("vec_id"), "vector"), size.pivots)
    pivots = np.zeros((len(chosen), size.dim))
    for row, p in zip(chosen, pivots, strict=True):
        p[: len(row["vector"])] = row["vector"]
    pivots = directions(pivots)
    placed = materialise(place(classes, size, pivots), "placed")
    radius, members = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for s in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row for each pivot
        radius[s["cell"]], members[s["cell"]] = s["r"], s["n"]
    moved = materialise(copies(placed, size, pivots, radius, limit), "copies")
    arrived = np.zeros(len(pivots), np.int64)
    for s in moved.groupBy("cell").agg(F.count("*").alias("n")).collect():
        arrived[s["cell"]] = s["n"]

    spark = embeddings.sparkSession
    cut = spark.createDataFrame([(c, math.ceil(members[c] / size.cell_rows), max(1, math.ceil((members[c] + arrived[c]) / (PROBES * size.cell_rows)))) for c in range(len(pivots))], "cell int, blocks long, sides long")
    # A member is a member in one block for every side of probes; as a probe it belongs to one side and visits every block.
    every_side, every_block = F.sequence(F.lit(0), F.col("sides") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = placed.join(F.broadcast(cut), "cell")
    probe = (F.explode(every_block).alias("block"), F.pmod(F.col("salt") * 7 + 3, "sides").alias("side"))
    home = spread.select("cell", F.pmod("salt", "blocks").alias("block"), F.explode(every_side).alias("side"), "id", F.lit(None).cast("boolean").alias("own"), "n", "v")
    local = spread.select("cell", *probe, "id", F.lit(True).alias("own"), "n", "v")
    foreign = moved.join(F.broadcast(cut), "cell").select("cell", *probe, "id", F.lit(False).alias("own"), "n", "v")

    def join(table: pa.Table) -> pa.Table:
        ids, n, v, own = table["id"].to_numpy(), table["n"].to_numpy(), table["v"], table["own"]
        member = own.is_null().to_numpy()
        x = unpacked(v, "<f8", size.dim)
        flag = np.array([bool(o) for o in own.to_pylist()])
        out = list(block_links((ids[member], n[member], x[member]), (ids[~member], flag[~member], n[~member], x[~member]), cosine)) if member.any() and not member.all() else []
        i, links, low = (np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(3)) if out else (np.array([], np.int64),) * 3
        return pa.table({"id": i, "links": links, "low": low})

    found = materialise(home.unionByName(local).unionByName(foreign).groupBy("cell", "block", "side").applyInArrow(join, "id long, links long, low long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = materialise(connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))), "parts").join(classes.select("id", "first"), "id")
    smallest = parts.groupBy("component_id").agg(F.min("first").alias("least"))
    reached = parts.join(smallest, "component_id").select("id", "least")
    result = materialise(
        classes.join(links, "id", "left").join(reached, "id", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")),
        "classes",
    )
    linked = rows.where(F.col("vector").isNotNull()).join(result, "vector").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rows.where(F.col("vector").isNull()).select("vec_id").withColumns(rest))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), n AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.95 * (a.norm * b.norm)
), reach AS (
  SELECT a AS id, a AS other FROM link
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), part AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), degree AS (
  SELECT a AS id, count(*) AS n_links FROM link GROUP BY a
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
  coalesce(component_id, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN part p ON p.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id
"""
