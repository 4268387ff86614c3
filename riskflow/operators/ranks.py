"""Exact ranks, running sums and order statistics of tables of any size, without a window over one partition.

Rows are ranged by their keys and order; each range is summed by itself, the sums of the ranges are run up, and windows stay
within a range. So a key that holds most of the rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``left`` with the columns of ``right``'s row for its keys; null keys are equal. Without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed, on).drop(*(f"_same_{k}" for k in keys))


def running_totals(rows: DataFrame, order: list[str | Column], values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``{v}_before`` and ``{v}_all`` for each v of ``values``: the sum over the earlier rows of the same keys, and over all of them.

    ``order`` is to be total within the keys; rows that tie are taken in any order. Null values count as 0, null keys are one
    key. The table is written once, so that a row stays in its range. What is run up over the ranges is a row for each range
    and key within it: without keys as many as there are tasks. An empty table gives an empty one.
    """
    columns = rows.columns
    by = [o if isinstance(o, Column) else F.col(o) for o in order]
    ranged = written(rows.repartitionByRange(*map(F.col, keys), *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_range").agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"_{v}") for v in values))
    earlier, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    starts = sums.select(*keys, "_range", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_from_{v}") for v in values), *(F.sum(f"_{v}").over(whole).alias(f"{v}_all") for v in values))
    inside = Window.partitionBy(*keys, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    placed = same(within, starts, (*keys, "_range"))
    return placed.select(*columns, *((F.col(f"_from_{v}") + F.col(f"_in_{v}")).alias(f"{v}_before") for v in values), *(f"{v}_all" for v in values))


def cut_at_gaps(rows: DataFrame, at: str, gap: int, order: list[str], keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``piece``: the ``at`` of the first row of their piece, where a piece ends before a silence of more than ``gap``.

    What is matched within a window of ``gap`` never reaches over such a silence, so pieces can be worked on apart. Rows are in the
    order of ``at`` and ``order`` within the keys; of each range of rows its last time and last piece are passed on to the next.
    ``at`` isn't to be null.
    """
    columns = rows.columns
    ranged = written(rows.repartitionByRange(*keys, at, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges, inside = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys, "_range").orderBy(at, *order)
    ends = ranged.groupBy(*keys, "_range").agg(F.max(at).alias("_last"))
    marked = same(ranged, ends.select(*keys, "_range", F.lag("_last").over(ranges).alias("_from")), (*keys, "_range"))
    before = F.coalesce(F.lag(at).over(inside), F.col("_from"))
    marked = marked.withColumn("_new", F.when(before.isNull() | (F.col(at) - before > gap), F.col(at)))
    starts = marked.groupBy(*keys, "_range").agg(F.max("_new").alias("_start"))
    carried = F.max("_start").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried")
    placed = same(marked, starts.select(*keys, "_range", carried), (*keys, "_range"))
    own = F.max("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("piece", F.coalesce(own, F.col("_carried"))).select(*columns, "piece")


def order_statistics(rows: DataFrame, value: str, positions: dict[str, Callable[[Column], Column]], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key: ``n`` values that aren't null, and the elements of their sorted list at ``positions``.

    ``positions`` gives a name and, from n, a place counted from 0; a place outside the list gives null.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    placed = running_totals(counts, [value], ["_k"], keys)
    n, before = F.col("_k_all"), F.col("_k_before")
    elements = [F.max(F.when((at(n) >= before) & (at(n) < before + F.col("_k")), F.col(value))).alias(name) for name, at in positions.items()]
    return placed.groupBy(*keys).agg(F.max(n).alias("n"), *elements)


def medians(rows: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "median") -> DataFrame:
    """A row for each key: n and the exact median, the mean of the two middle values where n is even."""
    found = order_statistics(rows, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}, keys)
    return found.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias(name))


#: Places of the elements that can be in the middle when one row is left out of n.
_LEFT_OUT = {
    "_a": lambda n: F.floor((n - 2) / 2), "_a1": lambda n: F.floor((n - 2) / 2) + 1,
    "_b": lambda n: F.floor((n - 1) / 2), "_b1": lambda n: F.floor((n - 1) / 2) + 1,
}


def others_median(rows: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "others_median") -> DataFrame:
    """``rows`` with ``others``, the number of other rows with the same keys, and ``name``, the median of those without the row itself.

    Leaving one row out moves each place of the sorted list by one at most: the element at place p is still there if the row's
    value lies above it, else it is the next one. So a key needs three neighbouring elements and no row is compared with
    another. Rows that tie are told apart by their number alone. Null where there are no others; values aren't to be null.
    """
    stats = order_statistics(rows, value, _LEFT_OUT, keys).withColumnRenamed("n", "_n")
    kept = lambda p: F.when(F.col(value) > F.col(p), F.col(p)).otherwise(F.col(f"{p}1"))
    middle = F.when(F.col("_n") > 1, (kept("_a") + kept("_b")) / 2)
    return same(rows, stats, keys).withColumns({"others": F.col("_n") - 1, name: middle}).drop("_n", *_LEFT_OUT)


def others_deviation(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``others``, ``others_median`` and ``others_mad``: the median of the other rows' distances to that median.

    Leaving a row out gives at most three different medians a key. The distances of all rows to each of them are ranked, and a
    row's own distance is left out in the same way.
    """
    centred = written(others_median(rows, value, keys), "centred")
    centres = centred.where("others > 0").select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("others_median").alias("_centre")).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # at most three centres a key
    far = centred.select(*keys, value).join(centres, on) if keys else centred.select(value).crossJoin(F.broadcast(centres))
    far = far.select(*keys, "_centre", F.abs(F.col(value) - F.col("_centre")).alias("_far"))
    stats = order_statistics(far, "_far", _LEFT_OUT, (*keys, "_centre")).withColumnRenamed("n", "_n")
    own = centred.withColumns({"_centre": F.col("others_median"), "_far": F.abs(F.col(value) - F.col("others_median"))})
    kept = lambda p: F.when(F.col("_far") > F.col(p), F.col(p)).otherwise(F.col(f"{p}1"))
    found = own.where("others > 0")
    found = same(found, stats, (*keys, "_centre")).withColumn("others_mad", (kept("_a") + kept("_b")) / 2)
    alone = own.where("others = 0").withColumn("others_mad", F.lit(None).cast("double"))
    keep = [*rows.columns, "others", "others_median", "others_mad"]
    return found.select(*keep).unionByName(alone.select(*keep))
