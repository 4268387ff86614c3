"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in
    tests, a temporary folder takes its place for the life of the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with per-task set-up: ``make()`` runs on the executor and returns the function of batches, of at most ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in few(batches, rows) if rows else batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, with null as the empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def text_columns(df: DataFrame) -> DataFrame:
    """Only the two columns that text operators read; further columns may have any name."""
    return df.select(F.col("doc_id"), F.col("text"))


def few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``rows``, for steps that make much of a row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def runs_of(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by an integer column, as its value and the pieces of batches that have it: a task sees one value's rows at a time."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        keys = column(batch, name).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                if held and keys[lo] != value:
                    yield value, held
                    held = []
                value = int(keys[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield value, held


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays summed by segment, in two steps so that no task gets one row of every task: a row for each segment comes back."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, "<f8") for v in table["v"].to_pylist())
        return pa.table({"segment": table["segment"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    both = parts.groupBy("segment", F.pmod("task", F.lit(64))).applyInArrow(add, "segment int, v binary").groupBy("segment").applyInArrow(add, "segment int, v binary")
    return {r["segment"]: np.frombuffer(r["v"], "<f8") for r in both.collect()}


_caches: dict[str, dict] = {}
#: Gives the C library's unused memory back to the system, where there is such a call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def worker_cache(name: str, holder: dict) -> dict:
    """A cache that lives as long as a worker process, under the name of its use."""
    _caches[name] = holder
    return holder


def keep_only(name: str) -> None:
    """Empty the worker's caches of other uses: workers go on from stage to stage, and their memory is one."""
    for use, holder in _caches.items():
        if use != name:
            holder.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
