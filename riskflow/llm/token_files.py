"""Token ids in Parquet: one list column in doc_id order, with bounded row groups and pages.

Ids are dictionary-coded (a vocabulary is a small dictionary), the other columns delta-coded; the page index lets a
reader fetch a few documents' ids, or only the metadata columns, without reading the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, scratch_path, text_columns, texts_of
from .subwords import run_encoder

FILE_SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, end_id: int = 0) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending doc_id order to ``path``.

    Files are ranges of doc_id in order; ``part`` numbers them and ``part_start`` counts the ids before a document
    within its file. A null doc_id sorts first; a null or empty text is the end id alone; equal doc_ids lie side by
    side, in the order of their texts' hashes; an empty table writes no row.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = text_columns(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<i4").tobytes()

    def make():
        encode = run_encoder(tokenizer, spaced).encode
        part, written = TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal written
            found = [encode(t) + end for t in texts_of(batch)]
            n = np.array([len(x) // 4 for x in found], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
            out = [pa.array(np.full(len(n), part, np.int32)), column(batch, "doc_id").cast("int64"), pa.array(written + offsets[:-1]), pa.array(n), ids]
            written += int(offsets[-1])
            return pa.RecordBatch.from_arrays(out, ["part", "doc_id", "part_start", "n_tokens", "ids"])

        return each

    (
        map_arrow(ranged, make, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``, the ids of all documents before each one: doc_id, start, n_tokens, ids.

    Only the totals of the files (one row each) are summed in order; they are fewer than the tasks that wrote them.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_file_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from :func:`read_token_files`."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = column(batch, "ids")
            values, at = np.ascontiguousarray(ids.values.to_numpy(), "<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = pa.array(np.diff(at).astype(np.int64))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "start"), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return each

    return map_arrow(tokens, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path)
    return token_file_digests(read_token_files(spark, path))
