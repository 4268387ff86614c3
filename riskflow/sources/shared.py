"""Tables written to the folder that the driver and executors share: to end a lineage, or to be read as one set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only where that is unset and the master local, as in tests, a temporary folder serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a folder of its own and return the written table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(tables: dict[str, DataFrame], path: str, dataset: int) -> str:
    """Write several tables of a dataset as one version: all are written to a new folder, then a line in the manifest names it.

    Readers follow the manifest's latest line of a dataset, so they see all tables of a version or none of it; a job that dies
    between tables leaves a folder that no line names, and running it again makes another version. Returns the version.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    line = spark.range(1).select(F.lit(dataset).cast("long").alias("dataset_id"), F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at"), F.array(*map(F.lit, tables)).alias("tables"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, version, tables: the last version of each dataset; no rows before the first one."""
    schema = "dataset_id long, version string, at long, tables array<string>"
    try:
        lines = spark.read.schema(schema).parquet(f"{path}/manifest")
    except AnalysisException:
        lines = spark.createDataFrame([], schema)
    return lines.groupBy("dataset_id").agg(F.max_by(F.struct("version", "tables"), F.struct("at", "version")).alias("last")).select("dataset_id", "last.*")


def read_published(spark: SparkSession, path: str, name: str, dataset: int) -> DataFrame | None:
    """A table of a dataset's last version, or None if there is none."""
    row = latest_versions(spark, path).where(F.col("dataset_id") == dataset).first()
    return spark.read.parquet(f"{path}/versions/{row['version']}/{name}") if row is not None and name in row["tables"] else None


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of versions that aren't a dataset's last one, those of jobs that died among them; returns their names.

    To be run while no job publishes to ``path``.
    """
    kept = {r["version"] for r in latest_versions(spark, path).collect()}  # one for each dataset
    files, at, make = _file_system(spark, f"{path}/versions")
    gone = [s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName() not in kept] if files.exists(at) else []
    for name in gone:
        files.delete(make(f"{path}/versions/{name}"), True)
    return gone
