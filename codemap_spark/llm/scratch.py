"""Tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids that a checked broadcast may hold (8 bytes each in the source column).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}-{label}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of a wide table with a materialized id table.

    The ids are broadcast only when a count shows at most BROADCAST_ROWS;
    beyond that both sides shuffle and AQE splits skewed partitions.
    """
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def numbered(spark: SparkSession, df: DataFrame, key: str, name: str) -> DataFrame:
    """df with each row's place by key, from 0: ranges are ranked on their own, only their counts meet."""
    part = fresh(df, "part")
    df = materialize(spark, df.repartitionByRange(key).withColumn(part, F.spark_partition_id()), "ranges")
    # One row a partition, as few as the ranges that the shuffle made.
    starts = df.groupBy(part).agg(F.count("*").alias("n")).select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("n"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    return df.withColumn(name, place).join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col("n")).drop(part, "n")


def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Batches) -> Batches:
    """run, after which a worker gives back what it freed; reused workers would keep it beside the next stage's."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out
