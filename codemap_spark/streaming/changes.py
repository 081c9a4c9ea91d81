"""Changed files as a stream that keeps the state table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Snapshots that stay: the newest, and the one that a batch that runs again starts from.
KEPT = 2


def changes(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """A stream of (path, text) rows from Parquet files that appear in folder, so many a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def snapshot(spark: SparkSession, state_path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{state_path}/epoch={epoch}")


def follow(spark: SparkSession, stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that folds each batch into a new snapshot of the state (path, content_hash).

    A null text says that the file is gone, unless the batch has a text of it as
    well. A batch that is run again gives the same snapshot, as the one before
    it stays; older ones are removed.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        seen = batch.groupBy("path").agg(F.max("text").alias("text"))
        now = seen.where("text IS NOT NULL").select("path", F.sha2("text", 256).alias("content_hash"))
        if epoch:
            now = now.unionByName(snapshot(spark, state_path, epoch - 1).join(seen.select("path"), "path", "left_anti"))
        now.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        if epoch >= KEPT:
            jvm = spark.sparkContext._jvm
            old = jvm.org.apache.hadoop.fs.Path(f"{state_path}/epoch={epoch - KEPT}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
