"""Tables that several later steps read, written once to shared storage as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textguard.sources.shared import shared_folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in shared storage, deleted by Spark's file system when the session's JVM ends."""
    path = shared_folder(spark, purpose)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written and read back: a short lineage that survives lost executors."""
    path = new_folder(rows.sparkSession, purpose)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
