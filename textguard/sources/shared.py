"""Where jobs put what several tasks or a later step must read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a folder of its warehouse, which
    a session's executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name in shared storage."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """The rows written once to shared storage, for plans that read them several times."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(rows.sparkSession))
    return rows.checkpoint()


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet to shared storage and read back, so that their size is known."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
