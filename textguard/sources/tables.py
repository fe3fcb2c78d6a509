"""Message and labelled-text tables, and the verdict sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.plans.guard import step_log

#: Of the files of :func:`write_guarded`, which repeat a message's text in several columns.
COMPRESSION = "zstd"
MESSAGE_SCHEMA = T.StructType(
    [T.StructField("msg_id", T.LongType()), T.StructField("text", T.StringType())]
)
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def turn_id() -> Column:
    """A turn's message id, ``conv_id:turn``: no two turns share one, whatever their numbers."""
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows dealt to as many pieces as the session's ``spark.textguard.scanPartitions`` names.

    Without that setting the scan's own splits hold, as ``spark.sql.files.maxPartitionBytes``
    makes them; it is meant for tables of one small file.
    """
    pieces = rows.sparkSession.conf.get("spark.textguard.scanPartitions", None)
    return rows.repartition(int(pieces)) if pieces else rows


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_messages(spark: SparkSession, path: str, key: str, *extra: str) -> DataFrame:
    """``(msg_id, text, extra…)`` from a parquet table; other columns are never read."""
    table = spark.read.parquet(path)
    return table.select(F.col(key).alias("msg_id"), "text", *extra)


def stream_messages(
    spark: SparkSession, path: str, schema: T.StructType, key: str, *extra: str
) -> DataFrame:
    """The same columns as files arrive under ``path``."""
    table = spark.readStream.schema(schema).parquet(path)
    return table.select(F.col(key).alias("msg_id"), "text", *extra)


def read_labelled(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, text, label)`` for documents that carry a label."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return documents.select("doc_id", "text").join(chosen, "doc_id")


def write_verdicts(guarded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per verdict. Few verdicts, so tasks keep at most that many files open."""
    guarded.write.mode(mode).partitionBy("verdict").parquet(path)


def write_guarded(guarded: DataFrame, folder: str, batch: int = 0) -> None:
    """Writes a guarded batch as verdicts and as a step log, one row for each step of a message.

    ``folder`` gets ``verdicts`` (a folder for each verdict below its batch) and ``steps``. The plan
    runs once; a batch that is written again replaces its own files and no others. Every text is written
    once as a verdict's column: the log is told from the written verdicts, not held beside them.
    """
    plain, home = guarded.drop("step_log"), f"{folder}/verdicts/batch={batch}"
    plain.write.mode("overwrite").partitionBy("verdict").parquet(home, compression=COMPRESSION)
    told = guarded.sparkSession.read.schema(plain.schema).parquet(home).select("msg_id", step_log().alias("_log"))
    steps = told.select("msg_id", F.posexplode("_log").alias("nth", "_step")).select("msg_id", "nth", "_step.*")
    steps.write.mode("overwrite").parquet(f"{folder}/steps/batch={batch}", compression=COMPRESSION)


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/verdicts")


def read_step_log(spark: SparkSession, folder: str) -> DataFrame:
    """``(msg_id, nth, step, status, message, batch)``, ``nth`` from 0 in the order of the steps."""
    return spark.read.parquet(f"{folder}/steps")
