"""Trainer state files: one JSON object with a list of log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("step", T.LongType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in (
            "epoch",
            "loss",
            "learning_rate",
            "grad_norm",
            "eval_accuracy",
            "eval_f1_positive_class",
            "eval_f1_weighted",
            "eval_loss",
            "eval_precision_weighted",
            "eval_recall_weighted",
            "eval_runtime",
            "eval_samples_per_second",
            "eval_steps_per_second",
        )
    ]
)
SCHEMA = T.StructType(
    [
        T.StructField("best_metric", T.DoubleType()),
        T.StructField("num_train_epochs", T.LongType()),
        T.StructField("log_history", T.ArrayType(EVENT)),
    ]
)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per log event; training and evaluation events side by side.

    ``run`` is the folder of the event's file, so that the logs of several runs, read by a pattern
    or a parent folder, stay apart.
    """
    state = spark.read.schema(SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)
    run = F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1)
    return state.select(run.alias("run"), F.inline("log_history"))


def evaluations(log: DataFrame) -> DataFrame:
    return log.filter(F.col("eval_accuracy").isNotNull())
