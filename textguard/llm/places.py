"""Places of rows in the order of a whole table, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: Sequence[str], out: str, folder: str) -> DataFrame:
    """The rows with ``out``, their place from 0 in the order of the whole table.

    Rows that differ only by what is not in ``order`` may lie in several tasks.
    """
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts the rows of a task in its lower 33 bits and names the task in the others
    sorted_rows.withColumn("_spot", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
    placed = spark.read.parquet(folder)
    task = F.shiftright("_spot", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each task of the range shuffle
    return (
        placed.withColumn("_task", task)
        .join(F.broadcast(offsets), "_task")
        .withColumn(out, F.col("_before") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_task", "_before", "_spot")
    )
