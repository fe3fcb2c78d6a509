"""Ranks over a whole table, or over a few large groups, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.sources.shared import written

#: Rows of a task that the lower bits of its row numbers count.
_ROW_BITS = 33


def task_counts(held: DataFrame, groups: list[str]) -> DataFrame:
    """``(groups…, _task, _first, _size)``: where each group starts in each task, and its rows there.

    Tasks hold neighbouring ranges, so that there are about as many rows as tasks and groups.
    """
    return held.groupBy(*groups, F.shiftright("_spot", _ROW_BITS).alias("_task")).agg(
        F.min("_spot").alias("_first"), F.count("*").alias("_size")
    )


def grouped_rank(
    rows: DataFrame, groups: list[str], order: list[str], out: str = "rn"
) -> DataFrame:
    """Adds the 1-based rank of each row in its group by the columns ``order``, whatever their values.

    Spark samples the columns and deals the rows to tasks by ranges, so that a group of any size and
    any kind of key is spread evenly. Rows are counted inside their task, and moved on by the group's
    rows in earlier tasks; the table of those counts is all that one task ever sees of a group. The
    ranged rows are written once, as the counts must not change when a task is run again.
    """
    by = [*groups, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    held = written(ranged.withColumn("_spot", F.monotonically_increasing_id()), "ranked")
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("_task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.coalesce(F.sum("_size").over(before), F.lit(0))
    shifts = task_counts(held, groups).select(
        *groups, "_task", (earlier - F.col("_first") + 1).alias("_shift")
    )
    return (
        held.withColumn("_task", F.shiftright("_spot", _ROW_BITS))
        .join(shifts, [*groups, "_task"])
        .withColumn(out, F.col("_spot") + F.col("_shift"))
        .drop("_task", "_spot", "_shift")
    )
