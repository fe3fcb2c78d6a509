"""The guard plan on a stream of messages.

The plan has no aggregation and keeps no state: rows meet static tables only, so there
is no watermark, and the file sink with its checkpoint writes each message once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textguard.plans.guard import GuardTables, Scorer, guard
from textguard.sources.tables import write_guarded


def start_guard(
    messages: DataFrame,
    tables: GuardTables,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    available_now: bool = False,
    **settings,
) -> StreamingQuery:
    """Starts writing verdict rows to ``output``, one folder per verdict.

    Both paths must lie in storage all executors share.
    """
    writer = (
        guard(messages, tables, scorer, **settings)
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("verdict")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_logged_guard(
    messages: DataFrame,
    tables: GuardTables,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    available_now: bool = False,
    **settings,
) -> StreamingQuery:
    """Guards each micro-batch as a batch and writes its verdicts and its step log.

    A batch that is run again after a failure replaces its own files, so that each message is
    written once. As batches are guarded on their own, scorers and masks that join or count may be
    used here.
    """

    def guard_batch(batch: DataFrame, number: int) -> None:
        write_guarded(guard(batch, tables, scorer, **settings), output, number)

    writer = messages.writeStream.foreachBatch(guard_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
