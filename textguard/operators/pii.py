"""Personal-data spans, redaction and audit counts over message tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import redact as R
from textguard.operators import spans as SP

SPANS = "array<struct<start:int,end:int,label:string>>"


def pii_spans(messages: DataFrame, key: str = "msg_id", text: str = "text") -> DataFrame:
    """One row per match: ``(key, start, end, label, value)``, offsets from 0.

    Offsets are running sums of piece lengths. Only texts that hold a match are
    shuffled, and of those only the pieces' lengths.
    """
    column = F.col(text)
    pieces = (
        messages.select(
            key, R.find_gaps(column).alias("gaps"), R.find_matches(column).alias("matches")
        )
        .filter(F.size("matches") > 0)
        .select(
            key,
            F.posexplode(
                F.arrays_zip(
                    F.transform(
                        F.slice("gaps", F.lit(1), F.size("matches")), F.length
                    ).alias("gap"),
                    F.col("matches").alias("value"),
                )
            ).alias("pos", "piece"),
        )
        .select(
            key,
            "pos",
            F.col("piece.gap").alias("gap"),
            F.col("piece.value").alias("value"),
        )
    )
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(so_far)
    return pieces.select(key, "value", size.alias("_size"), end.alias("end")).select(
        key,
        (F.col("end") - F.col("_size")).alias("start"),
        "end",
        R.match_label(F.col("value")).alias("label"),
        "value",
    )


def merge_touching(
    spans: DataFrame, key: str = "msg_id", aggregate: bool = True
) -> DataFrame:
    """Merges touching or overlapping span rows: ``(key, start, end, label, n)``.

    Islands over the running maximum end, so nested spans are covered too. With
    ``aggregate=False`` spans of different types stay apart.
    """
    by = [key] if aggregate else [key, "label"]
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(
        key,
        "start",
        "end",
        "label",
        F.when(F.col("start") <= reach, 0).otherwise(1).alias("opens"),
    ).withColumn("island", F.sum("opens").over(order))
    return (
        opened.groupBy(*by, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            *([] if not aggregate else [F.min_by("label", "start").alias("label")]),
            F.count("*").alias("n"),
        )
        .select(key, "start", "end", "label", "n")
    )


def redact(
    messages: DataFrame, text: str = "text", aggregate: bool = True, out: str = "redacted"
) -> DataFrame:
    """Adds the masked text and whether it differs from the text."""
    masked = messages.withColumn(out, R.mask_pii(F.col(text), aggregate))
    return masked.withColumn("changed", F.col(out) != F.coalesce(F.col(text), F.lit("")))


def count_by_type(messages: DataFrame, text: str = "text") -> DataFrame:
    """``(label, n)``: matches per type over all messages, without offsets."""
    found = messages.select(F.explode(R.find_matches(F.col(text))).alias("value"))
    return (
        found.select(R.match_label(F.col("value")).alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def redact_names(
    messages: DataFrame,
    names: DataFrame,
    key: str = "msg_id",
    text: str = "text",
    out: str = "redacted",
) -> DataFrame:
    """Masks the names of ``names(name)``, of any number of words, ignoring case; NULL stays NULL."""
    found = SP.with_names(messages, names, key, text, "_names")
    kept = [F.col(f"`{c}`") for c in messages.columns]
    done = SP.mask_united(found, text, "_masked", F.col("_names"), patterns=False)
    return done.select(*kept, F.when(F.col(f"`{text}`").isNotNull(), F.col("_masked")).alias(out))


def tag_with(
    messages: DataFrame,
    tagger: Callable[[pd.Series], pd.Series],
    text: str = "text",
    out: str = "spans",
    wanted: Column | None = None,
) -> DataFrame:
    """Adds spans from a user's tagger, run on Arrow batches.

    ``tagger`` maps a series of texts to a series of lists of ``{start, end, label}``.
    Rows outside ``wanted`` reach it as NULL, since a condition around a Python
    function does not keep it from running.
    """
    run = F.pandas_udf(tagger, SPANS)
    column = F.col(text) if wanted is None else F.when(wanted, F.col(text))
    return messages.withColumn(out, run(column))
