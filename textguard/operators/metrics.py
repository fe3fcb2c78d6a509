"""Two-class metrics from one aggregation pass, and choices made over a metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """``(by…, tn, fp, fn, tp, more…)`` from columns ``label`` and ``pred``."""
    label, pred = F.col("label"), F.col("pred")
    return rows.groupBy(*(by or [])).agg(
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
        *more,
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _classes() -> list[tuple[Column, Column, Column]]:
    """(hits, false alarms, misses) of class 0 and class 1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [(tn, fn, fp), (tp, fp, fn)]


def _weighted(metric) -> Column:
    parts = [metric(h, a, m) * (h + m) for h, a, m in _classes()]
    return _ratio(parts[0] + parts[1], F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def accuracy() -> Column:
    return _ratio(
        F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    )


def f1_weighted() -> Column:
    return _weighted(lambda h, a, m: _ratio(2 * h, 2 * h + a + m))


def precision_weighted() -> Column:
    return _weighted(lambda h, a, m: _ratio(h, h + a))


def recall_weighted() -> Column:
    return _weighted(lambda h, a, m: _ratio(h, h + m))


def f1_positive_class() -> Column:
    h, a, m = _classes()[1]
    return _ratio(2 * h, 2 * h + a + m)


def compute_metrics(
    rows: DataFrame, by: list[str] | None = None, *more: Column
) -> DataFrame:
    """The five metrics, one row (or one per ``by`` group), and any ``more`` aggregates."""
    counted = confusion(rows, by, *more)
    return counted.select(
        *(by or []),
        accuracy().alias("accuracy"),
        f1_weighted().alias("f1_weighted"),
        precision_weighted().alias("precision_weighted"),
        recall_weighted().alias("recall_weighted"),
        f1_positive_class().alias("f1_positive_class"),
        *counted.columns[len(by or []) + 4 :],
    )


def best_step(
    log: DataFrame, metric: str, step: str = "step", by: list[str] | None = None
) -> DataFrame:
    """The earliest step with the best metric: ``(by…, best_step, best_metric)``."""
    return log.filter(F.col(metric).isNotNull()).groupBy(*(by or [])).agg(
        F.max_by(step, F.struct(F.col(metric), -F.col(step))).alias("best_step"),
        F.max(metric).alias("best_metric"),
    )


def early_stop_step(
    log: DataFrame, metric: str, patience: int = 3, step: str = "step", by: list[str] | None = None
) -> DataFrame:
    """The step training stops at: the first that ends ``patience`` evaluations in a row
    none of which beat the best before them; NULL when there is none.

    A metric log has one row per evaluation, few enough for one ordered window a run.
    """
    runs = by or []
    order = Window.partitionBy(*(runs or [F.lit(0)])).orderBy(step)
    before = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    judged = log.filter(F.col(metric).isNotNull()).select(
        *runs, step, F.coalesce(F.col(metric) > before, F.lit(True)).alias("better")
    )
    last = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = judged.withColumn("_rn", F.row_number().over(order)).select(
        *runs,
        step,
        (F.col("_rn") - F.max(F.when(F.col("better"), F.col("_rn"))).over(last)).alias(
            "stale"
        ),
    )
    return counted.groupBy(*runs).agg(
        F.min(F.when(F.col("stale") >= patience, F.col(step))).alias("stop_step")
    )
