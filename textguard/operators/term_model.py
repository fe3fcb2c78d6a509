"""A two-class text classifier held as a table, trained, evaluated and applied by joins and sums.

A text is the set of its words; a word falls into one of ``SLOTS`` slots by its digest, so that the
model has a bounded size whatever the vocabulary. A slot's ``ratio`` is the smoothed log of how much
more often hostile training texts hold its words than benign ones; a text's features are its words'
ratios, scaled to length one, and a constant. Weights on them are fitted by logistic regression:
whole-batch steps with momentum, each slot's step divided by its curvature.

Training evaluates after each epoch on the eval part, writes the log, stops when the metric has not
been beaten for some epochs, and keeps the weights of the best one. Each epoch is two joins and two
sums over the training words, whatever their number; the driver sees one row of metrics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import decisions as D
from textguard.operators import metrics as M
from textguard.operators.training_data import tokens
from textguard.sources.shared import shared_folder, written

SLOTS = 1 << 16
#: The slot of the constant feature.
CONSTANT = -1
#: What the loss takes a smaller probability for.
LEAST_PROBABILITY = 1e-15
METRICS = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "f1_positive_class")


@dataclass(frozen=True)
class Training:
    """How long and how fast to train."""

    epochs: int = 8
    step: float = 0.5
    momentum: float = 0.5
    damping: float = 1e-3
    patience: int = 3
    metric: str = "f1_positive_class"


@dataclass(frozen=True)
class TermModel:
    """``weights(slot, ratio, weight)``: one row a slot that training texts use, and the constant."""

    weights: DataFrame

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermModel:
        return TermModel(spark.read.parquet(path))


def slot_of(word: Column) -> Column:
    """The first 16 bits of the word's MD5 digest."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int")


def words_by_slot(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """``(kept…, slot)``: one row for each distinct word of a text."""
    names = [F.col(f"`{k}`") for k in kept]
    words = rows.select(*names, F.explode(F.array_distinct(tokens(F.col(f"`{text}`")))).alias("word"))
    return words.select(*names, slot_of(F.col("word")).alias("slot"))


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _features(rows: DataFrame, key: str, text: str, purpose: str) -> tuple[DataFrame, DataFrame]:
    """``(key, label, is_eval, slot, x)`` and ``(slot, ratio)``, both written."""
    words = written(words_by_slot(rows, text, key, "label", "is_eval"), f"{purpose}-words")
    sizes = rows.where("not is_eval").agg(F.count_if(F.col("label") == 1).alias("hostile"), F.count_if(F.col("label") == 0).alias("benign"))
    size = sizes.first()

    def share(label: int, total: int) -> Column:
        return F.log((F.count_if(F.col("label") == label) + 1) / F.lit(float(total + 2)))

    ratios = words.where("not is_eval").groupBy("slot").agg(
        (share(1, size["hostile"]) - share(0, size["benign"])).alias("ratio")
    )
    ratios = written(ratios, f"{purpose}-ratios")
    known = words.join(ratios, "slot")
    norms = known.groupBy(key).agg(F.sqrt(F.sum(F.col("ratio") * F.col("ratio"))).alias("norm")).where("norm > 0")
    scaled = known.join(norms, key).select(key, "label", "is_eval", "slot", (F.col("ratio") / F.col("norm")).alias("x"))
    constant = rows.select(key, "label", "is_eval", F.lit(CONSTANT).alias("slot"), F.lit(1.0).alias("x"))
    return written(scaled.unionByName(constant), f"{purpose}-features"), ratios


def _predict(features: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    margins = features.join(weights.select("slot", "weight"), "slot").groupBy(key, "label", "is_eval").agg(
        F.sum(F.col("x") * F.col("weight")).alias("margin")
    )
    return margins.select(key, "label", "is_eval", probability(F.col("margin")).alias("p1"))


def _events(epoch: int, predicted: DataFrame) -> list[dict]:
    """A training and an evaluation event, as trainers log them, from one pass."""
    p, hostile = F.col("p1"), F.col("label") == 1
    sure = F.greatest(F.when(hostile, p).otherwise(1 - p), F.lit(LEAST_PROBABILITY))
    judged = predicted.select("is_eval", "label", D.arg_max(F.array(1 - p, p)).alias("pred"), F.log(sure).alias("fit"))
    told = M.compute_metrics(judged, ["is_eval"], (-F.avg("fit")).alias("loss")).collect()
    by_part = {row["is_eval"]: row.asDict() for row in told}
    evaluation = by_part.get(True, {"loss": None})
    metrics = {f"eval_{name}": evaluation.get(name, 0.0) for name in METRICS}
    return [
        {"epoch": float(epoch), "step": epoch, "loss": by_part.get(False, {}).get("loss")},
        {"epoch": float(epoch), "step": epoch, "eval_loss": evaluation["loss"], **metrics},
    ]


@dataclass(frozen=True)
class Trained:
    """The best epoch's model, and the log of all epochs that ran."""

    model: TermModel
    log: list[dict]
    best_step: int
    best_metric: float


def train_with_evaluation(
    rows: DataFrame, key: str = "doc_id", text: str = "text", settings: Training = Training()
) -> Trained:
    """Trains on ``rows(key, text, label, is_eval)`` and keeps the best epoch by the eval part.

    Rows without a text or label are left out. Without eval rows every epoch scores 0 and the
    first is kept; without training rows the model is empty and every score one half.
    """
    known = rows.where(F.col(text).isNotNull() & F.col("label").isNotNull() & F.col("is_eval").isNotNull())
    known = written(known.select(key, text, "label", "is_eval"), "term-model-rows")
    features, ratios = _features(known, key, text, "term-model")
    training = features.where("not is_eval").select(key, "slot", "x")
    count = max(known.where("not is_eval").count(), 1)
    curve = training.groupBy("slot").agg((F.lit(0.25) * F.sum(F.col("x") * F.col("x")) / count).alias("curve"))
    weights = curve.select("slot", "curve", F.lit(0.0).alias("velocity"), F.lit(0.0).alias("weight"))
    weights = written(weights, "term-model-epoch-0")
    predicted = known.select(key, "label", "is_eval", F.lit(0.5).alias("p1"))

    log, best, kept, stale = [], -1.0, weights, 0
    best_step = 0
    for epoch in range(1, settings.epochs + 1):
        errors = predicted.where("not is_eval").select(key, (F.col("p1") - F.col("label")).alias("error"))
        slopes = training.join(errors, key).groupBy("slot").agg((F.sum(F.col("x") * F.col("error")) / count).alias("slope"))
        velocity = settings.momentum * F.col("velocity") - settings.step * F.col("slope") / (F.col("curve") + settings.damping)
        moved = weights.join(slopes, "slot").select("slot", "curve", velocity.alias("velocity"), "weight")
        moved = moved.withColumn("weight", F.col("weight") + F.col("velocity"))
        weights = written(moved, f"term-model-epoch-{epoch}")
        predicted = _predict(features, weights, key)
        log += _events(epoch, predicted)
        metric = log[-1][f"eval_{settings.metric}"]
        if metric > best:
            best, best_step, kept, stale = metric, epoch, weights, 0
        else:
            stale += 1
        if stale >= settings.patience:
            break
    found = kept.join(ratios, "slot", "left").select("slot", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), "weight")
    return Trained(TermModel(written(found, "term-model")), log, best_step, best)


def write_log(spark: SparkSession, trained: Trained, path: str, settings: Training = Training()) -> None:
    """The log as one file in the shape of trainers' state files, in the folder of the run."""
    state = {"best_metric": trained.best_metric, "num_train_epochs": settings.epochs, "log_history": trained.log}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def score(rows: DataFrame, model: TermModel, key: str, text: str = "text") -> DataFrame:
    """``(key, p0, p1)``: one row for each row whose text is not NULL. ``key`` must tell rows apart.

    Words meet the model by slot, at most ``SLOTS`` rows, and a text's words sit in one task, so that
    the shuffle by key carries one row of sums for each text.
    """
    texts = rows.where(F.col(f"`{text}`").isNotNull())
    weighed = words_by_slot(texts, text, key).join(model.weights.where(F.col("slot") != CONSTANT), "slot")
    sums = weighed.groupBy(key).agg(
        F.sum(F.col("ratio") * F.col("weight")).alias("_dot"), F.sum(F.col("ratio") * F.col("ratio")).alias("_square")
    )
    constant = model.weights.where(F.col("slot") == CONSTANT).agg(F.coalesce(F.max("weight"), F.lit(0.0))).scalar()
    every = texts.select(key).join(sums, key, "left")
    margin = F.coalesce(F.try_divide("_dot", F.sqrt("_square")), F.lit(0.0)) + constant
    return every.select(key, probability(margin).alias("p1")).select(key, (1 - F.col("p1")).alias("p0"), "p1")


def evaluate(rows: DataFrame, model: TermModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The metrics row of a model on labelled rows, by arg-max class."""
    scored = score(rows, model, key, text).join(rows.select(key, "label"), key)
    return M.compute_metrics(scored.select("label", D.arg_max(F.array("p0", "p1")).alias("pred")))


def term_scorer(model: TermModel, key: str = "msg_id"):
    """Scorer for the guard plan: adds ``p0`` and ``p1`` by a join on ``key``."""

    def run(rows: DataFrame, text: str) -> DataFrame:
        return rows.join(score(rows.select(key, text), model, key, text), key, "left")

    return run
