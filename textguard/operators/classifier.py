"""Two-class text classifier on Spark ML: hashed tf-idf and logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import decisions as D
from textguard.operators.metrics import compute_metrics


def build_pipeline(
    text: str = "text",
    label: str = "label",
    features: int = 1 << 16,
    max_iter: int = 20,
    reg: float = 0.01,
) -> Pipeline:
    """Whole texts are scored; hashing fixes the model size whatever the vocabulary."""
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol=text,
                outputCol="_tokens",
                gaps=False,
                pattern="[\\p{L}\\p{N}]+",
            ),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg
            ),
        ]
    )


def train(rows: DataFrame, text: str = "text", label: str = "label", **settings) -> PipelineModel:
    """Fits on the given rows; every pass over them is a distributed aggregate."""
    return build_pipeline(text, label, **settings).fit(rows)


def score(
    rows: DataFrame, model: PipelineModel, text: str = "text", trained_on: str = "text"
) -> DataFrame:
    """Adds ``p0`` and ``p1``. NULL texts are scored NULL instead of failing the job."""
    fed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"),
        F.coalesce(F.col(text), F.lit("")).alias(trained_on),
    )
    scored = model.transform(fed).select("_row", vector_to_array("probability").alias("_p"))
    known = F.col(f"_row.{text}").isNotNull()
    return scored.select(
        "_row.*",
        F.when(known, F.col("_p")[0]).alias("p0"),
        F.when(known, F.col("_p")[1]).alias("p1"),
    )


def evaluate(rows: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """The metrics row of a model on labelled rows, by arg-max class."""
    scored = score(rows, model, text)
    return compute_metrics(
        scored.select("label", D.arg_max(F.array("p0", "p1")).alias("pred"))
    )


def model_scorer(model: PipelineModel, trained_on: str = "text"):
    """Scorer for the guard plan: adds ``p0`` and ``p1`` from a text column."""
    return lambda rows, text: score(rows, model, text, trained_on)


def word_list_scorer(words: list[str]):
    """Scorer for the guard plan that needs no training."""

    def run(rows: DataFrame, text: str) -> DataFrame:
        p1 = D.halving_score(D.listed_word_hits(F.col(text), words))
        return rows.withColumn("p1", p1).withColumn("p0", F.lit(1.0) - F.col("p1"))

    return run
