"""Multi-label logistic regression: one binary model per label over shared features."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.text import tokenize
from presswork.operators.descent import blocks, fit_labels
from presswork.operators.features import fit_vocabulary, tfidf_pipeline, with_terms
from presswork.session import stage


@dataclass
class MultiLabelModel:
    """TF-IDF and label models as one pipeline; labels are matched by name.

    ``constants`` holds the probability of labels of which training saw one class only.
    """

    pipeline: PipelineModel
    labels: list[str]
    constants: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        fitted = sum(s.__class__.__name__ == "LogisticRegressionModel" for s in self.pipeline.stages)
        if fitted + len(self.constants) != len(self.labels):
            raise ValueError(f"{len(self.labels)} labels for {fitted} models and {len(self.constants)} constants")


def fit_multilabel(
    train: DataFrame,
    labels: Sequence[str],
    text: str = "content",
    *,
    size: int,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
    weight: str | None = None,
    partitions: int | None = None,
    **bounds,
) -> MultiLabelModel:
    """Fit TF-IDF and one unweighted L2 logistic regression per label on ``train``.

    The ``size`` most frequent terms are the features; they reach the driver, so the caller
    says how many.  The texts are tokenised once, into a written table of tokens that counting,
    vocabulary and features read; pairs of tokens are made where they are read.  All labels are fitted together, see ``fit_labels``: a
    pass over the feature blocks serves every label, and the objective is the loss sum plus
    ``|w|**2 / (2 c)`` with a free intercept.  A caller whose rows are few may name fewer
    ``partitions``.
    """
    columns = [*labels, *([weight] if weight else [])]
    spark = train.sparkSession
    tokens = stage(train.select(tokenize(F.col(text)).alias("_tokens"), *columns), "tokens")
    totals = tokens.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(x) for x in labels]).first()
    n = totals["_n"]
    constants = {x: 1.0 if n and totals[x] else 0.0 for x in labels if not n or totals[x] in (None, 0.0, float(n))}
    names, idf = fit_vocabulary(tokens, size, "_tokens", documents=n, pairs=True, **bounds)
    left = [x for x in labels if x not in constants]
    models = []
    if left:
        rows = blocks(tokens, names, idf, left, weight, column="_tokens", pairs=True)
        found = fit_labels(rows if partitions is None else rows.coalesce(partitions), len(names), len(left), c, tol, max_iter)
        models = [logistic_model(spark, x, found[:-1, k], float(found[-1, k])) for k, x in enumerate(left)]
    return MultiLabelModel(PipelineModel([*tfidf_pipeline(names, idf).stages, *models]), list(labels), constants)


def logistic_model(spark: SparkSession, label: str, weights: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """Spark's model of given weights, so that it is used, saved and loaded like one that Spark fitted."""
    java = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights)), intercept)
    model = LogisticRegressionModel(java)
    model.setFeaturesCol("features").setPredictionCol(f"_pred_{label}")
    model.setProbabilityCol(f"_prob_{label}").setRawPredictionCol(f"_raw_{label}")
    return model._set(labelCol=label)


def predict_multilabel(
    df: DataFrame, model: MultiLabelModel, text: str = "content", out: str = "scores"
) -> DataFrame:
    """Add in-row probabilities by label name and an int ``pred_<label>`` per label."""
    scored = model.pipeline.transform(with_terms(df, text))

    def score(label: str):
        if label in model.constants:
            return F.lit(model.constants[label])
        return vector_to_array(F.col(f"_prob_{label}"))[1]

    def decision(label: str):
        if label in model.constants:
            return F.lit(int(model.constants[label] > 0.5))
        return F.col(f"_pred_{label}").cast("int")

    pairs = [F.struct(F.lit(x).alias("label"), score(x).alias("score")) for x in model.labels]
    return scored.select(
        *[F.col(c) for c in df.columns],
        F.array(*pairs).alias(out),
        *[decision(x).alias(f"pred_{x}") for x in model.labels],
    )


def largest_weights(model: MultiLabelModel, n: int) -> list[tuple[str, str, float]]:
    """(label, term, weight): the ``n`` largest weights of each fitted label by their size."""
    terms = model.pipeline.stages[0].vocabulary
    fitted = {s.getLabelCol(): s.coefficients.toArray() for s in model.pipeline.stages if hasattr(s, "coefficients")}
    return [(label, terms[i], float(weights[i]))
            for label, weights in fitted.items() for i in abs(weights).argsort()[::-1][:n]]
