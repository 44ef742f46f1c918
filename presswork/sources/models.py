"""Saved models: the pipeline with its label list beside it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from presswork.operators.train import MultiLabelModel

LABELS = "labels array<string>, constants map<string,double>"


def save_model(model: MultiLabelModel, path: str, spark: SparkSession) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    row = spark.createDataFrame([(model.labels, model.constants)], LABELS)
    row.write.mode("overwrite").json(f"{path}/labels")


def load_model(path: str, spark: SparkSession) -> MultiLabelModel:
    """Loading checks that the label list fits the number of models."""
    row = spark.read.schema(LABELS).json(f"{path}/labels").first()
    return MultiLabelModel(PipelineModel.load(f"{path}/pipeline"), list(row["labels"]), dict(row["constants"] or {}))
