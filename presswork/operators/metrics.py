"""Multi-label evaluation over already binary predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_pairs(df: DataFrame, truth: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Wide truth/prediction columns to ``by..., label, y, p`` rows; ``truth`` maps label column to prediction column."""
    rows = F.array(*[
        F.struct(F.lit(y).alias("label"), F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p"))
        for y, p in truth.items()
    ])
    return df.select(*by, F.inline(rows))


def confusion(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: true positives, false positives, false negatives and rows."""
    y, p = F.col("y") == 1, F.col("p") == 1
    return pairs.groupBy(*by, "label").agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1, 0 where nothing is true and nothing is predicted."""
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def per_label_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(pairs, by).select(
        *by, "label", "tp", "fp", "fn",
        _ratio(1.0 * tp, tp + fp).alias("precision"),
        _ratio(1.0 * tp, tp + fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
    )


def multilabel_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro F1, macro F1 and Hamming loss; one pass, then one row per label."""
    counts = confusion(pairs, by)
    return counts.groupBy(*by).agg(
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
        _ratio(1.0 * (F.sum("fp") + F.sum("fn")), F.sum("n")).alias("hamming_loss"),
    )


def compare_models(results: DataFrame) -> DataFrame:
    """``stage, pos, model, training_time, split, micro_f1, macro_f1, hamming_loss`` to one row per model."""
    metrics = ["micro_f1", "macro_f1", "hamming_loss"]
    wide = results.groupBy("stage", "pos", "model", "training_time").pivot("split", ["val", "test"]).agg(
        *[F.first(m).alias(m) for m in metrics]
    )
    return wide


def best_model(results: DataFrame) -> DataFrame:
    """The model of each stage with the best test micro F1; the first one wins a tie."""
    ranked = Window.partitionBy("stage").orderBy(F.desc("micro_f1"), F.asc("pos"))
    return (
        results.where("split = 'test'")
        .withColumn("_rank", F.row_number().over(ranked))
        .where("_rank = 1")
        .drop("_rank", "split")
    )
