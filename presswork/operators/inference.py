"""Two-stage scoring of texts, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork import config
from presswork.functions.text import input_error, percent_1dp, preview
from presswork.operators.rows import array_rows
from presswork.operators.scoring import Lexicon, Scorer, score_labels, score_lexicon, top_label
from presswork.operators.train import MultiLabelModel, predict_multilabel

# A stage adds an array of (label, score) named ``out``, NULL where the boolean column ``where`` is not true.
Stage = Callable[[DataFrame, str, str, str], DataFrame]


def lexicon_stage(lexicon: Lexicon, max_chars: int | None = None) -> Stage:
    def run(df: DataFrame, text: str, out: str, where: str) -> DataFrame:
        scored = score_lexicon(df, lexicon, text, out, max_chars)
        return scored.withColumn(out, F.when(F.col(where), F.col(out)))

    return run


def model_stage(model: MultiLabelModel, display: dict[str, str] | None = None) -> Stage:
    """A fitted model as a stage; ``display`` renames labels by name."""

    def run(df: DataFrame, text: str, out: str, where: str) -> DataFrame:
        scored = predict_multilabel(df, model, text, out).select(*df.columns, out)
        if display:
            names = F.create_map(*[F.lit(x) for pair in display.items() for x in pair])
            scored = scored.withColumn(out, F.transform(out, lambda s: F.struct(
                F.coalesce(F.try_element_at(names, s["label"]), s["label"]).alias("label"),
                s["score"].alias("score"))))
        return scored.withColumn(out, F.when(F.col(where), F.col(out)))

    return run


def batch_stage(labels: Sequence[str], scorer: Scorer, max_chars: int | None = None,
                batch: int = 128) -> Stage:
    """A batch model as a stage; only chosen rows reach it."""

    def run(df: DataFrame, text: str, out: str, where: str) -> DataFrame:
        scored = score_labels(df, labels, scorer, text, out, max_chars, batch, "null", where)
        return scored.drop("score_error")

    return run


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def top_category(scores: Column) -> Column:
    """``struct<category, confidence>`` of the best label; the first one wins a tie."""
    best = top_label(scores)
    return F.struct(best["label"].alias("category"), best["score"].alias("confidence"))


def top_category_long(long: DataFrame, key: str) -> DataFrame:
    """The same from long scores; the window holds one row per label."""
    ranked = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("pos"))
    return (
        long.withColumn("_rank", F.row_number().over(ranked))
        .where("_rank = 1")
        .select(key, F.col("label").alias("category"), F.col("score").alias("confidence"))
    )


def threshold_labels(scores: Column, threshold: float = config.DECISION_THRESHOLD) -> Column:
    """Labels at or over the threshold, in label order."""
    return F.transform(F.filter(scores, lambda s: s["score"] >= threshold), lambda s: s["label"])


def ranked_labels(scores: Column) -> Column:
    """All labels by score, highest first; label order within a tie."""
    indexed = F.transform(
        scores, lambda s, i: F.struct((-s["score"]).alias("neg"), i.alias("pos"), s["label"].alias("label"),
                                      s["score"].alias("score")))
    return F.transform(
        F.array_sort(indexed), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("probability")))


def issue_scores(scores: Column) -> Column:
    """Label to score map."""
    return F.map_from_entries(scores)


def issue_flags(df: DataFrame, key: str, scores: str = "scores",
                threshold: float = config.DECISION_THRESHOLD) -> DataFrame:
    """Per row and label, highest score first: rank, percentage with one decimal, detected or safe."""
    return array_rows(df, [key], ranked_labels(F.col(scores)), "_s", "rank").select(
        key,
        "rank",
        F.col("_s.label").alias("label"),
        percent_1dp(F.col("_s.probability")).alias("pct"),
        F.when(F.col("_s.probability") >= threshold, "detected").otherwise("safe").alias("status"),
    )


def predict_labels(df: DataFrame, stage: Stage, text: str = "text",
                   threshold: float = config.DECISION_THRESHOLD, out: str = "prediction") -> DataFrame:
    """Multi-label prediction of one stage: decisions, probabilities, labels and all pairs."""
    scored = stage(df.withColumn("_all", F.lit(True)), text, "_scores", "_all")
    s = F.col("_scores")
    return scored.withColumn(out, F.struct(
        F.transform(s, lambda x: (x["score"] >= threshold).cast("int")).alias("predictions"),
        F.transform(s, lambda x: x["score"]).alias("probabilities"),
        threshold_labels(s, threshold).alias("predicted_labels"),
        ranked_labels(s).alias("all_labels_with_probs"),
        preview(F.col(text)).alias("text_preview"),
    )).drop("_scores", "_all")


def analyze(
    df: DataFrame,
    stage1: Stage,
    stage2: Stage | None,
    gate: str | None = config.GATE_CATEGORY,
    text: str = "text",
) -> DataFrame:
    """Add ``category``, ``confidence``, ``ethics`` (label to score) and ``error``.

    Too short input gets an error and no scores.  The second stage scores the rows
    whose category is the gate, or all valid rows with ``gate=None``; other rows,
    and all rows when there is no second stage, get a NULL map.  A single pass: the
    gate is a column that the stage reads, not a split and a join.
    """
    df = df.withColumn("error", input_error(F.col(text))).withColumn("_valid", F.col("error").isNull())
    df = stage1(df, text, "_stage1", "_valid")
    best = top_category(F.col("_stage1"))
    df = df.withColumn("category", best["category"]).withColumn("confidence", best["confidence"])
    failed = F.col("_valid") & F.col("_stage1").isNull()
    in_gate = F.col("category").isNotNull() if gate is None else F.coalesce(F.col("category") == gate, F.lit(False))
    df = df.withColumn("_gated", in_gate)
    if stage2 is None:
        df = df.withColumn("_stage2", F.lit(None).cast("array<struct<label:string,score:double>>"))
    else:
        df = stage2(df, text, "_stage2", "_gated")
        failed = failed | (F.col("_gated") & F.col("_stage2").isNull())
    return (
        df.withColumn("ethics", issue_scores(F.col("_stage2")))
        .withColumn("error", F.when(failed, F.lit(config.SCORING_ERROR)).otherwise(F.col("error")))
        .drop("_valid", "_stage1", "_gated", "_stage2")
    )
