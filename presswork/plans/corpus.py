"""The corpus jobs: collect, label, split, train."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import config
from presswork.config import label_key, stage_keys
from presswork.functions.text import compose_text, non_blank
from presswork.operators import labelling, metrics, splits
from presswork.operators.discover import discover
from presswork.operators.inference import Stage
from presswork.operators.ingest import IngestRun, history_keys, run_funnel
from presswork.operators.scoring import widen_in_row
from presswork.operators.train import MultiLabelModel, fit_multilabel, predict_multilabel
from presswork.session import stage
from presswork.sources import tables
from presswork.sources.config import SourceConfig
from presswork.sources.tables import require_columns


def collect(
    sources: SourceConfig, pages: DataFrame, docs: DataFrame, articles: DataFrame | None = None,
    scraped_at: Column | None = None,
) -> IngestRun:
    """Discover candidate URLs, take their stored pages and run the funnel against earlier articles."""
    urls, hashes = history_keys(articles, unique=False) if articles is not None else (None, None)
    found = discover(sources.sites, pages, docs, urls, sources.limits)
    candidates = pages.join(found.select("url"), "url", "left_semi")
    return run_funnel(candidates, sources.keywords, sources.limits, history_urls=urls,
                      history_hashes=hashes, scraped_at=scraped_at)


def label_articles(
    articles: DataFrame, stage1: Stage, stage2: Stage, key: str = "id",
    gate_threshold: float = config.GATE_THRESHOLD, binary_threshold: float = config.BINARY_THRESHOLD,
) -> DataFrame:
    """Articles with stage-1 and stage-2 probabilities and binary labels.

    One pass: the second stage sees rows over the gate only, and other rows score 0.0;
    rows without a gate score are left out.  The result is written once, since scores are expensive.
    """
    require_columns(articles, [key, "content"])
    rows = articles.where(non_blank(F.col("content"))).withColumn("_all", F.lit(True))
    scored = stage1(rows, "content", "_s1", "_all")
    wide = _named(scored, "_s1", "stage1").drop("_all", "_s1")
    gated = wide.where(F.col(labelling.GATE_COLUMN).isNotNull()).withColumn(
        "_gated", F.col(labelling.GATE_COLUMN) >= gate_threshold
    )
    both = _named(stage2(gated, "content", "_s2", "_gated"), "_s2", "stage2").drop("_gated", "_s2")
    both = both.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in stage_keys("stage2")})
    return stage(labelling.binarize(both, [*stage_keys("stage1"), *stage_keys("stage2")], binary_threshold), "labelled")


def _named(df: DataFrame, scores: str, stage_name: str) -> DataFrame:
    """In-row scores to wide columns, matched by label name."""
    return widen_in_row(df, config.stage_labels(stage_name), "_w_", scores).withColumnsRenamed(
        {f"_w_{name}": label_key(name, stage_name) for name in config.stage_labels(stage_name)}
    )


def label_splits(binary: DataFrame, key: str = "id", minimum: int = 0) -> dict[str, DataFrame]:
    """Stage-1 split of all articles and stage-2 split of gated ones; fewer gated rows than ``minimum`` are an error."""
    ones = [labelling.binary_name(c) for c in stage_keys("stage1")]
    twos = [labelling.binary_name(c) for c in stage_keys("stage2")]
    out = {"stage1": splits.split_columns(splits.split_random(binary, key), "content", ones)}
    gated = binary.where(F.col(labelling.binary_name(labelling.GATE_COLUMN)) == 1)
    if minimum and not splits.enough_rows(gated, minimum):
        raise ValueError(f"fewer than {minimum} gated rows")
    out["stage2"] = splits.split_columns(splits.split_random(gated, key), "content", twos)
    return out


def single_label_splits(articles: DataFrame, flags: DataFrame, flag_order: str, key: str = "id") -> dict[str, DataFrame]:
    """The single-label data set (stratified) and the issue data set of gate-category articles."""
    text = articles.withColumn("text", compose_text(F.col("title"), F.col("content")))
    main = text.select(key, "text", "label").na.drop("any")
    main = splits.split_stratified(main, key, "label").select("text", "label", "split")
    gated = text.where(F.col("label") == config.GATE_CATEGORY)
    issues = labelling.attach_flags(gated, flags, config.ISSUES, flag_order, key)
    issues = splits.split_random(issues.select(key, "text", *config.ISSUES), key, order="halves")
    return {"main": main, "issues": splits.split_columns(issues, "text", config.ISSUES)}


def results_table(results: dict[str, StageResult], stage_name: str) -> DataFrame:
    """Metric rows of several trained models of a stage, in the order given, for comparison and for the best pick."""
    parts = [
        r.metrics.select(
            F.lit(stage_name).alias("stage"), F.lit(pos).alias("pos"), F.lit(name).alias("model"),
            F.lit(r.seconds).alias("training_time"), "split", "micro_f1", "macro_f1", "hamming_loss")
        for pos, (name, r) in enumerate(results.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def results_document(results: DataFrame, stage_name: str, labels: Sequence[str]) -> DataFrame:
    """The nested result document of a stage from its metric rows; times in minutes."""
    wide = metrics.compare_models(results)

    def group(split: str) -> Column:
        return F.struct(*[F.col(f"{split}_{m}").alias(m) for m in ("micro_f1", "macro_f1", "hamming_loss")])

    rows = wide.select(
        "pos", F.col("model").alias("name"), (F.col("training_time") / 60).alias("training_time_minutes"),
        group("val").alias("val_metrics"), group("test").alias("test_metrics"))
    return tables.results_document(rows, stage_name, labels)


@dataclass
class StageResult:
    """A trained stage: the model, its wall time and its metrics per split."""

    model: MultiLabelModel
    seconds: float
    metrics: DataFrame


def train_stage(
    data: DataFrame, labels: Sequence[str], text: str = "content", split: str = "split", **options
) -> StageResult:
    """Fit on the train rows and evaluate on validation and test rows in one pass."""
    started = time.time()
    model = fit_multilabel(data.where(F.col(split) == "train"), labels, text, **options)
    seconds = time.time() - started
    held_out = predict_multilabel(data.where(F.col(split) != "train"), model, text)
    pairs = metrics.metric_pairs(held_out, {x: f"pred_{x}" for x in labels}, [split])
    return StageResult(model, seconds, metrics.multilabel_metrics(pairs, [split]))
