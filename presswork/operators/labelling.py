"""Scores to labels: gate, combine, binarize, attach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import config
from presswork.config import stage_keys
from presswork.operators.dedup import last_wins

GATE_COLUMN = "stage1_artificial_intelligence"


def in_gate(df: DataFrame, column: str = GATE_COLUMN, threshold: float = config.GATE_THRESHOLD) -> DataFrame:
    """Rows at or over the threshold; a NULL score is on neither side."""
    return df.where(F.col(column) >= threshold)


def out_of_gate(df: DataFrame, column: str = GATE_COLUMN, threshold: float = config.GATE_THRESHOLD) -> DataFrame:
    return df.where(F.col(column) < threshold)


def gate_counts(df: DataFrame, column: str = GATE_COLUMN, threshold: float = config.GATE_THRESHOLD) -> DataFrame:
    """One row: rows inside and outside the gate."""
    return df.agg(
        F.count_if(F.col(column) >= threshold).alias("inside"),
        F.count_if(F.col(column) < threshold).alias("outside"),
    )


def combine_stages(stage1: DataFrame, stage2: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stage-1 rows with their stage-2 scores, 0.0 for rows outside the gate.

    One left join replaces the two-way split and union.  Rows with a NULL gate
    score belong to neither part and are left out.
    """
    names = list(columns or stage_keys("stage2"))
    joined = stage1.where(F.col(GATE_COLUMN).isNotNull()).join(stage2.select(key, *names), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})


def binary_name(column: str) -> str:
    stage, rest = column.split("_", 1)
    return f"{stage}_binary_{rest}"


def binarize(df: DataFrame, columns: Sequence[str], threshold: float = config.BINARY_THRESHOLD) -> DataFrame:
    """Add a 0/1 column per probability column; the threshold is inclusive."""
    return df.withColumns(
        {binary_name(c): F.coalesce((F.col(c) >= threshold).cast("int"), F.lit(0)) for c in columns}
    )


def label_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns with a prefix, sorted by name; decided on the schema, without a job."""
    return sorted(c for c in df.columns if c.startswith(prefix))


def attach_flags(articles: DataFrame, flags: DataFrame, labels: Sequence[str], order: str,
                 key: str = "id", field: str = "_ai_ethics_binary") -> DataFrame:
    """Add one int column per label from a side table of label maps.

    The last row of a repeated id wins; a missing id or label counts as 0.
    """
    latest = last_wins(flags.select(key, field, order), [key], [order]).drop(order)
    joined = articles.join(latest, key, "left")
    return joined.withColumns(
        {name: F.coalesce(F.try_element_at(F.col(field), F.lit(name)), F.lit(0)) for name in labels}
    ).drop(field)


def combination(df_columns: Sequence[str], display: Sequence[str]) -> Column:
    """Names of the set labels joined by ', ', or the no-labels text."""
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(d)) for c, d in zip(df_columns, display)]))
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit(config.NO_LABELS))
