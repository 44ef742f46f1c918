"""Corpus statistics; each is one aggregate over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import config
from presswork.functions.text import percent
from presswork.operators.labelling import combination


def domain_counts(df: DataFrame, k: int | None = 20, domain: str = "domain") -> DataFrame:
    """Articles per domain, most first, name order within a tie."""
    counts = df.groupBy(domain).agg(F.count(F.lit(1)).alias("articles"))
    ordered = counts.orderBy(F.desc("articles"), F.asc(domain))
    return ordered if k is None else ordered.limit(k)


def domain_summary(df: DataFrame, k: int = 20, domain: str = "domain") -> DataFrame:
    """Distinct domains, all articles, and how many domains a top-k list leaves out."""
    return (
        df.groupBy(domain)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(domain).alias("domains"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("articles"),
            F.greatest(F.count(domain) - k, F.lit(0)).alias("more"),
        )
    )


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """``chars, docs``: map-side combined; bounded by the number of distinct lengths."""
    return df.select(length.alias("chars")).groupBy("chars").agg(F.count(F.lit(1)).alias("docs"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """Minimum, maximum, mean and rows."""
    return df.select(length.alias("n")).agg(
        F.min("n").alias("min_chars"),
        F.max("n").alias("max_chars"),
        F.try_divide(F.sum("n"), F.count("n")).alias("mean_chars"),
        F.count(F.lit(1)).alias("articles"),
    )


def length_profile(df: DataFrame, length: Column, limit: int = config.STAGE1_CHARS) -> DataFrame:
    """Mean, interpolated median, minimum, maximum and rows over a limit.

    The median is weighted over the length histogram, so the exact percentile
    holds one entry per distinct length and not one per row.
    """
    return length_histogram(df, length).agg(
        F.try_divide(F.sum(F.col("chars") * F.col("docs")), F.sum("docs")).alias("mean_chars"),
        F.percentile("chars", 0.5, F.col("docs")).alias("median_chars"),
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        F.coalesce(F.sum(F.when(F.col("chars") > limit, F.col("docs"))), F.lit(0)).alias("over_limit"),
    )


def length_outliers(
    df: DataFrame, length: Column,
    short: int = config.SHORT_TEXT_CHARS, long: int = config.LONG_TEXT_CHARS,
) -> DataFrame:
    """Counts and shares of very short and very long texts."""
    counts = df.select(length.alias("n")).agg(
        F.count_if(F.col("n") < short).alias("short_texts"),
        F.count_if(F.col("n") > long).alias("long_texts"),
        F.count(F.lit(1)).alias("articles"),
    )
    return counts.withColumns({
        "short_pct": percent(F.col("short_texts"), F.col("articles")),
        "long_pct": percent(F.col("long_texts"), F.col("articles")),
    })


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value, NULL left out, most first.

    The total is a scalar subquery over the per-value counts.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("articles"))
    total = counts.agg(F.sum("articles"))
    return counts.withColumn("pct", percent(F.col("articles"), total.scalar())).orderBy(
        F.desc("articles"), F.asc(column)
    )


def category_distribution(df: DataFrame, labels: Sequence[str] = config.CATEGORIES, column: str = "label") -> DataFrame:
    """Rows and share per label in fixed order; absent labels count 0.

    One pass: a conditional count per label of the fixed list, turned into rows.
    """
    counted = df.agg(
        *[F.count_if(F.col(column) == name).alias(f"_{i}") for i, name in enumerate(labels)],
        F.count(column).alias("_all"),
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("label"), F.col(f"_{i}").alias("articles"))
        for i, name in enumerate(labels)
    ])
    return (
        counted.select("_all", F.inline(rows))
        .withColumn("pct", percent(F.col("articles"), F.col("_all")))
        .drop("_all")
        .orderBy("position")
    )


def classes(df: DataFrame, column: str = "label") -> DataFrame:
    return df.select(column).distinct()


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "label", value: str = "value") -> DataFrame:
    """Wide label columns to ``name, value`` rows; identifiers are dropped."""
    return df.select(*columns).unpivot([], list(columns), name, value)


def score_stats(df: DataFrame, columns: Sequence[str], threshold: float = config.DECISION_THRESHOLD) -> DataFrame:
    """Per label: rows at or over the threshold, their share and the mean score; one job for all labels."""
    return (
        unpivot(df, columns)
        .groupBy("label")
        .agg(
            F.count_if(F.col("value") >= threshold).alias("positives"),
            F.avg("value").alias("mean_score"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn("pct", percent(F.col("positives"), F.col("_rows")))
        .drop("_rows")
    )


def label_counts(df: DataFrame, columns: Sequence[str], mask: Column | None = None) -> DataFrame:
    """Positives and share per binary label, over all rows or the masked ones."""
    rows = df if mask is None else df.where(mask)
    return (
        unpivot(rows, columns)
        .groupBy("label")
        .agg(F.sum("value").alias("positives"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("pct", percent(F.col("positives"), F.col("_rows")))
        .drop("_rows")
    )


def label_positives(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Positives per label within each split."""
    return (
        df.select(by, *columns)
        .unpivot([by], list(columns), "label", "value")
        .groupBy(by, "label")
        .agg(F.sum("value").alias("positives"))
    )


def row_label_count(columns: Sequence[str]) -> Column:
    return sum((F.col(c) for c in columns), F.lit(0))


def labels_per_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows carry how many labels."""
    return (
        df.select(row_label_count(columns).alias("labels"))
        .groupBy("labels")
        .agg(F.count(F.lit(1)).alias("articles"))
        .orderBy("labels")
    )


def histogram(df: DataFrame, value: Column, edges: int) -> DataFrame:
    """Counts in the bins [0,1), ..., [edges-1, edges]; the last bin is closed, empty bins are kept."""
    bins = [
        F.count_if(
            (F.col("v") >= i) & ((F.col("v") < i + 1) if i < edges - 1 else (F.col("v") <= i + 1))
        ).alias(f"_{i}")
        for i in range(edges)
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"_{i}").alias("articles")) for i in range(edges)])
    return df.select(value.alias("v")).agg(*bins).select(F.inline(rows))


def top_combinations(df: DataFrame, columns: Sequence[str], display: Sequence[str], k: int = 10) -> DataFrame:
    """The most frequent label combinations."""
    return (
        df.select(combination(columns, display).alias("labels"))
        .groupBy("labels")
        .agg(F.count(F.lit(1)).alias("articles"))
        .orderBy(F.desc("articles"), F.asc("labels"))
        .limit(k)
    )


def split_sizes(df: DataFrame, column: str = "split") -> DataFrame:
    return value_counts(df, column).withColumnRenamed("articles", "rows")


def chart_series(counts: DataFrame) -> DataFrame:
    """Bar and pie series of label counts: label, value and its share of all positives, largest first."""
    whole = counts.agg(F.sum("positives"))
    return counts.select(
        "label",
        F.col("positives").alias("value"),
        percent(F.col("positives"), whole.scalar()).alias("share_pct"),
    ).orderBy(F.desc("value"), F.asc("label"))
