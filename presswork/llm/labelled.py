"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(folds)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, use: Column, rows: int, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled keys that ``use`` allows, chosen by digest.

    Keys and labels that are null and labels other than 0 and 1 are left out; a key
    with several labels takes the smallest. ``rows`` bounds what is broadcast.
    """
    chosen = (
        labels.where(use & F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(key).agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(key), key).limit(rows))
    texts = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), key).select(key, F.col("_text").alias("text"), F.col("_label").alias("label"))
