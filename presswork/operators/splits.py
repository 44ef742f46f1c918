"""Reproducible train/validation/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import config
from presswork.operators.dedup import rank_cutoffs
from presswork.session import stage


def split_digest(key: str, seed: int = config.SPLIT_SEED) -> Column:
    """A digest of the row's own key: stable under any partitioning, order or retry."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split_hash(df: DataFrame, key: str, seed: int = config.SPLIT_SEED) -> DataFrame:
    """80/10/10 by digest thresholds: no shuffle, sizes near the shares."""
    digest = split_digest(key, seed)
    name = F.when(digest < "cccccccc", "train").when(digest < "e6666666", "val").otherwise("test")
    return df.withColumn("split", name)


def split_random(df: DataFrame, key: str, seed: int = config.SPLIT_SEED, order: str = "test_first") -> DataFrame:
    """Exact random 80/10/10.

    ``test_first`` cuts a tenth for test, then a ninth of the rest for
    validation; ``halves`` holds a fifth out and halves it.  Held-out sizes are
    rounded up.
    """
    cuts = rank_cutoffs(df, split_digest(key, seed), key, [], _cuts(order)).select(F.struct("*"))
    return _assign(df.withColumn("_cuts", cuts.scalar()), key, seed)


def split_stratified(df: DataFrame, key: str, strata: str, seed: int = config.SPLIT_SEED) -> DataFrame:
    """Exact 80/10/10 within each stratum, however large one stratum is; NULL is a stratum like any other."""
    cuts = rank_cutoffs(df, split_digest(key, seed), key, [strata], _cuts("halves"))
    cuts = stage(cuts.select(F.col(strata).alias("_stratum"), F.struct("test", "held_out").alias("_cuts")), "split-cuts")
    return _assign(df.join(cuts, F.col(strata).eqNullSafe(F.col("_stratum"))).drop("_stratum"), key, seed)


def _assign(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Compare each row with its cut points: the split itself moves no row."""
    at = F.struct(split_digest(key, seed).alias("digest"), F.col(key).alias("key"))
    name = (
        F.when(at <= F.col("_cuts.test"), "test").when(at <= F.col("_cuts.held_out"), "val").otherwise("train")
    )
    return df.withColumn("split", name).drop("_cuts")


def _ceil_div(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / F.lit(d)).cast("long")


def _cuts(order: str) -> dict[str, Column]:
    """Ranks, by digest, up to which rows are test rows and held-out rows."""
    size = F.col("_size")
    if order == "test_first":
        test = _ceil_div(size, 10)
        return {"test": test, "held_out": test + _ceil_div(size - test, 9)}
    if order == "halves":
        held_out = _ceil_div(size, 5)
        return {"test": _ceil_div(held_out, 2), "held_out": held_out}
    raise ValueError(f"unknown cut order: {order}")


def enough_rows(df: DataFrame, minimum: int) -> bool:
    """Whether at least ``minimum`` rows exist; reads no more than that many."""
    return df.limit(minimum).count() >= minimum


def split_columns(df: DataFrame, content: str, labels: Sequence[str]) -> DataFrame:
    """The columns a split file holds, helper columns left out."""
    return df.select(content, *labels, "split")
