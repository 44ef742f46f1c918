"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_rows(df: DataFrame, keep, items: Column, item: str, pos: str | None = "pos") -> DataFrame:
    """The kept columns with one row per array element, and its position.

    The outer generator with a test on its output says the same as the plain one,
    but keeps the optimizer from testing the array's size below it, which would
    compute an expensive array twice.
    """
    out = df.select(*keep, F.posexplode_outer(items).alias(pos or "_pos", item))
    out = out.where(F.col(pos or "_pos").isNotNull())
    return out if pos else out.drop("_pos")
