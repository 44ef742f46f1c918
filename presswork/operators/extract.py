"""Page to article text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.session import stage


def largest_block(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, block``: the sibling paragraphs with most text, if over the minimum.

    Siblings have one parent element, end tags implied where they may be left out.
    The earliest group wins a tie.  A page is decided in its own row.
    """
    block = H.largest_block(H.strip_noise(F.col(html)))
    return pages.select(key, block.alias("block")).where(F.col("block").isNotNull())


def extracted(pages: DataFrame, key: str, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, kept columns, ``is_html``, ``title``, ``content``: the first strategy that qualifies.

    One pass over the HTML in whole rows, no shuffle: a later strategy is only
    computed for the pages that the one before it left open.
    """
    clean = F.col("_clean")
    return pages.withColumn("_clean", H.strip_noise(F.col("html"))).withColumn("is_html", H.is_html(F.col("html"))).select(
        key,
        *keep,
        "is_html",
        H.title_of(clean).alias("title"),
        F.when(F.col("is_html"), F.coalesce(
            H.main_text(clean), H.largest_block(clean), H.long_paragraphs(clean))).alias("content"),
    )


def extract_content(pages: DataFrame, key: str, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``extracted`` as a written table, for results that are read more than once."""
    return stage(extracted(pages, key, keep), "extract")
