"""Anchors of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import urls as U
from presswork.functions.text import collapse_ws
from presswork.operators.rows import array_rows

A_OPEN = r"(?i)<a\s"
HREF = r"""(?i)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def anchors(html: Column) -> Column:
    """``array<struct<href, anchor_text>>`` in document order, anchors without href left out.

    An anchor ends at its close tag or at the next anchor.
    """

    def parse(piece: Column) -> Column:
        attrs = F.regexp_extract(piece, r"^([^>]*)>", 1)
        raw = F.when(attrs.rlike(HREF), F.concat(*[F.regexp_extract(attrs, HREF, g) for g in (1, 2, 3)]))
        inner = F.regexp_extract(F.element_at(F.split(piece, r"(?i)</a\s*>", 2), 1), r"(?s)^[^>]*>(.*)$", 1)
        return F.struct(
            H.decode_entities(raw).alias("href"),
            collapse_ws(H.decode_entities(F.regexp_replace(inner, H.TAG, ""))).alias("anchor_text"),
        )

    pieces = H.let(F.split(H.strip_noise(html), A_OPEN), H.tail)
    return F.filter(F.transform(pieces, parse), lambda a: a["href"].isNotNull())


def extract_links(pages: DataFrame, keep: tuple[str, ...] = ("url",), html: str = "html") -> DataFrame:
    """One row per anchor: the kept page columns, ``pos``, ``href``, ``anchor_text``.

    Anchors are cut inside the row and exploded; no shuffle.
    """
    return array_rows(pages, keep, anchors(F.col(html)), "_a").select(
        *keep, "pos", F.col("_a.href").alias("href"), F.col("_a.anchor_text").alias("anchor_text")
    )


def resolved_links(pages: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Anchors with an absolute ``target``; what is not an http link is dropped."""
    return (
        extract_links(pages, keep)
        .withColumn("target", U.resolve_href(F.col("url"), F.col("href")))
        .where(F.col("target").isNotNull())
    )
