"""The page funnel: every page gets exactly one outcome."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.config import CrawlLimits
from presswork.functions.text import compose_text, strip_ws
from presswork.functions.urls import netloc
from presswork.operators.components import connected_components
from presswork.operators.dedup import known_keys, new_rows
from presswork.operators.extract import extracted
from presswork.session import stage

# ---- fixed values: outcomes in the order in which the gates are tried -----
OUTCOMES = [
    "duplicate_url",
    "failed_fetch",
    "parse_error",
    "too_short",
    "too_long",
    "filtered_keyword",
    "duplicate_content",
    "saved",
]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that occur in the lower-cased text, as substrings, in list order.

    One ``contains`` per keyword over one shared lower-cased value.
    """
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k.lower())) for k in keywords])
    )


def keyword_map(hits: Column) -> Column:
    return F.map_from_arrays(hits, F.transform(hits, lambda _: F.lit(True)))


def history_keys(articles: DataFrame, unique: bool = True) -> tuple[DataFrame, DataFrame]:
    """Saved URLs and content hashes; a missing key is skipped.  Joins need no ``unique`` keys."""
    urls = articles.select("url").where(F.col("url").isNotNull())
    hashes = articles.select("content_hash").where(F.col("content_hash").isNotNull())
    return (urls.distinct(), hashes.distinct()) if unique else (urls, hashes)


@dataclass(frozen=True)
class IngestRun:
    """``outcomes``: key, url, outcome. ``articles``: the saved rows."""

    outcomes: DataFrame
    articles: DataFrame


def run_funnel(
    pages: DataFrame,
    keywords: list[str],
    limits: CrawlLimits = CrawlLimits(),
    key: str = "page_id",
    history_urls: DataFrame | None = None,
    history_hashes: DataFrame | None = None,
    scraped_at: Column | None = None,
) -> IngestRun:
    """Extract, gate and deduplicate pages.

    ``key`` orders the pages and must be unique.  The outcome is that of going
    through them one by one: a page is ``duplicate_url`` once its URL was saved, in
    the history or before it in this run, whatever else is wrong with it.  URLs of
    the history are settled first and never reach extraction; ``history_urls`` holds
    ``url``, or ``id`` as its digest.  The history meets slim rows only, and pages lose
    those that it settled by their keys.  Who is saved is found on (key, url, hash) rows,
    see ``first_of_both``.  Texts are written once; the outcomes and the articles read the
    written rows by column: the first never touches a text, the second only texts
    that passed the gates.
    """
    settled = None
    if history_urls is not None:
        by = "url" if "url" in history_urls.columns else "id"
        slim = pages.select(key, "url", *([F.sha2("url", 256).alias("id")] if by == "id" else []))
        settled = stage(slim.join(known_keys(history_urls, slim, by), by, "left_semi").select(key, "url"), "settled")
        pages = new_rows(pages, settled, key)
    rows = extracted(pages, key)
    text = strip_ws(compose_text(F.col("title"), F.col("content")))
    gated = (
        rows.withColumn("content_length", F.length("content"))
        .withColumn("_text", F.when(F.col("content_length").between(
            limits.min_content_chars, limits.max_content_chars), text))
        .withColumn("_hits", keyword_hits(F.col("_text"), keywords))
        .select(
            key,
            "url",
            "title",
            "content",
            "content_length",
            F.col("_hits").alias("keywords"),
            F.sha2("content", 256).alias("content_hash"),
            F.when(~F.col("is_html"), F.lit("failed_fetch"))
            .when(F.col("content").isNull(), F.lit("parse_error"))
            .when(F.col("content_length") < limits.min_content_chars, F.lit("too_short"))
            .when(F.col("content_length") > limits.max_content_chars, F.lit("too_long"))
            .when(F.size("_hits") == 0, F.lit("filtered_keyword"))
            .alias("gate"),
        )
    )
    # Only rows that may still be saved need their text from here on.
    needed = {c: F.when(F.col("gate").isNull(), F.col(c)) for c in ("title", "content", "keywords")}
    gated = stage(gated.withColumns(needed), "gated")

    slim = gated.select(key, "url", "gate", "content_hash")
    open_rows = slim.where(F.col("gate").isNull())
    if history_hashes is not None:
        open_rows = new_rows(open_rows, known_keys(history_hashes, open_rows, "content_hash"), "content_hash")
    winners = first_of_both(open_rows.select(key, "url", "content_hash"), key, "url", "content_hash")
    by_url = winners.where(F.col("url").isNotNull()).select("url", F.col(key).alias("_saved"))
    outcomes = slim.join(by_url, "url", "left").join(winners.select(key, F.lit(True).alias("_first")), key, "left").select(
        key,
        "url",
        F.when(F.col("_first"), F.lit("saved"))
        .when(F.col("_saved") < F.col(key), F.lit("duplicate_url"))
        .otherwise(F.coalesce("gate", F.lit("duplicate_content"))).alias("outcome"),
    )
    if settled is not None:
        outcomes = outcomes.unionByName(settled.withColumn("outcome", F.lit("duplicate_url")))
    saved = gated.where(F.col("gate").isNull()).join(winners.select(key), key, "left_semi")
    return IngestRun(outcomes, to_articles(saved, key, scraped_at))


#: Rows that one task goes through in order, and rounds of minima before components are looked for.
IN_ORDER = 1 << 18
ROUNDS = 2


def first_of_both(rows: DataFrame, key: str, one: str, other: str, in_order: int = IN_ORDER, rounds: int = ROUNDS) -> DataFrame:
    """The rows that are kept when going through ``rows`` by ``key`` and dropping those whose
    ``one`` or ``other`` an earlier kept row has.  A NULL there equals nothing.

    Few rows are gone through by one task.  Of many, rounds of map-side combined minima
    settle most: a row that is first of both its values is kept and its fellows fall out, so a
    value that a third of the rows share is never gathered.  What is left after ``rounds``
    falls into components that share no value; those of at most ``in_order`` rows are
    gone through by one task each, and only larger ones go on in rounds.  So long chains, in
    which each row depends on the one before it, take no round per row.
    """
    alone = {c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.col(key).cast("string"))).alias(f"_{c}") for c in (one, other)}
    left = stage(rows.select(key, one, other, *alone.values()), "open")
    kept = left.limit(0)
    for turn in count(1):
        n = left.count()
        if n <= in_order:
            kept = kept.unionByName(stage(_in_order(left.withColumn("_group", F.lit(0)).coalesce(1), key, one, other), "won"))
            break
        if turn == rounds + 1:
            roots = connected_components(_shared(left, key, one, other))
            grouped = left.join(roots.select(F.col("node").alias(key), F.col("root").alias("_group")), key, "left").withColumn(
                "_group", F.coalesce("_group", F.col(key)))
            sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
            grouped = stage(grouped.join(sizes, "_group"), "open")
            small = grouped.where(F.col("_rows") <= in_order).repartition("_group")
            kept = kept.unionByName(stage(_in_order(small, key, one, other), "won"))
            left = grouped.where(F.col("_rows") > in_order).select(*left.columns)
            continue
        firsts = left.groupBy(f"_{one}").agg(F.min(key).alias(key)).select(key)
        both = firsts.join(left.groupBy(f"_{other}").agg(F.min(key).alias(key)).select(key), key, "left_semi")
        won = stage(left.join(both, key, "left_semi"), "won")
        kept = kept.unionByName(won)
        left = stage(left.join(won.select(f"_{one}"), f"_{one}", "left_anti").join(
            won.select(f"_{other}"), f"_{other}", "left_anti").select(*left.columns), "open")
    return kept.select(key, one, other)


def _shared(rows: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """(u, v): each row and the first that shares a value with it."""
    parts = []
    for c in (one, other):
        least = rows.groupBy(f"_{c}").agg(F.min(key).alias("v"))
        parts.append(rows.join(least, f"_{c}").select(F.col(key).alias("u"), "v"))
    return parts[0].union(parts[1])


def _in_order(rows: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """The kept rows of each ``_group``; a task holds the values of one group's kept rows."""
    columns = [key, one, other, f"_{one}", f"_{other}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, (set(), set())
        for batch in batches:
            won = []
            for at, (own, *values) in enumerate(zip(*(batch.column(i).to_pylist() for i in (5, 3, 4)))):
                if own != group:
                    group, seen = own, (set(), set())
                if all(v not in s for v, s in zip(values, seen)):
                    won.append(at)
                    for v, s in zip(values, seen):
                        s.add(v)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(won, pa.int64())) for c in batch.columns[:5]], columns)

    sorted_rows = rows.select(*columns, "_group").sortWithinPartitions("_group", key)
    return sorted_rows.mapInArrow(run, rows.select(*columns).schema)


def to_articles(saved: DataFrame, key: str, scraped_at: Column | None = None) -> DataFrame:
    """The article record of each saved page, with the page key in front."""
    when = F.current_timestamp() if scraped_at is None else scraped_at
    return saved.select(
        key,
        F.sha2("url", 256).alias("id"),
        "url",
        netloc(F.col("url")).alias("domain"),
        "title",
        "content",
        "content_length",
        "content_hash",
        keyword_map(F.col("keywords")).alias("keywords_found"),
        F.date_format(when, TIME_FORMAT).alias("scraped_at"),
    )


def funnel_counts(outcomes: DataFrame) -> DataFrame:
    """Rows per outcome plus the total as ``attempted``."""
    return (
        outcomes.rollup("outcome")
        .agg(F.count(F.lit(1)).alias("pages"))
        .select(F.coalesce("outcome", F.lit("attempted")).alias("outcome"), "pages")
    )
