"""Article URL discovery over stored sitemaps, feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.config import CrawlLimits
from presswork.functions import html as H
from presswork.functions import urls as U
from presswork.functions.text import strip_ws
from presswork.operators.dedup import cap_per_group, cap_total, first_wins, new_rows
from presswork.operators.links import anchors
from presswork.operators.reach import reach
from presswork.operators.rows import array_rows

LOC = r"(?s)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc\s*>"
PLAIN_LOC = r"<loc>(.*?)</loc>"
#: The root's close tag; comments and processing instructions may follow it.
ROOT_CLOSED = r"(?is)</(?:[\w.-]+:)?(?:urlset|sitemapindex)\s*>(?:\s++|<!--.*?-->|<\?.*?\?>)*+\z"
IS_INDEX = r"(?i)<(?:[\w.-]+:)?(?:sitemapindex|sitemap)[\s>]"
ENTRY = r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)\s*>"


# ---- sitemaps --------------------------------------------------------------
def well_formed(xml: Column) -> Column:
    return xml.rlike(ROOT_CLOSED)


def sitemap_locs(xml: Column) -> Column:
    """``<loc>`` values in document order.

    A document whose root element is closed is read with prefixes, CDATA and
    entities resolved; of a broken one only plain ``<loc>`` tags are taken.
    """
    values = F.transform(
        F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)),
        lambda v: strip_ws(H.decode_entities(F.regexp_replace(v, r"<!\[CDATA\[|\]\]>", ""))),
    )
    good = F.filter(values, lambda v: v != "")
    return F.when(well_formed(xml), good).otherwise(F.regexp_extract_all(xml, F.lit(PLAIN_LOC), F.lit(1)))


def is_sitemap_index(xml: Column) -> Column:
    """A well-formed index of further sitemaps."""
    return well_formed(xml) & xml.rlike(IS_INDEX)


def sitemap_urls(docs: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Likely article URLs of each stored sitemap, first position wins: kept columns, ``pos``, ``loc``.

    Duplicates are dropped inside the row by ``array_distinct``, which keeps order.
    """
    locs = F.array_distinct(F.filter(sitemap_locs(F.col("xml")), U.is_likely_article))
    return array_rows(docs.where(~is_sitemap_index(F.col("xml"))), keep, locs, "loc")


def expand_sitemaps(docs: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Stored sitemaps reachable from ``seeds`` (``site, url``): ``site, url, depth``, at most ``max_depth`` levels if given.

    Indexes are parsed once into edges; see ``reach`` for the levels.
    """
    indexes = docs.where(is_sitemap_index(F.col("xml"))).select(F.col("url").alias("src"), "xml")
    edges = array_rows(indexes, ["src"], sitemap_locs(F.col("xml")), "url")
    return reach(edges, seeds, 1, max_depth).join(docs.select("url"), "url", "left_semi")


# ---- feeds -----------------------------------------------------------------
def _entry_link(entry: Column) -> Column:
    """An entry's link: element text (RSS) or the first alternate ``href`` (Atom)."""
    text = strip_ws(H.decode_entities(F.regexp_replace(
        F.regexp_extract(entry, r"(?is)<link(?:\s[^>]*)?>([^<]*(?:<!\[CDATA\[.*?\]\]>)?[^<]*)</link\s*>", 1),
        r"<!\[CDATA\[|\]\]>", "")))
    tags = F.regexp_extract_all(entry, F.lit(r"(?i)<link(?:\s[^>]*)?>"), F.lit(0))
    alternate = F.filter(tags, lambda t: ~t.rlike(r"(?i)\srel\s*=") | t.rlike(r"""(?i)\srel\s*=\s*["']?alternate"""))
    href = H.decode_entities(
        F.regexp_extract(F.get(alternate, F.lit(0)), r"""(?i)\shref\s*=\s*["']([^"']*)["']""", 1))
    return F.when(text != "", text).otherwise(F.nullif(href, F.lit("")))


def feed_urls(docs: DataFrame, max_urls: int | None = None, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Entry links of each stored feed, its first ``max_urls`` if given: kept columns, ``pos``, ``loc``."""
    entries = F.regexp_extract_all(F.col("xml"), F.lit(ENTRY), F.lit(1))
    links = F.filter(F.transform(entries, _entry_link), lambda x: x.isNotNull())
    return array_rows(docs, keep, links if max_urls is None else F.slice(links, 1, max_urls), "loc")


# ---- category pages ----------------------------------------------------------
def crawl_pages(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    fanout: int | None = None,
) -> DataFrame:
    """Stored pages reached from ``seeds`` (``site, url``) over pagination links: ``site, url, depth``.

    Breadth first: each page passes on its pagination targets, or its first ``fanout``,
    that no earlier level of the same site visited, whether or not it is stored.
    Pages are parsed once into edges; see ``reach`` for the levels.
    """
    targets = F.transform(anchors(F.col("html")), lambda a: F.when(
        U.is_pagination(a["anchor_text"]), U.resolve_href(F.col("src"), a["href"])))
    edges = array_rows(pages.withColumnRenamed("url", "src"), ["src"], F.filter(targets, lambda t: t.isNotNull()), "url")
    return reach(edges, seeds, 0, max_depth, fanout).join(pages.select("url"), "url", "left_semi")


def page_article_links(pages: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Likely article links of each page without fragment: kept columns, ``pos``, ``loc``."""
    found = F.transform(
        anchors(F.col("html")), lambda a: U.strip_fragment(U.resolve_href(F.col("url"), a["href"]))
    )
    links = F.array_distinct(F.filter(found, lambda t: t.isNotNull() & U.is_likely_article(t)))
    return array_rows(pages, keep, links, "loc")


def crawl_urls(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    fanout: int | None = None,
) -> DataFrame:
    """``site, depth, page, pos, loc`` of every likely article link on the reached pages."""
    reached = crawl_pages(pages, seeds, max_depth, fanout)
    links = page_article_links(pages).withColumnRenamed("url", "page")
    return reached.withColumnRenamed("url", "page").join(links, "page").select(
        "site", "depth", "page", "pos", "loc"
    )


# ---- all sources ---------------------------------------------------------------
def discover(
    sources: DataFrame,
    pages: DataFrame,
    docs: DataFrame,
    history_urls: DataFrame | None = None,
    limits: CrawlLimits = CrawlLimits(),
) -> DataFrame:
    """New candidate URLs of all sources: ``site_pos, domain, pos, url``, first wins over all.

    ``sources`` is ``site_pos, domain, type, feed, url``; each row goes to the
    branch its type names, rows without the field the branch needs are skipped.
    """
    feeds = sources.where("feed is not null and feed <> ''").select(
        "site_pos", F.lower("type").alias("type"), F.col("feed").alias("url")
    )
    rss = feeds.where("type = 'rss'").join(docs, "url")
    rss = feed_urls(rss, limits.max_urls_per_site, ("site_pos",)).withColumn("doc", F.lit(""))
    rss = rss.withColumn("depth", F.lit(0))

    maps = feeds.where("type = 'sitemap'").select(F.col("site_pos").alias("site"), "url")
    reached = expand_sitemaps(docs, maps, limits.sitemap_max_nested)
    sitemaps = sitemap_urls(
        reached.join(docs, "url").withColumnRenamed("site", "site_pos").withColumnRenamed("url", "doc"),
        ("site_pos", "doc", "depth"),
    )

    starts = sources.where("type = 'category' and url is not null and url <> ''").select(
        F.col("site_pos").alias("site"), "url"
    )
    crawled = crawl_urls(pages, starts, limits.crawl_max_depth, limits.crawl_fanout).select(
        F.col("site").alias("site_pos"), F.col("page").alias("doc"), "depth", "pos", "loc"
    )

    found = rss.unionByName(sitemaps).unionByName(crawled)
    return candidate_urls(found.withColumnRenamed("loc", "url"), ["depth", "doc", "pos"], history_urls, limits)


def candidate_urls(
    found: DataFrame,
    order: list[str],
    history_urls: DataFrame | None = None,
    limits: CrawlLimits = CrawlLimits(),
) -> DataFrame:
    """Normalise, filter, deduplicate per site and overall, and cap found URLs where ``limits`` says so.

    ``found`` has ``site_pos``, ``url`` and the ``order`` columns.
    """
    urls = (
        found.withColumn("url", U.strip_fragment(F.col("url")))
        .where(U.is_http(F.col("url")) & U.is_likely_article(F.col("url")))
    )
    urls = first_wins(urls.select("site_pos", "url", *order), ["site_pos", "url"], order)
    if history_urls is not None:
        urls = new_rows(urls, history_urls, "url")
    if limits.max_urls_per_site is not None:
        urls = cap_per_group(urls, ["site_pos"], [*order, "url"], limits.max_urls_per_site)
    urls = first_wins(urls, ["url"], ["site_pos", *order])
    if limits.max_urls is not None:
        urls = cap_total(urls, ["site_pos"], [*order, "url"], limits.max_urls)
    return urls.select("site_pos", *order, "url")


def site_counts(candidates: DataFrame, site: str = "site_pos") -> DataFrame:
    """Candidates per site."""
    return candidates.groupBy(site).agg(F.count(F.lit(1)).alias("urls"))
