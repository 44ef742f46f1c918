"""URL, link and discovery queries."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from presswork import config
from presswork.functions import urls as U
from presswork.operators import dedup, discover, links

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
INCLUDE = "(?i)" + "|".join(config.ARTICLE_URL_PARTS)
EXCLUDE = "(?i)" + "|".join(config.EXCLUDED_URL_PARTS)
CAND = f"with cand as ({fx.duck(fx.CANDIDATES_TWICE_SQL)})"


def likely(url: str) -> str:
    """SQL of the likely-article rule."""
    parts = (
        f"list_filter(string_split(regexp_replace(regexp_extract({url}, "
        "'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/'), lambda p: p <> '')"
    )
    return (
        f"(not regexp_matches({url}, '{EXCLUDE}') and (regexp_matches({url}, '{INCLUDE}') or "
        f"coalesce(len({parts}) >= 2 and length({parts}[-1]) > 10 and contains({parts}[-1], '-'), false)))"
    )


def normal(url: str) -> str:
    return f"regexp_replace(split_part({url}, '#', 1), '^{WS}+|{WS}+$', '', 'g')"


NOISE = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->"


def anchor_ctes(pages: str, name: str = "links") -> str:
    """CTE of anchors: url, page_id, pos, href, anchor_text (the tables' anchors are all closed)."""
    return f"""{name}_raw as (select page_id, url,
    regexp_extract_all(regexp_replace(html, '{NOISE}', '', 'g'), '(?is)<a\\s[^>]*>.*?</a\\s*>') as found from {pages}),
{name}_flat as (select page_id, url, unnest(range(len(found))) as pos, unnest(found) as a from {name}_raw),
{name} as (select page_id, url, pos, replace(regexp_extract(a, '(?i)\\shref\\s*=\\s*"([^"]*)"', 1), '&amp;', '&') as href,
    trim(regexp_replace(replace(replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '&raquo;', '»'), '&amp;', '&'),
         '{WS}+', ' ', 'g')) as anchor_text from {name}_flat)"""


def undotted(href: str) -> str:
    """SQL of the dot segments that the fixture has: one step up at a time, at the root, and none."""
    here = f"regexp_replace(regexp_extract({href}, '^([^?#]*)', 1), '/\\.(/|$)', '/')"
    up = f"regexp_replace({here}, '/[^/?#.]+/\\.\\.(/|$)', '/')"
    return f"(regexp_replace({up}, '^/\\.\\.(/|$)', '/') || regexp_extract({href}, '^[^?#]*(.*)$', 1))"


def resolved(url: str, href: str) -> str:
    base = f"regexp_extract({url}, '^([a-zA-Z]+://[^/?#]*)', 1)"
    return (
        f"case when starts_with({href}, '//') then regexp_extract({url}, '^([a-zA-Z]+:)', 1) || {href} "
        f"when starts_with({href}, '/') then {base} || {undotted(href)} when starts_with({href}, 'http') then {href} end"
    )


@query("page_links", f"with {anchor_ctes('pages')} select page_id, pos, href, anchor_text from links")
def page_links(spark, sf):
    return links.extract_links(fx.pages(spark, sf), ("page_id",)).withColumn("pos", F.col("pos").cast("long"))


@query("resolved_links", f"""with dotted as ({fx.duck(fx.DOTTED_SQL)}), {anchor_ctes('dotted')}
select page_id, pos, target from (select page_id, pos, {resolved('url', 'href')} as target from links) where target is not null""")
def resolved_links(spark, sf):
    return links.resolved_links(fx.from_sql(spark, sf, fx.DOTTED_SQL), ("page_id", "url")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "target")


@query("pagination_links", f"""with crawl as ({fx.duck(fx.CRAWL_PAGES_SQL)}), {anchor_ctes('crawl')}
select page_id, pos, anchor_text from links where regexp_matches(lower(anchor_text), 'next|older|previous|more|load')""")
def pagination_links(spark, sf):
    return links.extract_links(fx.crawl_pages(spark, sf), ("page_id",)).where(
        U.is_pagination(F.col("anchor_text"))).select("page_id", F.col("pos").cast("long").alias("pos"), "anchor_text")


@query("url_normalize", f"{CAND} select pos, {normal('url')} as url from cand")
def url_normalize(spark, sf):
    return fx.candidates(spark, sf).select("pos", U.strip_fragment(F.col("url")).alias("url"))


@query("likely_articles", f"{CAND} select pos, url, {likely('url')} as likely from cand")
def likely_articles(spark, sf):
    return fx.candidates(spark, sf).select("pos", "url", U.is_likely_article(F.col("url")).alias("likely"))


@query("domain_extract", "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as domain from pages")
def domain_extract(spark, sf):
    return fx.pages(spark, sf).select("page_id", U.netloc(F.col("url")).alias("domain"))


@query("new_urls", f"""{CAND}, clean as (select pos, {normal('url')} as url from cand)
select pos, url from clean where starts_with(url, 'http') and url not in (select url from clean where pos % 7 = 0)""")
def new_urls(spark, sf):
    clean = fx.candidates(spark, sf).select("pos", U.strip_fragment(F.col("url")).alias("url"))
    history = clean.where("pos % 7 = 0").select("url").distinct()
    return dedup.new_rows(clean.where(U.is_http(F.col("url"))), history, "url").select("pos", "url")


FIRST = f"""{CAND}, clean as (select pos, host, {normal('url')} as url from cand),
firsts as (select pos, host, url from clean qualify row_number() over (partition by url order by pos) = 1)"""


def _firsts(spark, sf):
    clean = fx.candidates(spark, sf).select("pos", "host", U.strip_fragment(F.col("url")).alias("url"))
    return dedup.first_wins(clean, ["url"], ["pos"])


@query("url_dedup_first", f"{FIRST} select pos, host, url from firsts")
def url_dedup_first(spark, sf):
    return _firsts(spark, sf)


@query("url_caps", f"""{FIRST}, capped as (
  select *, row_number() over (order by host, pos) as rank_all from (
    select * from firsts qualify row_number() over (partition by host order by pos) <= 3))
select host, pos, url from capped where rank_all <= 100""")
def url_caps(spark, sf):
    capped = dedup.cap_per_group(_firsts(spark, sf), ["host"], ["pos"], 3)
    return dedup.cap_total(capped, ["host"], ["pos"], 100).select("host", "pos", "url")


@query("site_counts", f"{FIRST} select host, count(*) as urls from firsts group by host")
def site_counts(spark, sf):
    return discover.site_counts(_firsts(spark, sf), "host")


# ---- sitemaps, feeds, crawl ---------------------------------------------------
DOCS = f"with recursive docs as ({fx.DUCK_DOCS_SQL})"
LOCS = f"""locs as (select kind, chunk, url, unnest(range(len(found))) as pos, unnest(found) as loc, closed from (
  select kind, chunk, url, regexp_matches(xml, '(?s)</(urlset|sitemapindex)>(\\s|<!--.*?-->|<\\?.*?\\?>)*$') as closed,
         case when regexp_matches(xml, '(?s)</(urlset|sitemapindex)>(\\s|<!--.*?-->|<\\?.*?\\?>)*$') then
           list_transform(regexp_extract_all(xml, '<loc>(.*?)</loc>', 1),
             lambda v: trim(replace(replace(replace(v, '<![CDATA[', ''), ']]>', ''), '&amp;', '&')))
         else regexp_extract_all(xml, '<loc>(.*?)</loc>', 1) end as found from docs where kind <> 'feed') x)"""
MAP_URLS = f"""map_urls as (
  select chunk, url, loc, min(pos) as first_pos from locs where kind = 'map' and {likely('loc')} group by chunk, url, loc),
map_pos as (select chunk, url, loc, row_number() over (partition by url order by first_pos) - 1 as pos from map_urls)"""
def closure_ctes(levels: str) -> str:
    """What the index leads to; with cycles each level may hold every map, so levels end at their number."""
    return f"""closure as (
  select 0 as site, url, 1 as depth from docs where url = 'https://maps.example.org/index-0.xml'
  union
  select c.site, l.loc as url, c.depth + 1 as depth from closure c
  join locs l on l.url = c.url and l.kind = 'index' join docs d on d.url = l.loc
  where c.depth < {levels} and l.loc <> c.url),
reached as (select site, url, min(depth) as depth from closure group by site, url)"""


CLOSURE = closure_ctes("(select count(*) from docs)")


@query("sitemap_urls", f"{DOCS}, {LOCS}, {MAP_URLS} select chunk, pos, loc from map_pos")
def sitemap_urls(spark, sf):
    return discover.sitemap_urls(fx.docs(spark, sf, "map"), ("chunk",)).withColumn("pos", F.col("pos").cast("long"))


def _closure(spark, sf, max_depth=None):
    seeds = spark.createDataFrame([(0, "https://maps.example.org/index-0.xml")], "site int, url string")
    docs = fx.docs(spark, sf).where("kind <> 'feed'")
    return discover.expand_sitemaps(docs, seeds, max_depth).select("url", "depth")


@query("sitemap_closure", f"{DOCS}, {LOCS}, {CLOSURE} select url, depth from reached")
def sitemap_closure(spark, sf):
    return _closure(spark, sf)


@query("sitemap_closure_nested_5", f"{DOCS}, {LOCS}, {closure_ctes('5')} select url, depth from reached")
def sitemap_closure_nested_5(spark, sf):
    """The stock limit of nested sitemaps."""
    return _closure(spark, sf, 5)


FEED_URLS = """feed_raw as (select chunk, url,
  list_filter(list_transform(regexp_extract_all(xml, '(?s)<(?:item|entry)>(.*?)</(?:item|entry)>', 1),
    lambda e: trim(replace(case when contains(e, '</link>') then regexp_extract(e, '<link>([^<]*)</link>', 1)
           else regexp_extract(e, 'rel="alternate" href="([^"]*)"', 1) end, '&amp;', '&'))),
    lambda u: u <> '') as found
  from docs where kind = 'feed'),
feed_pos as (select chunk, url, unnest(range(len(found))) as pos, unnest(found) as loc from feed_raw)"""


@query("feed_urls", f"{DOCS}, {FEED_URLS} select chunk, pos, loc from feed_pos")
def feed_urls(spark, sf):
    # An Atom href is taken as it stands, so both sides trim the trailing blank of the fixture.
    return discover.feed_urls(fx.docs(spark, sf, "feed"), keep=("chunk",)).select(
        "chunk", F.col("pos").cast("long").alias("pos"), F.trim("loc").alias("loc"))


FOUND_CTES = f"""found as (select page_id, url, min(pos) as pos, loc from (
        select page_id, url, pos, {normal('target')} as loc from (
          select page_id, url, pos, {resolved('url', 'href')} as target from links) r where target is not null) n
      where {likely('loc')} group by page_id, url, loc),
crawl_pos as (select url, loc, row_number() over (partition by url order by pos) - 1 as pos from found)"""
CRAWL_CTES = f"""crawl as ({fx.duck(fx.CRAWL_PAGES_SQL)}), {anchor_ctes("crawl")},
targets as (select url as src, pos, {resolved('url', 'href')} as target from links
  where regexp_matches(lower(anchor_text), 'next|older|previous|more|load'))"""


def crawl_ctes(seeds: str) -> str:
    """All that is reached, with the first level that reaches it; a page's targets are looked up once per level."""
    return f"""{CRAWL_CTES}, steps as (select distinct src, target from targets where target in (select url from crawl)),
walk as (
  select site, url, 0 as depth from ({seeds}) s join crawl using (url)
  union
  select w.site, t.target, w.depth + 1 from walk w join steps t on t.src = w.url where w.depth < (select count(*) from crawl)),
visited as (select site, url, min(depth) as depth from walk group by site, url), {FOUND_CTES}"""


def limited_crawl_ctes(seeds: str) -> str:
    """Breadth-first levels 0 to 10, each with the first five unvisited pagination targets per page."""
    ctes = [CRAWL_CTES, f"seen_0 as (select site, url, 0 as depth from ({seeds}) s join crawl using (url))"]
    for d in range(1, 11):
        ctes.append(f"""level_{d} as (
          select distinct site, target as url, {d} as depth from (
            select f.site, t.src, t.pos, t.target from seen_{d - 1} f join targets t on t.src = f.url
            where f.depth = {d - 1} and t.target is not null
              and not exists (select 1 from seen_{d - 1} v where v.site = f.site and v.url = t.target)
            qualify row_number() over (partition by f.site, t.src order by t.pos) <= 5) n
          where target in (select url from crawl))""")
        ctes.append(f"seen_{d} as (select * from seen_{d - 1} union all select * from level_{d})")
    return ", ".join([*ctes, FOUND_CTES])


SEEDS = "select 0 as site, 'https://crawl.example.org/p/0' as url union all select 1, 'https://crawl.example.org/p/7'"


def _crawl(spark, sf, *limits):
    seeds = spark.createDataFrame(
        [(0, "https://crawl.example.org/p/0"), (1, "https://crawl.example.org/p/7")], "site int, url string")
    return discover.crawl_urls(fx.crawl_pages(spark, sf), seeds, *limits).withColumn("pos", F.col("pos").cast("long"))


@query("category_crawl", f"""with recursive {crawl_ctes(SEEDS)}
select s.site, s.depth, s.url as page, p.pos, p.loc from visited s join crawl_pos p on p.url = s.url""")
def category_crawl(spark, sf):
    return _crawl(spark, sf)


@query("category_crawl_depth_10_fanout_5", f"""with {limited_crawl_ctes(SEEDS)}
select s.site, s.depth, s.url as page, p.pos, p.loc from seen_10 s join crawl_pos p on p.url = s.url""")
def category_crawl_depth_10_fanout_5(spark, sf):
    """The stock limits of a crawl."""
    return _crawl(spark, sf, config.CRAWL_MAX_DEPTH, config.CRAWL_FANOUT)


SITES = [
    (0, "feeds.example.org", "rss", "https://maps.example.org/feed-1.xml", None),
    (1, "maps.example.org", "sitemap", "https://maps.example.org/index-0.xml", None),
    (2, "crawl.example.org", "category", None, "https://crawl.example.org/p/0"),
    (3, "nofeed.example.org", "rss", None, None),
    (4, "unknown.example.org", "api", "https://maps.example.org/feed-0.xml", None),
]


def discovered_ctes(known: str) -> str:
    """(site_pos, url) of all that the sites lead to; ``known`` is SQL for URLs to leave out."""
    return f"""{DOCS}, {LOCS}, {MAP_URLS}, {CLOSURE.replace('select 0 as site', 'select 1 as site')}, {FEED_URLS},
{crawl_ctes("select 2 as site, 'https://crawl.example.org/p/0' as url")},
raw as (
  select 0 as site_pos, 0 as depth, '' as doc, pos, loc as url from feed_pos where url = 'https://maps.example.org/feed-1.xml'
  union all select 1, r.depth, r.url, m.pos, m.loc from reached r join map_pos m on m.url = r.url
  union all select 2, s.depth, s.url, p.pos, p.loc from visited s join crawl_pos p on p.url = s.url),
tidy as (select site_pos, depth, doc, pos, {normal('url')} as url from raw),
kept as (select * from tidy where starts_with(url, 'http') and {likely('url')} and url not in ({known})),
per_site as (select * from kept qualify row_number() over (partition by site_pos, url order by depth, doc, pos) = 1),
discovered as (select site_pos, url from per_site qualify row_number() over (partition by url order by site_pos, depth, doc, pos) = 1)"""


@query("discover_all", f"{discovered_ctes('select url from pages where page_id % 7 = 0')} select site_pos, url from discovered")
def discover_all(spark, sf):
    sites = spark.createDataFrame(SITES, "site_pos int, domain string, type string, feed string, url string")
    history = fx.pages(spark, sf).where("page_id % 7 = 0").select("url")
    return discover.discover(sites, fx.crawl_pages(spark, sf), fx.docs(spark, sf), history).select("site_pos", "url")
