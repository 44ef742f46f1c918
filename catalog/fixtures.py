"""The library's inputs derived from the driver's tables.

Texts named ``*_SQL`` are plain SQL that Spark and DuckDB read alike; Spark fills
``{pages}`` and ``{documents}`` with DataFrames, DuckDB with view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.config import CATEGORIES, ISSUES
from presswork.operators.scoring import Lexicon
from presswork.session import spread, stage

KEYWORDS = ["thor", "eron", "ción", "ellement", "einheit"]

STAGE1 = Lexicon(dict(zip(CATEGORIES, [
    ["from", "with", "that", "this"],
    ["tion", "ther"],
    ["eron", "thing"],
    ["thre", "thin"],
    ["thble"],
    ["que", "der", "los"],
])))
STAGE2 = Lexicon(dict(zip(ISSUES, [
    [w] for w in
    ["thon", "thth", "than", "thnt", "thes", "thhe", "thha", "thed", "erin", "anea", "thor", "thti"]
])))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # only a caller that names a number pays for a shuffle of the scan: the bench, whose tables are one file each
    partitions = spark.conf.get("spark.presswork.partitions", None)
    return spread(spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet"), int(partitions) if partitions else None)


def fit_partitions(spark: SparkSession) -> int | None:
    """Tasks per iteration of a fit, where the caller names them; else the partitions of the training table."""
    named = spark.conf.get("spark.presswork.fit.partitions", None)
    return int(named) if named else None


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def from_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    names = {n: table(spark, sf, n) for n in ("pages", "documents", "labels") if f"{{{n}}}" in sql}
    return spark.sql(sql, **names)


def duck(sql: str) -> str:
    for name in ("pages", "documents", "labels"):
        sql = sql.replace(f"{{{name}}}", name)
    return sql


# ---- articles: doc_id, domain, title, content, content_length --------------
ARTICLES_SQL = """
select doc_id, source as domain, split_part(text, chr(10), 1) as title, text as content,
       length(text) as content_length
from {documents}
"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return from_sql(spark, sf, ARTICLES_SQL)


# ---- candidate URLs: pos, host, url; every fifth one twice -------------------
CANDIDATES_SQL = """
select pos, host, case when pos % 3 = 0 then concat(bare, '#top ') else bare end as url from (
  select page_id as pos, host,
         case cast(page_id % 8 as int)
           when 0 then concat(base, '/2024/05/x', page_id)
           when 1 then concat(base, '/news/story', page_id)
           when 2 then concat(base, '/tag/')
           when 3 then concat(base, '/author/x', page_id)
           when 4 then concat(base, '/a-b-c', page_id)
           when 5 then concat(base, '/x/somelongslug-', page_id)
           when 6 then concat(base, '/feed/')
           else url end as bare
  from (select page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) as base,
               regexp_extract(url, '//([^/]*)', 1) as host from {pages}) b
) c
"""
CANDIDATES_TWICE_SQL = f"""
select pos, host, url from ({CANDIDATES_SQL}) one
union all
select pos + 1000000000 as pos, host, url from ({CANDIDATES_SQL}) two where pos % 5 = 0
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return from_sql(spark, sf, CANDIDATES_TWICE_SQL)


# ---- stored sitemaps and feeds, ten URLs each --------------------------------
# A map is broken (root not closed) where chunk % 7 = 3.  An index lists its ten
# maps, itself and two further indexes.
_CHUNKED = f"""
select cast(floor(pos / 10) as bigint) as chunk, pos, replace(url, '&', '&amp;') as url
from ({CANDIDATES_SQL}) c
"""
_MAP_DOC = """
select chunk, concat('https://maps.example.org/map-', chunk, '.xml') as url,
       concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', items,
              case when chunk % 7 = 3 then '' else '</urlset>' end,
              case when chunk % 3 = 1 then chr(10) || '<!-- made by a generator -->' || chr(10) else '' end) as xml
from (select chunk, {agg_map} as items from chunked group by chunk) m
"""
_INDEX_DOC = """
select idx as chunk, concat('https://maps.example.org/index-', idx, '.xml') as url,
       concat('<sitemapindex>', items,
              '<sitemap><loc>https://maps.example.org/index-', idx, '.xml</loc></sitemap>',
              '<sitemap><loc> https://maps.example.org/index-', 2 * idx + 1, '.xml </loc></sitemap>',
              '<sitemap><loc><![CDATA[https://maps.example.org/index-', 2 * idx + 2, '.xml]]></loc></sitemap>',
              '</sitemapindex>', case when idx % 3 = 0 then ' <!-- generated --> <?done?>' else '' end) as xml
from (select idx, {agg_index} as items
      from (select distinct chunk, cast(floor(chunk / 10) as bigint) as idx from chunked) d group by idx) i
"""
_FEED_DOC = """
select chunk, concat('https://maps.example.org/feed-', chunk, '.xml') as url,
       case when chunk % 2 = 0 then concat('<rss><channel><link>https://maps.example.org/</link>', items, '</channel></rss>')
            else concat('<feed><link href="https://maps.example.org/"/>', items, '</feed>') end as xml
from (select chunk, {agg_feed} as items from chunked group by chunk) f
"""
_MAP_ITEM = "concat('<url><loc> ', url, ' </loc></url>')"
_INDEX_ITEM = "concat('<sitemap><loc>https://maps.example.org/map-', chunk, '.xml</loc></sitemap>')"
_FEED_ITEM = """case when pos % 4 = 3 then '<item><title>none</title></item>'
when chunk % 2 = 0 then concat('<item><title>t</title><link>', url, '</link></item>')
else concat('<entry><link rel="self" href="x"/><link rel="alternate" href="', url, '"/></entry>') end"""


def _docs_sql(agg) -> str:
    parts = [
        _MAP_DOC.replace("{agg_map}", agg(_MAP_ITEM, "pos")),
        _INDEX_DOC.replace("{agg_index}", agg(_INDEX_ITEM, "chunk")),
        _FEED_DOC.replace("{agg_feed}", agg(_FEED_ITEM, "pos")),
    ]
    kinds = ["map", "index", "feed"]
    union = " union all ".join(f"select '{k}' as kind, chunk, url, xml from ({p}) {k}_docs" for k, p in zip(kinds, parts))
    return f"with chunked as ({_CHUNKED}) {union}"


SPARK_DOCS_SQL = _docs_sql(lambda item, pos: f"listagg({item}, '') within group (order by {pos})")
DUCK_DOCS_SQL = duck(_docs_sql(lambda item, pos: f"string_agg({item}, '' order by {pos})"))


def docs(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    df = stage(from_sql(spark, sf, SPARK_DOCS_SQL), "docs")  # stored documents
    return df if kind is None else df.where(F.col("kind") == kind)


# ---- pages that link to each other -----------------------------------------------
# Page k links to six pages 3k+1 .. 3k+6 (mod n), to one candidate URL and to
# whatever its stored HTML links to.
_NEXT = ["Next page", "older posts", "Previous", "more &raquo;", "Load", "next"]
CRAWL_PAGES_SQL = f"""
select p.page_id, concat('https://crawl.example.org/p/', p.page_id) as url,
       concat('<html><body>',
       {", ".join(f"'<a class=x href=\"/p/', (p.page_id * 3 + {i}) % n, '\">{w}</a>'" for i, w in enumerate(_NEXT, 1))},
       ', <a href="', replace(c.url, '&', '&amp;'), '">story</a>', p.html) as html
from (select page_id, html, (select count(*) from {{pages}}) as n from {{pages}}) p
join ({CANDIDATES_SQL}) c on c.pos = p.page_id
"""


def crawl_pages(spark: SparkSession, sf: str) -> DataFrame:
    return stage(from_sql(spark, sf, CRAWL_PAGES_SQL), "pages")  # stored pages


# ---- pages with dot segments in their links ------------------------------------------
_DOTTED = ["/a/../b@", "/./a@", "/a/@/..", "/../c@?x=/d/../e", "/..", "/@/.", "/a.b/..c@/d.", "//h.example/x/../@", "http://h.example/y/../@"]
_DOTTED_HTML = "".join(f'<a href="{target}">dots</a>' for target in _DOTTED)
DOTTED_SQL = f"select page_id, url, concat(html, replace('{_DOTTED_HTML}', '@', cast(page_id as string))) as html from {{pages}}"


# ---- pages in other mark-up ------------------------------------------------------
_CLASSES = {2: "article-content", 3: "post-content", 4: "entry-content", 5: "content-body",
            6: "article-body", 8: "story-body"}


def _in_div(attributes: str) -> str:
    return (
        "replace(replace(replace(replace(html, '<h1>', '<div class=\"hd\"><h1>'), '</h1>', '</h1></div>'), "
        f"'<article>', '<div {attributes}>'), '</article>', '</div>')"
    )


VARIANTS_SQL = f"""
select page_id, url, case cast(page_id % 10 as int)
  when 1 then replace(replace(html, '<article>', '<section role="article">'), '</article>', '</section>')
  {" ".join(f"when {i} then {_in_div(f'class=\"x {c} y\"')}" for i, c in _CLASSES.items())}
  when 7 then concat('<article><p>teaser</p></article><article></article><main>', html, '</main>')
  when 9 then {_in_div('itemprop="articleBody"')}
  else html end as html
from {{pages}}
"""

# The paragraphs of an article in groups: items and cells without end tags, elements of the
# page's own, inline elements, and sections between paragraphs of the parent.
_GROUPS = [("<section>", "</section>", "<div>", "</div>"), ("<li class=g>", "", "<ul>", "</ul>"), ("<td>", "", "<table><tr>", "</table>"),
           ("<x-part>", "</x-part>", "<x-story>", "</x-story>"), ("<span>", "</span>", "<div>", "</div>"),
           ("<dd>", "", "<dl>", "</dl>"), ("<tr><td>", "", "<table>", "</tbody></table>")]


def _grouped(first: str, last: str, outer: str, end: str) -> str:
    return (f"replace(replace(replace(html, '<article>', '{outer}{first}'), '</article>', '{last}{end}'), "
            f"'</p><p><b>', '</p>{last}{first}<p><b>')")


SECTIONS_SQL = f"""
select page_id, url, case cast(page_id % {len(_GROUPS)} as int)
  {" ".join(f"when {i} then {_grouped(*g)}" for i, g in enumerate(_GROUPS))} end as html
from {{pages}}
"""
#: What a group of each page starts with.
GROUP_STARTS = "case cast(page_id % {} as int) {} end".format(
    len(_GROUPS), " ".join(f"when {i} then '{g[0]}'" for i, g in enumerate(_GROUPS)))


# ---- labels of documents -----------------------------------------------------------
LABELLED_SQL = """
select d.doc_id, d.text as content, l.quality, l.toxic,
       case when length(d.text) >= 500 then 1 else 0 end as quality_hat,
       case when d.doc_id % 4 = 0 then 1 else 0 end as toxic_hat,
       case when d.doc_id % 2 = 0 then 'val' else 'test' end as split
from {documents} d join {labels} l on l.doc_id = d.doc_id
"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return from_sql(spark, sf, LABELLED_SQL)


# ---- DuckDB fragments ----------------------------------------------------------------
def duck_lexicon(lexicon: Lexicon, chars: int | None, name: str, source: str = "documents", text: str = "text") -> str:
    """CTE ``name(doc_id, pos, label, score)`` of whole-word lexicon scores."""
    part = f"substring({text}, 1, {chars})" if chars else text
    rows = ", ".join(
        f"({i}, '{label}', {list(words)!r})" for i, (label, words) in enumerate(lexicon.words.items())
    )
    return f"""{name}_hits as (
  select doc_id, pos, label, len(list_filter(w, lambda x: list_contains(words, x))) as hits
  from (select doc_id, regexp_extract_all(lower({part}), '[\\p{{L}}\\p{{N}}_]+') as w from {source}) t,
       (values {rows}) l(pos, label, words)),
{name} as (select doc_id, pos, label, hits / (hits + 2.0) as score from {name}_hits)"""


SCORES_CTE = "with " + duck_lexicon(STAGE1, None, "s1") + ",\n" + duck_lexicon(STAGE2, None, "s2")
