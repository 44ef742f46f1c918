"""Page to article queries."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from presswork.functions import html as H
from presswork.operators import extract, ingest
from presswork.operators.rows import array_rows

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOISE = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->"
TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>"
P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
P_END = r"(?i)</p\s*>|</?(?:article|section|div|main|footer|nav|ul|ol|body|html|h1)(?:\s[^>]*)?>"
SCRAPED_AT = "2024-01-02 03:04:05"


def entities(c: str) -> str:
    """The references that the tables use; the ampersand last."""
    return (
        f"replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    )


def para_list(fragment: str) -> str:
    return (
        f"list_transform(string_split_regex({fragment}, '{P_OPEN}')[2:], lambda p: string_split_regex(p, '{P_END}')[1])"
    )


def marked(p: str) -> str:
    return entities(f"regexp_replace({p}, '{TAG}', chr(1), 'g')")


def joined(m: str, sep: str) -> str:
    edge = r"[\x01\s\x0b\x1c-\x1f\x{85}\p{Z}]*"
    inner = f"regexp_replace({m}, '{edge}\\x01{edge}', '{sep}', 'g')"
    return f"regexp_replace({inner}, '^{WS}+|{WS}+$', '', 'g')"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def paras_text(fragment: str) -> str:
    texts = f"list_transform({para_list(fragment)}, lambda q: {joined(marked('q'), ' ')})"
    return f"array_to_string({texts}, ' ')"


def main_cte(pages: str, body: str = "regexp_extract(c, '(?is)<article(?:\\s[^>]*)?>(.*?)(?:</article\\s*>|\\z)', 1)") -> str:
    return f"""clean as (select page_id, url, html, regexp_replace(html, '{NOISE}', '<!-->', 'g') as c from {pages}),
bodies as (select page_id, url, html, c, {body} as body from clean),
mains as (select page_id, url, html, c, case when length(t) > 500 then {collapsed('t')} end as main
          from (select page_id, url, html, c, {paras_text('body')} as t from bodies) x)"""


LONG = f"""{collapsed(f'''array_to_string(list_transform(
  list_filter(list_transform({para_list('c')}, lambda q: {marked('q')}), lambda m: length({joined('m', '')}) > 50),
  lambda m: {joined('m', ' ')}), ' ')''')}"""
TITLE = f"""regexp_replace({entities("regexp_extract(c, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '^{WS}+|{WS}+$', '', 'g')"""
CONTENT_CTE = f"""{main_cte('pages')},
contents as (select page_id, url, html, {TITLE} as title, coalesce(main, {LONG}) as content from mains)"""


def _clean(pages):
    return pages.withColumn("c", H.strip_noise(F.col("html")))


@query("needs_render", "select page_id, coalesce(length(html), 0) < 1000 as needs_render from pages")
def needs_render(spark, sf):
    return fx.pages(spark, sf).select("page_id", H.needs_render(F.col("html")).alias("needs_render"))


@query("page_title", f"with clean as (select page_id, regexp_replace(html, '{NOISE}', '<!-->', 'g') as c from pages) select page_id, {TITLE} as title from clean")
def page_title(spark, sf):
    return _clean(fx.pages(spark, sf)).select("page_id", H.title_of(F.col("c")).alias("title"))


# The body of each mark-up variant, cut by what the variant is known to look like.
VARIANT_BODY = """case cast(page_id % 10 as int)
  when 1 then regexp_extract(c, '(?s)<section role="article">(.*?)</section>', 1)
  when 7 then regexp_extract(c, '(?s)<main>.*<article>(.*?)</article>', 1)
  when 0 then regexp_extract(c, '(?s)<article>(.*?)</article>', 1)
  else regexp_extract(c, '(?s)<div (?:class="x [a-z-]* y"|itemprop="articleBody")>(.*?</div>.*?)</div>', 1) end"""


@query("article_text", f"""with variants as ({fx.duck(fx.VARIANTS_SQL)}),
{main_cte('variants', VARIANT_BODY)} select page_id, main from mains""")
def article_text(spark, sf):
    variants = fx.from_sql(spark, sf, fx.VARIANTS_SQL)
    return _clean(variants).select("page_id", H.main_text(F.col("c")).alias("main"))


SECTIONS_CTE = f"""flat as (select page_id, unnest(range(len(s))) as parent, unnest(s) as body from (
  select page_id, string_split(regexp_replace(html, '{NOISE}', '<!-->', 'g'), {fx.GROUP_STARTS})[2:] as s from sections)),
texts as (select page_id, parent, {paras_text('body')} as t, len({para_list('body')}) as n from flat),
best as (select page_id, t from texts where n > 0 qualify row_number() over (partition by page_id order by length(t) desc, parent) = 1)"""


@query("largest_block", f"""with sections as ({fx.duck(fx.SECTIONS_SQL)}), {SECTIONS_CTE}
select page_id, {collapsed('t')} as block from best where length(t) > 500""")
def largest_block(spark, sf):
    return extract.largest_block(fx.from_sql(spark, sf, fx.SECTIONS_SQL), "page_id")


@query("section_content", f"""with sections as ({fx.duck(fx.SECTIONS_SQL)}), {SECTIONS_CTE}
select page_id, coalesce(block, {LONG}) as content from (
  select c.page_id, c, {collapsed('b.t')} as block
  from (select page_id, regexp_replace(html, '{NOISE}', '<!-->', 'g') as c from sections) c
  left join (select * from best where length(t) > 500) b on b.page_id = c.page_id) x""")
def section_content(spark, sf):
    return extract.extract_content(fx.from_sql(spark, sf, fx.SECTIONS_SQL), "page_id").select("page_id", "content")


@query("long_paragraphs", f"with clean as (select page_id, regexp_replace(html, '{NOISE}', '<!-->', 'g') as c from pages) select page_id, {LONG} as content from clean")
def long_paragraphs(spark, sf):
    return _clean(fx.pages(spark, sf)).select("page_id", H.long_paragraphs(F.col("c")).alias("content"))


@query("content_extract", f"with {CONTENT_CTE} select page_id, title, content from contents")
def content_extract(spark, sf):
    return extract.extract_content(fx.pages(spark, sf), "page_id").select("page_id", "title", "content")


KEYWORD_LIST = repr(fx.KEYWORDS)
HITS_CTE = f"""hits as (select doc_id, list_filter({KEYWORD_LIST}, lambda k: contains(lower(text), k)) as found from documents)"""


def _hits(spark, sf):
    return fx.documents(spark, sf).withColumn("found", ingest.keyword_hits(F.col("text"), fx.KEYWORDS))


@query("keyword_hits", f"with {HITS_CTE} select doc_id, array_to_string(found, '|') as keywords from hits where len(found) > 0")
def keyword_hits(spark, sf):
    return _hits(spark, sf).where(F.size("found") > 0).select("doc_id", F.array_join("found", "|").alias("keywords"))


@query("keyword_counts", f"with {HITS_CTE}, flat as (select unnest(found) as keyword from hits) select keyword, count(*) as articles from flat group by keyword")
def keyword_counts(spark, sf):
    return array_rows(_hits(spark, sf), [], F.col("found"), "keyword", None).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("articles"))


@query("article_ids", f"with {CONTENT_CTE} select page_id, sha256(url) as id, sha256(content) as content_hash from contents")
def article_ids(spark, sf):
    content = extract.extract_content(fx.pages(spark, sf), "page_id")
    return content.select("page_id", F.sha2("url", 256).alias("id"), F.sha2("content", 256).alias("content_hash"))


@query("content_dedup", """with h as (select doc_id, sha256(text) as content_hash, text from documents),
old as (select content_hash from h where doc_id % 97 = 5),
firsts as (select doc_id, content_hash from h qualify row_number() over (partition by content_hash order by doc_id) = 1)
select doc_id, content_hash from firsts where content_hash not in (select content_hash from old)""")
def content_dedup(spark, sf):
    from presswork.operators.dedup import first_wins, new_rows

    hashed = fx.documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    history = hashed.where("doc_id % 97 = 5").select("content_hash").distinct()
    return new_rows(first_wins(hashed, ["content_hash"], ["doc_id"]), history, "content_hash").select("doc_id", "content_hash")


def funnel_ctes(history: str = "") -> str:
    """Outcome of each page; ``history`` is SQL for a CTE body of saved pages, or nothing."""
    seen = "url in (select url from history)" if history else "false"
    old = "content_hash in (select content_hash from history)" if history else "false"
    hist = f"history as ({history})," if history else ""
    return f"""{CONTENT_CTE}, {hist}
gates as (select page_id, url, title, content, sha256(content) as content_hash, case
    when {seen} then 'duplicate_url'
    when not regexp_matches(coalesce(html, ''), '^{WS}*<') then 'failed_fetch'
    when content is null then 'parse_error'
    when length(content) < 500 then 'too_short' when length(content) > 10000 then 'too_long'
    when len(list_filter({KEYWORD_LIST}, lambda k: contains(lower(trim(title || ' ' || content)), k))) = 0
      then 'filtered_keyword' end as gate from contents),
ranked as (select page_id, content_hash, row_number() over (partition by content_hash order by page_id) as n
  from gates where gate is null),
outcomes as (select g.page_id, g.url, g.title, g.content, g.content_hash,
    coalesce(gate, case when r.n = 1 and not {old.replace('content_hash in', 'g.content_hash in')} then 'saved' else 'duplicate_content' end) as outcome
  from gates g left join ranked r on r.page_id = g.page_id)"""


HISTORY = "select url, sha256(content) as content_hash from contents where page_id % 7 = 0"


def _history(spark, sf):
    rows = extract.extract_content(fx.pages(spark, sf), "page_id").where("page_id % 7 = 0")
    return rows.select("url", F.sha2("content", 256).alias("content_hash"))


def funnel_run(spark, sf, history=False):
    urls, hashes = ingest.history_keys(_history(spark, sf), unique=False) if history else (None, None)
    return ingest.run_funnel(
        fx.pages(spark, sf), fx.KEYWORDS, history_urls=urls, history_hashes=hashes,
        scraped_at=F.lit(SCRAPED_AT).cast("timestamp"))


@query("ingest_funnel", f"""with {funnel_ctes()} select outcome, count(*) as pages from outcomes group by outcome
union all select 'attempted', count(*) from outcomes""")
def ingest_funnel(spark, sf):
    return ingest.funnel_counts(funnel_run(spark, sf).outcomes)


@query("page_outcomes", f"with {funnel_ctes(HISTORY)} select page_id, url, outcome from outcomes")
def page_outcomes(spark, sf):
    return funnel_run(spark, sf, history=True).outcomes


ARTICLE_COLUMNS = f"""page_id, sha256(url) as id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as domain, title, content,
  cast(length(content) as int) as content_length, content_hash,
  array_to_string(list_sort(list_filter({KEYWORD_LIST}, lambda k: contains(lower(trim(title || ' ' || content)), k))), '|') as keywords_found,
  '{SCRAPED_AT}' as scraped_at"""


@query("articles", f"with {funnel_ctes(HISTORY)} select {ARTICLE_COLUMNS} from outcomes where outcome = 'saved'")
def articles(spark, sf):
    run = funnel_run(spark, sf, history=True)
    return run.articles.withColumn(
        "keywords_found", F.array_join(F.sort_array(F.map_keys("keywords_found")), "|"))


@query("history_keys", """with h as (select case when doc_id % 5 = 0 then null else source || '/' || cast(floor(doc_id / 3) as bigint) end as url,
  case when doc_id % 4 = 0 then null else sha256(text) end as content_hash from documents)
select 'url' as kind, url as value from (select distinct url from h where url is not null) u
union all select 'content_hash', content_hash from (select distinct content_hash from h where content_hash is not null) c""")
def history_keys(spark, sf):
    saved = fx.documents(spark, sf).selectExpr(
        "case when doc_id % 5 = 0 then null else concat(source, '/', cast(floor(doc_id / 3) as bigint)) end as url",
        "case when doc_id % 4 = 0 then null else sha2(text, 256) end as content_hash")
    urls, hashes = ingest.history_keys(saved)
    return urls.select(F.lit("url").alias("kind"), F.col("url").alias("value")).unionByName(
        hashes.select(F.lit("content_hash").alias("kind"), F.col("content_hash").alias("value")))
