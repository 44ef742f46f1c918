"""Readers and writers as round trips through the shared work folder."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import models
from catalog.registry import query
from presswork import schemas
from presswork.plans import corpus
from presswork.session import stage_path
from presswork.sources import config as source_config
from presswork.sources import tables

RECORDS_SQL = """select cast(doc_id as string) as id, source as domain, split_part(text, chr(10), 1) as title,
text as content, cast(length(text) as int) as content_length from {documents}"""
RECORD = "id string, domain string, title string, content string, content_length int"
RECORD_OUT = """select cast(doc_id as varchar) as id, source as domain, split_part(text, chr(10), 1) as title, text as content,
cast(length(text) as int) as content_length from documents"""


def _records(spark, sf):
    return fx.from_sql(spark, sf, RECORDS_SQL)


@query("scan_jsonl", RECORD_OUT)
def scan_jsonl(spark, sf):
    path = stage_path(spark, "jsonl")
    tables.append_articles(_records(spark, sf), path)
    return tables.read_articles(spark, path, "FAILFAST", RECORD)


@query("scan_jsonl_tolerant", f"select * from ({RECORD_OUT} where doc_id % 9 <> 4) r")
def scan_jsonl_tolerant(spark, sf):
    """Lines of every ninth record are cut off, and a blank line follows each seventh."""
    path = stage_path(spark, "jsonl")
    line = F.to_json(F.struct(*[F.col(c) for c in ("id", "domain", "title", "content", "content_length")]))
    number = F.col("id").cast("long")
    broken = F.when(number % 9 == 4, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    lines = F.when(number % 7 == 0, F.concat(broken, F.lit("\n"))).otherwise(broken)
    _records(spark, sf).select(lines.alias("value")).write.text(path)
    return tables.read_articles(spark, path, "DROPMALFORMED", RECORD)


@query("csv_roundtrip", RECORD_OUT)
def csv_roundtrip(spark, sf):
    path = stage_path(spark, "csv")
    tables.write_csv(_records(spark, sf), path)
    return tables.read_csv(spark, path, RECORD)


@query("split_table", """select doc_id, text as content, case when md5(doc_id || ':42') < 'cccccccc' then 'train'
when md5(doc_id || ':42') < 'e6666666' then 'val' else 'test' end as split from documents""")
def split_table(spark, sf):
    from presswork.operators.splits import split_hash

    path = stage_path(spark, "splits")
    docs = fx.documents(spark, sf).select("doc_id", F.col("text").alias("content"))
    tables.write_splits(split_hash(docs, "doc_id"), path)
    return spark.read.schema("doc_id bigint, content string, split string").parquet(path)


@query("page_cache_key", "select page_id, sha256(url) as cache_key, substring(sha256(url), 1, 2) as shard, html from pages")
def page_cache_key(spark, sf):
    path = stage_path(spark, "pages")
    tables.write_pages(fx.pages(spark, sf), path)
    return tables.read_pages(spark, path, "page_id bigint, url string, html string").select(
        "page_id", "cache_key", "shard", "html")


@query("discovered_urls", "select distinct url from pages")
def discovered_urls(spark, sf):
    path = stage_path(spark, "urls")
    tables.write_urls(fx.pages(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "url")


@query("model_results_json", f"""{models.MODELS_CTE}
select 'stage1' as stage, 1 as num_labels, model as name, round(max(case when split = 'val' then micro_f1 end), 6) as val_micro_f1,
round(max(case when split = 'test' then micro_f1 end), 6) as test_micro_f1 from results where stage = 'stage1' group by model""")
def model_results_json(spark, sf):
    """Result documents of the rule models, written and read back."""
    rows = models._results(spark, sf).where("stage = 'stage1'")
    path = stage_path(spark, "results")
    tables.write_results(corpus.results_document(rows, "stage1", ["quality"]), path)
    doc = tables.read_results(spark, path)
    return doc.select("stage", "num_labels", F.inline("models")).select(
        "stage", "num_labels", "name", F.round("val_metrics.micro_f1", 6).alias("val_micro_f1"),
        F.round("test_metrics.micro_f1", 6).alias("test_micro_f1"))


SITE_SQL = """select chunk, page_id as pos, regexp_extract(url, '//([^/]*)', 1) as domain,
case cast(page_id % 3 as int) when 0 then 'rss' when 1 then 'sitemap' else 'category' end as type, url from (
select page_id, url, cast(floor(page_id / 50) as bigint) as chunk from {pages}) p"""


SETTINGS_CTE = f"""with sites as ({fx.duck(SITE_SQL)}),
words as (select distinct chunk, lower(substring(domain, 1, 4)) as keyword from sites),
sizes as (select chunk, count(*) as n from sites group by chunk)"""


def _config(spark, sf):
    """Configuration documents of fifty sites each, one file per document; odd ones name a limit less."""
    sites = fx.from_sql(spark, sf, SITE_SQL)
    item = F.struct(
        "pos", "domain", "type", F.when(F.col("type") != "category", F.col("url")).alias("feed"),
        F.when(F.col("type") == "category", F.col("url")).alias("url"), F.lit(False).alias("js"))
    docs = sites.groupBy("chunk").agg(
        F.array_sort(F.collect_list(item)).alias("sites"),
        F.array_sort(F.collect_set(F.upper(F.substring("domain", 1, 4)))).alias("keywords"),
        F.count("*").cast("int").alias("max_urls"))
    docs = docs.withColumn("min_content_chars", F.when(F.col("chunk") % 2 == 0, F.col("chunk").cast("int") + 100))
    path = stage_path(spark, "config")
    docs.select(F.to_json(F.struct("sites", "keywords", "max_urls", "min_content_chars"), {"pretty": "true"}).alias("value"), "chunk").write.partitionBy(
        "chunk").text(path)
    return spark.read.schema(f"{schemas.SOURCE_CONFIG}, chunk bigint").option("multiLine", True).json(path)


@query("site_config", f"""select chunk, row_number() over (partition by chunk order by pos) - 1 as site_pos, domain, type,
case when type <> 'category' then url end as feed, case when type = 'category' then url end as url from ({fx.duck(SITE_SQL)}) s""")
def site_config(spark, sf):
    return source_config.site_rows(_config(spark, sf), "chunk").select(
        "chunk", F.col("site_pos").cast("long").alias("site_pos"), "domain", "type", "feed", "url")


@query("config_keywords", f"""{SETTINGS_CTE} select chunk, row_number() over (partition by chunk order by upper(keyword)) - 1 as pos, keyword from words""")
def config_keywords(spark, sf):
    return source_config.keyword_rows(_config(spark, sf), "chunk").withColumn("pos", F.col("pos").cast("long"))


@query("config_limits", f"""{SETTINGS_CTE}, names as (select unnest(['min_content_chars', 'max_content_chars', 'max_urls_per_site', 'max_urls',
  'sitemap_max_nested', 'crawl_max_depth', 'crawl_fanout']) as name)
select chunk, name, cast(case name when 'min_content_chars' then case when chunk % 2 = 0 then chunk + 100 else 500 end
  when 'max_content_chars' then 10000 when 'max_urls' then n end as int) as value from sizes, names""")
def config_limits(spark, sf):
    return source_config.limit_rows(_config(spark, sf), "chunk")


@query("jsonl_overwrite", f"select * from ({RECORD_OUT} where doc_id % 2 = 0) r")
def jsonl_overwrite(spark, sf):
    """A table of JSON lines that is written again holds the last rows only."""
    path = stage_path(spark, "jsonl")
    tables.append_articles(_records(spark, sf), path)
    tables.write_articles(_records(spark, sf).where(F.col("id").cast("long") % 2 == 0), path)
    return tables.read_articles(spark, path, "FAILFAST", RECORD)


@query("required_columns", "select distinct doc_id % 10 as bucket from documents")
def required_columns(spark, sf):
    """A table passes with the columns that are asked for, and is refused without them."""
    rows = fx.documents(spark, sf).select((F.col("doc_id") % 10).alias("bucket")).distinct()
    try:
        tables.require_columns(rows, ["content"])
    except ValueError:
        return tables.require_columns(rows, ["bucket"])
    raise AssertionError("a missing column was let through")
