"""Whole jobs, from their files to their files: collect, label, split, train."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import ingest as I
from catalog import labels as L
from catalog import urls as U
from catalog.registry import query
from presswork.config import ISSUES, stage_keys
from presswork.operators import labelling, splits, train
from presswork.operators.inference import lexicon_stage
from presswork.plans import corpus
from presswork.session import stage, stage_path
from presswork.sources import tables
from presswork.sources.config import read_sources
from presswork.sources.models import load_model, save_model

# ---- collect: from a configuration file to one outcome per stored candidate ----------------
CRAWLED = 1_000_000
COLLECT_CTES = f"""{U.discovered_ctes("select ''")},
stored as (select page_id, url, html from pages union all select page_id + {CRAWLED}, url, html from crawl),
wanted as (select * from stored where url in (select url from discovered)),
{I.funnel_ctes().replace('from pages', 'from wanted')}"""


def _collect(spark, sf):
    path = stage_path(spark, "sources")
    sites = spark.createDataFrame([s for s in U.SITES], "site_pos int, domain string, type string, feed string, url string")
    item = F.struct("site_pos", "domain", "type", "feed", "url", F.lit(False).alias("js"))
    config = sites.agg(F.array_sort(F.collect_list(item)).alias("sites")).withColumn("keywords", F.array(*[F.lit(k.upper()) for k in fx.KEYWORDS]))
    config.select(F.to_json(F.struct("sites", "keywords")).alias("value")).coalesce(1).write.text(path)
    crawl = fx.crawl_pages(spark, sf)
    pages = fx.pages(spark, sf).select("page_id", "url", "html").unionByName(crawl.withColumn("page_id", F.col("page_id") + CRAWLED))
    at = F.lit(I.SCRAPED_AT).cast("timestamp")
    return corpus.collect(read_sources(spark, path), pages, fx.docs(spark, sf), scraped_at=at)


@query("collect_outcomes", f"{COLLECT_CTES} select page_id, url, outcome from outcomes")
def collect_outcomes(spark, sf):
    return _collect(spark, sf).outcomes


@query("collect_articles", f"{COLLECT_CTES} select {I.ARTICLE_COLUMNS} from outcomes where outcome = 'saved'")
def collect_articles(spark, sf):
    """Discovered, fetched from the store, gated and saved as JSON lines."""
    path = stage_path(spark, "articles")
    tables.append_articles(_collect(spark, sf).articles, path)
    saved = tables.read_articles(spark, path, schema="page_id bigint, id string, url string, domain string, title string, content string, "
                                 "content_length int, content_hash string, keywords_found map<string,boolean>, scraped_at string")
    return saved.withColumn("keywords_found", F.array_join(F.sort_array(F.map_keys("keywords_found")), "|"))


# ---- label: both stages, gate, binary labels --------------------------------------------------
TEXTS_CTE = f"texts as (select doc_id, text from documents where text is not null and not regexp_matches(text, '^{I.WS}*$'))"


def _labelled(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", F.col("text").alias("content"))
    return corpus.label_articles(docs, lexicon_stage(fx.STAGE1), lexicon_stage(fx.STAGE2), key="doc_id")


@query("label_job", f"""{L.WIDE_CTE}, {TEXTS_CTE} select doc_id, {L.rounded([*L.S1_COLS, *L.S2_COLS])}, {', '.join([*L.B1_COLS, *L.B2_COLS])}
from binary_labels where doc_id in (select doc_id from texts)""")
def label_job(spark, sf):
    """The label columns are found by their prefixes."""
    out = _labelled(spark, sf)
    binary = [c for prefix in ("stage1_binary_", "stage2_binary_") for c in labelling.label_columns(out, prefix)]
    scores = [c for prefix in ("stage1_", "stage2_") for c in labelling.label_columns(out, prefix) if c not in binary]
    return out.select("doc_id", *L.rounded_cols(scores), *binary)


# ---- split: both regimes, written with the columns of the files and read back --------------------
def _flags(columns) -> str:
    return " || ".join(f"cast({c} as varchar)" for c in columns)


def _split_sql(source: str, order: str, strata: str, test: str, held: str) -> str:
    over = f"partition by {strata} " if strata else ""
    return f"""(select *, case when r <= {test} then 'test' when r <= {held} then 'val' else 'train' end as split
  from (select *, row_number() over ({over}order by md5({order} || ':42'), {order}) as r, count(*) over ({over}) as n from {source}) x)"""


TEST_FIRST = ("ceil(n / 10.0)", "(ceil(n / 10.0) + ceil((n - ceil(n / 10.0)) / 9.0))")
HALVES = ("ceil(ceil(n / 5.0) / 2.0)", "ceil(n / 5.0)")


@query("label_splits_job", f"""{L.WIDE_CTE}, {TEXTS_CTE}, rows1 as (select b.*, t.text from binary_labels b join texts t on t.doc_id = b.doc_id),
rows2 as (select * from rows1 where stage1_binary_artificial_intelligence = 1)
select 'stage1' as stage, split, sha256(text) as content_hash, {_flags(L.B1_COLS)} as flags from {_split_sql('rows1', 'doc_id', '', *TEST_FIRST)} a
union all
select 'stage2', split, sha256(text), {_flags(L.B2_COLS)} from {_split_sql('rows2', 'doc_id', '', *TEST_FIRST)} b""")
def label_splits_job(spark, sf):
    """Stage 1 on all articles and stage 2 on gated ones, as CSV files per split."""
    parts, path = [], stage_path(spark, "split-files")
    for name, data in corpus.label_splits(_labelled(spark, sf), "doc_id", minimum=1).items():
        tables.write_csv(data, f"{path}/{name}", ["split"])
        for split in ("train", "val", "test"):
            read = tables.read_split(spark, f"{path}/{name}/split={split}", name)
            parts.append(read.select(
                F.lit(name).alias("stage"), F.lit(split).alias("split"), F.sha2("content", 256).alias("content_hash"),
                F.concat(*[F.col(c).cast("string") for c in stage_keys(name, binary=True)]).alias("flags")))
    return reduce(DataFrame.unionByName, parts)


@query("single_label_splits_job", f"""{L.SINGLE_CTE}, {fx.duck_lexicon(fx.STAGE2, None, 's2')}, {L.FLAGS_CTE},
main as (select s.doc_id, s.label, split_part(d.text, chr(10), 1) || ' ' || d.text as text from single s join documents d on d.doc_id = s.doc_id where d.text is not null),
issues as (select m.*, {" || ".join(f"cast(coalesce(f.{c}, 0) as varchar)" for c in L.FLAG_COLS)} as flags
  from main m left join flags f on f.doc_id = m.doc_id where m.label = 'Artificial Intelligence')
select 'main' as part, split, sha256(text) as content_hash, label as flags from {_split_sql('main', 'doc_id', 'label', *HALVES)} a
union all
select 'issues', split, sha256(text), flags from {_split_sql('issues', 'doc_id', '', *HALVES)} b""")
def single_label_splits_job(spark, sf):
    """One label per article, stratified, and the issues of the gate category."""
    articles = L.single(spark, sf).withColumnRenamed("doc_id", "id")
    parts, path = corpus.single_label_splits(articles, L._flags(spark, sf), "line"), stage_path(spark, "split-files")
    shown = {"main": F.col("label"), "issues": F.concat(*[F.col(f"`{c}`").cast("string") for c in ISSUES])}
    schemas = {"main": "text string, label string", "issues": "text string, " + ", ".join(f"`{c}` int" for c in ISSUES)}
    out = []
    for name, data in parts.items():
        tables.write_csv(data, f"{path}/{name}", ["split"])
        for split in ("train", "val", "test"):
            read = tables.read_csv(spark, f"{path}/{name}/split={split}", schemas[name])
            out.append(read.select(F.lit(name).alias("part"), F.lit(split).alias("split"), F.sha2("text", 256).alias("content_hash"), shown[name].alias("flags")))
    return reduce(DataFrame.unionByName, out)


@query("enough_rows", """select lang, needed, count(*) >= needed as enough from documents, (values (1), (100), (100000000)) m(needed) group by lang, needed""")
def enough_rows(spark, sf):
    """Whether each language has the rows that a data set needs."""
    docs = fx.documents(spark, sf)
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())  # one row per language
    rows = [(lang, n, splits.enough_rows(docs.where(F.col("lang") == lang), n)) for lang in langs for n in (1, 100, 100_000_000)]
    return spark.createDataFrame(rows, "lang string, needed int, enough boolean")


# ---- train: labels that one term decides, so that a right fit has known results --------------------
PLANTED_SQL = """
select doc_id, concat(substring(text, 1, 20), case when doc_id % 3 = 0 then repeat(' zzone', 20) else '' end,
       case when doc_id % 5 < 2 then repeat(' zztwo', 20) else '' end) as content,
       case when doc_id % 3 = 0 then 1 else 0 end as one, case when doc_id % 5 < 2 then 1 else 0 end as two
from {documents} where text is not null
"""
PLANTED = ["one", "two"]
PLANTED_SPLIT = f"""with planted as (select *, case when md5(doc_id || ':42') < 'cccccccc' then 'train'
  when md5(doc_id || ':42') < 'e6666666' then 'val' else 'test' end as split from ({fx.duck(PLANTED_SQL)}) p)"""


def _planted(spark, sf):
    return splits.split_hash(fx.from_sql(spark, sf, PLANTED_SQL), "doc_id")


def _fitted(spark, sf):
    data = stage(_planted(spark, sf), "planted")
    return data, train.fit_multilabel(data.where("split = 'train'"), PLANTED, size=5_000, c=1000.0, partitions=fx.fit_partitions(spark))


@query("planted_weights", f"""{PLANTED_SPLIT} select distinct label, term from planted, (values ('one', 'zzone zzone'), ('two', 'zztwo zztwo')) v(label, term)""")
def planted_weights(spark, sf):
    """The bigram or term with the largest weight of each label, as the bigram that holds it."""
    _, model = _fitted(spark, sf)
    rows = [(label, term) for label, term, _ in train.largest_weights(model, 1)]
    return spark.createDataFrame([(label, f"{term} {term}" if " " not in term else term) for label, term in rows], "label string, term string")


@query("planted_predictions", f"{PLANTED_SPLIT} select doc_id, split, one as pred_one, two as pred_two from planted")
def planted_predictions(spark, sf):
    """A model that was saved and loaded, used on all rows."""
    data, model = _fitted(spark, sf)
    path = stage_path(spark, "model")
    save_model(model, path, spark)
    out = train.predict_multilabel(data, load_model(path, spark))
    return out.select("doc_id", "split", "pred_one", "pred_two")


@query("planted_metrics", f"{PLANTED_SPLIT} select split, 1.0::double as micro_f1, 1.0::double as macro_f1, 0.0::double as hamming_loss from planted where split <> 'train' group by split")
def planted_metrics(spark, sf):
    """Trained and evaluated as one stage."""
    return corpus.train_stage(_planted(spark, sf), PLANTED, size=5_000, c=1000.0, partitions=fx.fit_partitions(spark)).metrics
