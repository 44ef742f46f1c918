"""The operators as queries over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.bands import compression_bands
from presswork.llm.common import table
from presswork.llm.decontaminate import contaminations
from presswork.llm.divergence import source_divergence
from presswork.llm.geometric import ranked_search
from presswork.llm.labelled import fold
from presswork.llm.mincut import extract_main_text
from presswork.llm.packing import pack_documents
from presswork.llm.quotes import build_conversations
from presswork.llm.rules import fit_quality, score_quality
from presswork.llm.sharding import assign_shards
from presswork.llm.simhash import near_duplicates
from presswork.llm.suffixes import remove_repeats
from presswork.llm.topk import quantised, top_k
from presswork.llm.toxicity import fit_on, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_exact_top_k", """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as w
  from embeddings
  where embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum([q.w[i] * c.w[i] for i in range(1, 1 + least(len(q.w), len(c.w)))]) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) r
where rank <= 10
""")
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), quantised("embedding").alias("weights"))
    found = top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)
    return found.withColumnRenamed("id", "vec_id")


@query("op2_reply_order")
def reply_order(spark: SparkSession, sf: str) -> DataFrame:
    return build_conversations(table(spark, sf, "conversations"))


@query("op3_cut_extraction")
def cut_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_main_text(table(spark, sf, "pages"))


@query("op4_edit_decontamination")
def edit_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminations(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_pattern_packing")
def pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), tokenizer_path())


@query("op6_simhash_groups")
def simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), fold("doc_id", 4) == 2
    model = fit_quality(docs, table(spark, sf, "labels"), ~held_out)
    return score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_suffix_repeats")
def suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), keep=None).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_compression_toxicity")
def compression_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), fold("doc_id", 5) == 0
    model = fit_on(docs, table(spark, sf, "labels"), ~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_ring_shards")
def ring_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return assign_shards(docs, shards=40, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_geometric_search", r"""
with lowered as (
  select 'd' as kind, row_number() over () as r, doc_id as id,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all
  select 'q', row_number() over (), item_id,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), terms as (
  select kind, r, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lowered
), sizes as (
  select r, any_value(id) as doc_id, count(*) as n from terms where kind = 'd' group by r
), corpus as (
  select count(*) as docs, cast(sum(n) as bigint) as total from sizes
), asked as (
  select distinct r as q, id as item_id, term from terms where kind = 'q'
), postings as (
  select r, term, count(*) as tf from terms where kind = 'd' and term in (select term from asked) group by r, term
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select term, count(*) as df from postings group by term) t, corpus
), scores as (
  select a.q, a.item_id, s.doc_id,
         cast(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * s.n * c.docs) // c.total)))) as bigint) as score
  from asked a join weights w on a.term = w.term join postings p on a.term = p.term join sizes s on p.r = s.r cross join corpus c
  group by a.q, a.item_id, s.r, s.doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scores where score > 0) r
where rank <= 50
""")
def geometric_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_run_length_divergence", r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents
), found as (
  select r, lang, source, unnest(ts) as term from d
), kept as (
  select lang, term, count(*) as n from found group by lang, term having count(distinct r) >= 30
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), counts as (
  select f.lang, f.source, f.term, count(*) as n from found f join kept k on f.lang = k.lang and f.term = k.term group by all
), groups as (
  select g.lang, g.source, coalesce(sum(c.n), 0) as total
  from (select distinct lang, source from d) g left join counts c on g.lang = c.lang and g.source = c.source
  group by all
), shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p,
         1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
  from groups g join langs l on g.lang = l.lang join kept k on g.lang = k.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), valued as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from valued) r
where part = 'pair' or rank <= 50
""")
def run_length_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))


@query("op13_compression_bands")
def compression_band_rules(spark: SparkSession, sf: str) -> DataFrame:
    return compression_bands(table(spark, sf, "documents"))
