"""Streaming forms, run over everything available; the result equals the batch form."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import ingest as I
from catalog import inference as N
from catalog.registry import query
from presswork import schemas
from presswork.session import stage_path
from presswork.streaming import ingest as stream_ingest_mod
from presswork.streaming import score as stream_score_mod

PAGE = "page_id bigint, url string, html string"


@query("stream_ingest", f"with {I.funnel_ctes()} select {I.ARTICLE_COLUMNS} from outcomes where outcome = 'saved'")
def stream_ingest(spark, sf):
    """Pages arrive in three lots, later pages later; the stream is taken up again after each."""
    source, out, checkpoint = (stage_path(spark, n) for n in ("page-stream", "stream-out", "stream-check"))
    pages = fx.pages(spark, sf)
    third = int(pages.agg(F.max("page_id")).first()[0]) // 3 + 1
    at = F.lit(I.SCRAPED_AT).cast("timestamp")
    for part in range(3):
        arrived = pages.where((F.col("page_id") >= part * third) & (F.col("page_id") < (part + 1) * third))
        arrived.write.mode("append").parquet(source)
        stream = stream_ingest_mod.read_page_stream(spark, source, PAGE)
        stream_ingest_mod.ingest_stream(stream, out, checkpoint, fx.KEYWORDS, scraped_at=at).awaitTermination()
    saved = spark.read.schema(f"page_id bigint, {schemas.ARTICLE}, batch_id bigint").parquet(out)
    return saved.drop("batch_id").withColumn(
        "keywords_found", F.array_join(F.sort_array(F.map_keys("keywords_found")), "|"))


@query("stream_score", f"{N.ANSWERS_CTE} select doc_id, category, confidence, ethics, error from answers")
def stream_score(spark, sf):
    """JSON request bodies as a stream of text lines."""
    source, out, checkpoint = (stage_path(spark, n) for n in ("requests", "answers", "answers-check"))
    requests = fx.from_sql(spark, sf, N.REQUESTS_SQL)
    requests.select("doc_id", F.to_json(F.struct("text")).alias("body")).write.parquet(source)
    stream = spark.readStream.schema("doc_id bigint, body string").parquet(source)
    texts = stream.select("doc_id", stream_score_mod.request_text(F.col("body")).alias("text"))
    stream_score_mod.score_stream(texts, N.STAGE1, N.STAGE2, out, checkpoint).awaitTermination()
    answers = spark.read.schema(
        "doc_id bigint, text string, error string, category string, confidence double, ethics map<string,double>"
    ).parquet(out)
    return N.flat_answers(answers)
